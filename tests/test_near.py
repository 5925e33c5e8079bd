"""Exact pairs of near vectors against brute force, and what the queries over them are planned as."""

import numpy as np
import pytest

from larkspur.operators import near
from larkspur.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [0.3, 4.0])
def test_pairs_within(spark, most):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 12)) * 0.4
    x[200:250] = x[:50] + 0.01
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)]
    rows += [(400, [0.0, 1.0], "a"), (401, [0.0, 1.2], "a"), (402, None, "a"), (403, [None, 1.0], "a"), (404, [float("nan"), 1.0], "a"), (405, [0.0, 1.0], None), (None, [0.0, 1.0], "a"), (406, [1e300, 1.0], "a")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, kind string")
    sound = [(i, v, k) for i, v, k in rows if i is not None and k and v and None not in v and not any(np.isnan(v))]
    with np.errstate(over="ignore"):
        want = {(i, j) for i, v, k in sound if i % 4 == 0 for j, w, m in sound if k == m and len(v) == len(w) and np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()) <= most}
    for block in (near.MOST, 600):
        near_least, near.LEAST = near.LEAST, min(near.LEAST, block)
        try:
            got = [(a.id, a.other_id) for a in near.pairs_within(df.filter("id % 4 = 0"), df, most, block).collect()]
        finally:
            near.LEAST = near_least
        assert len(got) == len(set(got)) and set(got) == want


def test_all_neighbours_need_no_nested_loop(spark):
    assert "NestedLoop" not in plan(QUERIES["vector_neighbours_all"](spark, FOLDER))


def test_neighbours_of_a_label_are_not_joined_by_it(spark):
    assert "Join" not in plan(QUERIES["vector_neighbours"](spark, FOLDER))


def test_few_copies_are_dealt(spark):
    # sides of 10,000 and 200,000 vectors: each goes to as few tasks as work and memory allow
    n = 200_000
    rows = spark.range(n).selectExpr("id", "array_repeat(cast(id AS float), 64) AS vector", "0 AS kind")
    assert n < near.dealt(rows.filter("id % 20 = 0"), rows).count() <= 4 * n


@pytest.mark.parametrize(("asked", "others", "wanted", "most"), [(0, 0, 8, 100), (64, 10**9, 8, 1 << 22), (2 * 10**6, 4 * 10**7, 48, 1 << 22), (4 * 10**8, 8 * 10**9, 48, 1 << 22), (10**6, 10**6, 48, 1000)])
def test_blocks_are_bounded_and_tasks_many(asked, others, wanted, most):
    parts, wide = near.grid(asked, others, wanted, most)
    assert asked <= parts * most and others <= wide * most
    assert parts * wide >= max(1, min(wanted, asked * others // near.WORK))


def test_pairs_of_one_vector_follow_one_another():
    r = np.random.default_rng(4)
    x, y = r.normal(size=(200, 8)), r.normal(size=(300, 8))
    found = list(near.near(x, y, 100.0))
    i, j, d = (np.concatenate([part[k] for part in found]) for k in range(3))
    assert len(set(zip(i.tolist(), j.tolist()))) == len(i) == 200 * 300 and np.allclose(d, np.sqrt(((x[i] - y[j]) ** 2).sum(1)))
    assert np.count_nonzero(np.diff(j)) < len(j) / 30
