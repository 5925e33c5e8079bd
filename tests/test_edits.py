"""Edit distances of a name to many at once against the plain table, and what the query over them is planned as."""

import random

import pyarrow as pa
import pytest
from test_spread import plain_distance

from larkspur.operators import edits
from larkspur.plans.queries import QUERIES


@pytest.mark.parametrize("longest", [0, 1, 8, 9, 33, 64, 65, 150])
def test_distances(longest):
    r = random.Random(longest)
    make = lambda n: "".join(r.choice("až\U0001f37a\0b") for _ in range(r.randint(0, n)))
    names = [make(longest) for _ in range(30)] + ["a" * longest]
    to = edits.distances_to(names)
    for start in (0, 3, 29):
        asked = make(longest + 2) + "c" * (start == 3)
        assert to(asked, start).tolist() == [plain_distance(asked, x) for x in names[start:]]


def test_names_are_not_compared_row_by_row(spark):
    plan = QUERIES["name_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan.lower() and "Join" not in plan


def test_pairs_of_one_name_follow_one_another(monkeypatch):
    monkeypatch.setattr(edits, "ROWS", 1 << 9)
    names = [f"{k * 7919 % 1000:03d}" for k in range(500)]
    table = pa.table({"id": range(500), "name": names, "size": pa.array([3] * 500, pa.int32()), "kind": [k % 3 for k in range(500)], "asks": [k % 4 == 1 for k in range(500)]})
    other = table.set_column(4, "asks", pa.array([False] * 500))
    asked = table.filter(table["asks"])
    out = list(edits.later_names(pa.concat_tables([asked, other]).to_batches()))
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = {(a, b, 1 - plain_distance(names[a], names[b]) / 3) for a in range(1, 500, 4) for b in range(a + 1, 500) if a % 3 == b % 3}
    assert len(got) == len(want) and set(got) == want
    assert max(b.num_rows for b in out) < 1 << 10
    assert sum(x[1] != y[1] for x, y in zip(got, got[1:])) < len(got) / 8
