"""Work on narrow tables is dealt to many tasks, though one task reads them."""

import pytest

from larkspur.operators import search
from larkspur.plans.queries import QUERIES
from larkspur.sources.stored import tasks

FOLDER = "/root/testdata/sf0.001"
SPREAD = ["name_similarity"]


@pytest.mark.parametrize("name", SPREAD)
def test_many_tasks(spark, name):
    assert QUERIES[name](spark, FOLDER).rdd.getNumPartitions() >= tasks(spark)


@pytest.mark.parametrize("name", ["unique_slugs", "paths_read", "paths_written"])
def test_dealt_out_before_the_work(spark, name):
    assert "REPARTITION_BY_NUM" in QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_name_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "PART", 7)
    names = ["Žofín bar", "Žofín", "Žofie", "Žofín bars", "Žo", "Žofíé x", "Žofín b\U0001f37a", None]
    rows = [(k, names[k * 5 % 8], "ab"[k % 2] if k % 9 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, name string, place string")
    got = {(r.id, r.other_id): None if r.similarity is None else round(r.similarity, 9) for r in search.name_pairs(df.filter("id % 3 = 0"), df, "place").collect()}
    both = lambda a, b: None if a is None or b is None else round(1 - plain_distance(a, b) / max(len(a), len(b)), 9)
    assert got == {(i, j): both(a, b) for i, a, p in rows if i % 3 == 0 for j, b, q in rows if i < j and p == q and p}


def test_fuzzy_scores_are_made_where_names_were_dealt(spark):
    plan = QUERIES["venue_fuzzy_search"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("Generate") < plan.find("RepartitionByExpression") and "array_intersect" not in plan[plan.find("RepartitionByExpression") :]


def optimized(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_processed_deals_are_dealt_out_before_the_work(spark):
    plan = optimized(spark, "processed_deals")
    assert "RepartitionByExpression" in plan and "Generate" not in plan[plan.find("RepartitionByExpression") :]


def test_phrases_are_not_read_where_lines_are(spark):
    of_lines = [x for x in optimized(spark, "time_phrases").splitlines() if "l_quantity" in x]
    assert of_lines and not any("regexp" in x or "RLIKE" in x for x in of_lines)


def test_clamped_schedules_are_dealt_to_many_tasks(spark):
    df = QUERIES["clamp_to_hours"](spark, FOLDER)
    assert "BroadcastHashJoin LeftOuter" not in " ".join(df._jdf.queryExecution().executedPlan().toString().replace(",", "").split()) and "strategy=merge" in df._jdf.queryExecution().analyzed().toString()
    assert df.rdd.getNumPartitions() >= tasks(spark)
