"""Lines and blocks of sheets are made where their runs were dealt to."""

import duckdb
from pyspark.sql import functions as F

from larkspur.operators import sheets
from larkspur.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
RUNS = "sheet int, run long, text string, x0 double, x1 double, y0 double, y1 double, size double"


def test_sheets_are_read_twice_and_joined_once(spark):
    for name in ("sheet_lines", "sheet_blocks"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 2 and plan.count("Join Inner") == 1


def test_spaces_are_those_of_a_line(spark):
    # two bands; the first is cut where the size changes, and a blank run keeps its place alone
    runs = [(1, 1, "Pie", 10.0, 30.0, 100.0, 110.0, 10.0), (1, 2, " ", 31.0, 33.0, 100.0, 110.0, 10.0), (1, 3, "night", 34.0, 60.0, 99.0, 109.0, 10.0), (1, 4, "BIG", 66.0, 80.0, 100.0, 110.0, 20.0), (1, 5, "$9", 10.0, 20.0, 80.0, 90.0, 10.0), (1, 6, "s", 21.0, 25.0, 80.0, 90.0, 10.0)]
    runs += [(None, 7, "lost", 1.0, 2.0, 1.0, 2.0, 1.0)]
    got = sheets.lines(sheets.columns(spark.createDataFrame(runs, RUNS), 600.0)).orderBy("line").collect()
    assert [(r.sheet, r.line, r.text) for r in got] == [(1, 0, "Pie night"), (1, 1, "BIG"), (1, 2, "$9s")]


def rows_and_sql_rows_of_repeated_runs(spark, folder, name):
    # runs twice in the same place, and runs whose second one lies in another column and so in another band
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    moved = rows.filter("l_partkey % 7 = 1").withColumn("l_suppkey", F.col("l_suppkey") + 1)
    rows.unionByName(rows.filter("l_partkey % 7 = 0")).unionByName(moved).write.parquet(f"{folder}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    want = c.sql(SQL[name])
    return sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*want.columns).collect()), sorted(want.fetchall())


def test_blocks_of_repeated_runs(spark, tmp_path):
    got, want = rows_and_sql_rows_of_repeated_runs(spark, str(tmp_path), "sheet_blocks")
    assert got == want


def test_lines_of_repeated_runs(spark, tmp_path):
    got, want = rows_and_sql_rows_of_repeated_runs(spark, str(tmp_path), "sheet_lines")
    assert got == want
