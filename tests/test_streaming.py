"""Streams over two runs: repeated and late events, ids that are kept in the checkpoint, counts by window."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larkspur.streaming import events as ingest

SCHEMA = "insert_id string, ts timestamp, event_type string, value double"
START = datetime(2026, 1, 1, 12)


def at(minutes):
    return START + timedelta(minutes=minutes)


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_once_over_two_runs(spark, tmp_path):
    source, table, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.into_table(ingest.once(stream, "1 hour"), table, check).awaitTermination()
        return Counter((r.insert_id if r.insert_id and len(r.insert_id) < 9 else None, r.value) for r in spark.read.parquet(table).collect())

    put(spark, [("a", at(0), "view", 1.0), ("a", at(1), "view", 1.0), ("b", at(5), "click", 2.0), (None, at(6), "view", 3.0), (" ", at(6), "view", 3.0)], source)
    assert run() == Counter({("a", 1.0): 1, ("b", 2.0): 1, (None, 3.0): 2})
    # a second run from the checkpoint knows a and b; c is new, and a late one of a new id is within the hour
    put(spark, [("a", at(20), "view", 1.0), ("b", at(5), "click", 2.0), ("c", at(30), "view", 4.0), ("d", at(10), "view", 5.0), ("c", at(31), "view", 4.0)], source)
    second = Counter({("a", 1.0): 1, ("b", 2.0): 1, (None, 3.0): 2, ("c", 4.0): 1, ("d", 5.0): 1})
    assert run() == second
    # nothing new, nothing changes
    assert run() == second
    # far ahead; afterwards what lies more than an hour back is too late to be taken
    put(spark, [("e", at(600), "view", 6.0)], source)
    run()
    put(spark, [("f", at(100), "view", 7.0), ("g", at(590), "view", 8.0)], source)
    assert run() == second + Counter({("e", 6.0): 1, ("g", 8.0): 1})


def test_counts_by_window(spark, tmp_path):
    put(spark, [("a", at(0), "view", 1.0), ("b", at(59), "view", 1.0), ("c", at(61), "view", 1.0), ("d", at(62), "click", 1.0)], f"{tmp_path}/in")
    counts = ingest.windowed_counts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.s, r.event_type): r.n for r in spark.table("windows").select(F.date_format("window.start", "HH:mm").alias("s"), "event_type", "n").collect()}
    assert got == {("12:00", "view"): 2, ("13:00", "view"): 1, ("13:00", "click"): 1}
