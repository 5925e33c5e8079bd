"""Queries over events as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.stored import shared_folder
from ..streaming import events as ingest
from .queries import query


@query("SELECT insert_id, 1::BIGINT AS n FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'e' || event_id // 2 END AS insert_id, user_id FROM events) WHERE insert_id IS NOT NULL GROUP BY insert_id UNION ALL SELECT NULL, sum(1 + event_id % 3)::BIGINT FROM events WHERE event_id % 10 = 0")
def events_once(c):
    """The events as a stream in which each comes up to three times and two share an id; those without one all stay."""
    table = c.table("events")
    folder = f"{shared_folder(c.spark).rstrip('/')}/events-once-{uuid.uuid4().hex}"
    # a file and a folder of files are both read as a stream over what lies in the tables' folder
    stream = c.spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(f"{c.folder}/events.parquet*")
    own = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("e"), (F.col("event_id") / 2).cast("long")))
    delivered = stream.select("ts", "user_id", "event_id", own.alias("insert_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)).alias("delivery"))
    named = delivered.withColumn("known", F.col("insert_id"))
    ingest.into_table(ingest.once(named, "3650 days").select("insert_id", "known"), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    kept = c.spark.read.schema("insert_id string, known string").parquet(f"{folder}/table")
    return kept.groupBy(F.col("known").alias("insert_id")).agg(F.count("*").alias("n"))
