"""Event ingest, the same for batches and streams: validation, projection, fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Types that are taken.
KNOWN_TYPES = ("view", "click", "purchase", "signup", "search")


def problems(known: tuple[str, ...] = KNOWN_TYPES) -> Column:
    """Why an event is rejected, or null."""
    v = F.col("value")
    return F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(*known), "type").when(F.col("user_id").isNull(), "user").when(F.get_json_object("props", "$").isNull(), "properties").when(v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf"))), "value")


def validated(events: DataFrame) -> DataFrame:
    return events.withColumn("problem", problems())


def projected(events: DataFrame) -> DataFrame:
    """Search rows: user, day 1 to 7 or null, minute of the day; days out of range drop the event."""
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.when(k % 9 > 0, k % 9)
    return events.select("event_id", "user_id", "event_type", day.alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute")).filter(F.col("day").isNull() | F.col("day").between(1, 7))


def fan_out(events: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, failed: Callable[[int, Exception], None]) -> StreamingQuery:
    """Each micro-batch to every sink; a sink that fails is reported and does not keep the others from theirs."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                try:
                    sink(batch, number)
                except Exception as e:  # noqa: BLE001  reported, and the next sink goes on
                    failed(number, e)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and type, with a watermark (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))


def identified(events: DataFrame, insert_id: str = "insert_id") -> DataFrame:
    """Events with an id for each delivery: their own, or a new one, so that an event without an id is never a repeat."""
    own = F.nullif(F.trim(F.col(insert_id)), F.lit(""))
    return events.withColumn(insert_id, F.coalesce(own, F.uuid()))


def once(events: DataFrame, late: str = "2 hours", insert_id: str = "insert_id") -> DataFrame:
    """A stream of events without repeated deliveries of an id, as long as they come within ``late`` of the first one.

    The ids that were seen are the query's state: they go with the watermark, and come back from the checkpoint.
    """
    return identified(events, insert_id).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([insert_id])


def into_table(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended to a Parquet table; a run from the same checkpoint goes on where the last one ended."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
