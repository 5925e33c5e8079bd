"""Intermediate tables of jobs that go in rounds: lineage ends there, so a lost executor repeats one round at most. Rows dealt out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="larkspur-"))
    return spark.conf.get("spark.checkpoint.dir")


def tasks(spark: SparkSession) -> int:
    """Tasks that rows are dealt to before work that takes long for a row."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all cores by these columns, or by all of them: a table of narrow rows is a row group or two, which one
    task reads, and would do all further work on."""
    return rows.repartition(tasks(rows.sparkSession), *(by or rows.columns))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
