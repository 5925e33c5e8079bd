"""What several operators share: tables in the cluster's shared folder, word arrays and row keys."""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: ASCII white space, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_words(text: Column) -> Column:
    """Words of anything but ASCII white space, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def id_text(doc_id: Column) -> Column:
    """An id as text, '' for null."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def hash_bits(*parts: Column) -> Column:
    """The first 60 bits of an MD5 over the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return ((F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 12), 16, 10).cast("double")) + F.lit(0.5)) / F.lit(float(2**48))


@functools.cache
def _ship(application: str, add: Callable[[str], None]) -> None:
    package = Path(__file__).resolve().parents[1]
    add(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))


def with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, for sessions whose Python workers may lack this package: its source is sent to them once.

    Arrow batches that go to Python workers are bounded by bytes, so that long texts don't add up in one.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        _ship(spark.sparkContext.applicationId, spark.sparkContext.addPyFile)
        return query(spark, sf_dir)

    return run
