"""Sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_bits, id_text, spare, stored

#: Bits of a document's hash; a bucket that is too large with all of them holds equal rows or one long document.
BITS = 60
#: Bytes of text in a shard at most.
MAX_BYTES = 1 << 20
#: Bits looked at in one round beyond those that an even spread would need.
SPARE = 2


def _first(bits: int, column: str = "h"):
    return F.shiftright(column, BITS - bits)


def directory_of(keyed: DataFrame, max_bytes: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Buckets for rows of (h, n_bytes), looking at the first ``bits`` bits of h.

    Gives a row for each used slot of the directory (slot, depth, bucket, shard_bytes, shard_docs), and the slots whose
    bucket is still too large with all those bits. A bucket exists where its own bytes fit and those of its parent,
    one bit shorter, do not.
    """
    slots = stored(keyed.groupBy(_first(bits).alias("slot")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "shard-slots")
    up = slots.select("slot", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    up = up.withColumn("bucket", F.expr(f"shiftright(slot, {bits} - depth)"))
    sums = up.groupBy("depth", "bucket").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = sums.filter(F.col("shard_bytes") <= max_bytes)
    least = up.join(fits, ["depth", "bucket"]).groupBy("slot").agg(F.min(F.struct("depth", "bucket", "shard_bytes", "shard_docs")).alias("s"))
    found = stored(slots.join(least, "slot", "left").select("slot", "s.*"), "shard-directory")
    return found.filter(F.col("depth").isNotNull()), found.filter(F.col("depth").isNull()).select("slot")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES, part_copies: bool = False, carry: Column | None = None) -> DataFrame:
    """The shard of each document: doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs, oversize.

    shard_id is the bits that lead to the bucket ('*' for none). All documents start in one bucket; a bucket over
    ``max_bytes`` splits on the next bit of the hash of id and text. A bucket that is too large with all bits (one
    document longer than the limit, or rows that are equal in id and text) stays whole and is marked oversize.

    With ``part_copies`` the copies of a row that are equal in id and text are numbered, and numbers over 1 go into the
    hash, so that copies part too; this is for tables with few copies of each, as a mix has, since those of one row meet
    in one task.

    ``carry`` goes with each row to the result as the column ``row``, such as F.struct("*") for all of its columns.

    A null text has 0 bytes, a null id counts as ''. A long text is one row and never cut. Rows of one hash stay together,
    so there are no ties to break. Repeated rows are kept. Other columns are ignored; an empty table
    gives an empty result.
    """
    row = [] if carry is None else ["row"]
    keyed = docs.select(*([] if carry is None else [carry.alias("row")]), F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), hash_bits(id_text(F.col(doc_id)), F.coalesce(F.col(text), F.lit(""))).alias("h"))
    if part_copies:
        number = F.row_number().over(Window.partitionBy("h", "doc_id").orderBy("n_bytes"))
        keyed = keyed.withColumn("k", number).select(*row, "doc_id", "n_bytes", F.when(F.col("k") == 1, F.col("h")).otherwise(hash_bits(F.col("h").cast("string"), F.col("k").cast("string"))).alias("h"))
    keyed = stored(keyed, "shard-keys")
    total = keyed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / max_bytes)))) + SPARE)
    parts, todo = [], keyed
    while True:
        found, over = directory_of(todo.select("h", "n_bytes"), max_bytes, bits)
        parts.append(todo.withColumn("slot", _first(bits)).join(found, "slot").select(*row, "doc_id", "n_bytes", "depth", "bucket", "shard_bytes", "shard_docs", F.lit(False).alias("oversize")))
        if over.isEmpty():
            break
        todo = todo.withColumn("slot", _first(bits)).join(over, "slot", "left_semi").drop("slot")
        # bits do not part rows of one hash: a slot with a single hash is as small as it gets
        single = stored(todo.groupBy(_first(bits).alias("slot")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs")).filter("lo = hi"), "shard-single")
        parts.append(todo.withColumn("slot", _first(bits)).join(single, "slot").select(*row, "doc_id", "n_bytes", F.lit(bits).alias("depth"), F.col("slot").alias("bucket"), "shard_bytes", "shard_docs", F.lit(True).alias("oversize")))
        todo = todo.withColumn("slot", _first(bits)).join(single, "slot", "left_anti").drop("slot")
        if bits == BITS:
            break
        bits = min(BITS, bits + 8)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.lpad(F.bin("bucket"), F.col("depth"), F.lit("0")))
    return out.select(*row, "doc_id", "n_bytes", name.alias("shard_id"), "depth", "shard_bytes", "shard_docs", "oversize")


def sharded_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES, part_copies: bool = False) -> DataFrame:
    """Each row of ``docs`` once, whatever its ids and columns, with the columns of ``shard_documents`` behind its own.

    A column that the table has already gets underscores behind its name.
    """
    found = shard_documents(docs, doc_id, text, max_bytes, part_copies, carry=F.struct("*"))
    return found.select("row.*", *[F.col(c).alias(spare(docs.columns, c)) for c in found.columns if c not in ("row", "doc_id")])


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> None:
    """Writes the documents below ``path``, a folder shard_id=... for each shard; a column of that name stays beside it."""
    folder = spare(docs.columns, "shard_id")
    rows = sharded_rows(docs, doc_id, text, max_bytes).select(*docs.columns, folder)
    rows.repartition(folder).write.partitionBy(folder).parquet(path)


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: {docs} is the table to shard. Depths beyond 24 are not needed where this SQL runs.
SHARD_SQL = f"""
WITH keyed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), chr(31), coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM {{docs}}),
deep AS (SELECT *, d::INTEGER AS depth, h >> ({BITS} - d) AS bucket FROM keyed, range(0, 25) r(d)),
sums AS (SELECT depth, bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM deep GROUP BY ALL),
fits AS (SELECT * FROM deep JOIN sums USING (depth, bucket) WHERE shard_bytes <= {MAX_BYTES}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM fits)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(bucket), depth, '0') END AS shard_id, depth, shard_bytes, shard_docs, false AS oversize
FROM best WHERE k = 1
"""
SQL = {"op6_extendible_shards": SHARD_SQL.replace("{docs}", "documents")}
QUERIES = {"op6_extendible_shards": op6_extendible_shards}
