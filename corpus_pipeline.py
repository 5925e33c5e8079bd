"""From raw documents to shards: quality rules, near duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import id_text, spare, stored, with_package
from larkspur.llm.decontaminate import decontaminate
from larkspur.llm.jaccard import near_duplicates
from larkspur.llm.mixing import mix_sources
from larkspur.llm.quality import quality_rules
from larkspur.llm.sharding import sharded_rows


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The documents with the key that the operators give them, in a column ``name`` that they lack."""
    return docs.withColumn(name, F.xxhash64(id_text(F.col("doc_id")), F.coalesce("text", F.lit(""))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go.

    A null or empty text has no words and goes; repeated rows are judged alike; all columns are kept, whatever their
    names, by carrying the row as a whole; long texts are judged whole. An empty table gives an empty result.
    """
    judged = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=F.struct("*"))
    return judged.filter("kept").select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id.

    Repeated rows become one. Texts that are null or without words, if any come here, are classes of their own. Ties (one
    id, different texts) go to the least hash of id and text. Long texts are compared whole. An empty table gives an
    empty result.
    """
    classes = stored(near_duplicates(docs).select("key", "keeper"), "pipeline-classes")
    key = spare(docs.columns, "key")
    losers = stored(classes.filter(~F.col("keeper")).select(F.col("key").alias(key)).distinct(), "pipeline-losers")
    # rows that are repeated share a key, by which the join has dealt them
    return _keyed(docs, key).join(losers.hint("merge"), key, "left_anti").dropDuplicates([key]).drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts hold none and stay; repeated rows go or stay together; long texts are searched whole. An empty
    table gives an empty result.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = spare(docs.columns, "key")
    leaks = stored(found.filter("contaminated").select(F.col("key").alias(key)).distinct(), "pipeline-leaks")
    return _keyed(docs, key).join(leaks.hint("merge"), key, "left_anti").drop(key)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one that a source's budget cuts counts as a whole.

    Documents of no words are not taken; repeated rows count as one document; a long text is taken whole or not at all.
    Ties in the order are broken by the mix's own keys. An empty table gives an empty result.
    """
    taken = mix_sources(docs).filter("taken > 0").select("key", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = stored(taken, "pipeline-taken")
    key, often = spare(docs.columns, "key"), spare(docs.columns, "often")
    times = taken.groupBy(F.col("key").alias(key)).agg(F.sum("times").cast("int").alias(often))
    copies = _keyed(docs, key).dropDuplicates([key]).join(times.hint("merge"), key)
    return copies.withColumn(often, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of the mix with its shard; copies of a document part, as one of 350 KB taken three times fits no shard.

    All columns stay, whatever their names. Rows of null or empty texts have 0 bytes; a text over the limit is marked.
    An empty table gives an empty result.
    """
    return sharded_rows(docs, part_copies=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Rules are learned and similarities verified on sets, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; each one's result is a stored table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs


run = with_package(run)
