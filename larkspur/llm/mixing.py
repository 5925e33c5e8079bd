"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, plain_words, stored, uniform

#: Weights given to the sources in order of their names, again and again.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MOST_EPOCHS = 3
#: Documents of one source that are sorted together.
ROWS_TO_SORT = 20_000


def symbol_quality(text: Column) -> Column:
    """A quality weight in [0.1, 1]: the share of characters that are not symbols; 1 for an empty text."""
    whole = F.length(F.coalesce(text, F.lit("")))
    kept = F.length(F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>", ""))
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), kept / whole))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS) -> DataFrame:
    """A target for each row of (source, source_size, n_docs), which has one row for each source.

    The total is shared by weight; a source stops at ``cap`` times its size, and the excess goes to the others by
    weight until none is above. In order of cap / weight the capped sources come first, so the level that the others
    reach follows from sums over the sources before and from here on.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * cap)
        .withColumn("room", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("place", F.row_number().over(by_room))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("holds", F.col("left") <= F.col("room") * F.col("open_weight"))
        .withColumn("first", F.min(F.when(F.col("holds"), F.col("place"))).over(everything))
        .withColumn("level_left", F.max(F.when(F.col("place") == F.col("first"), F.col("left"))).over(everything))
        .withColumn("level_weight", F.max(F.when(F.col("place") == F.col("first"), F.col("open_weight"))).over(everything))
    )
    target = F.when(F.col("place") < F.col("first"), F.col("limit").cast("double")).otherwise(F.col("level_left") * F.col("weight") / F.col("level_weight"))
    return listed.select("source", "source_size", "n_docs", target.alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS, rows_to_sort: int = ROWS_TO_SORT) -> DataFrame:
    """How many words the mix takes of each document: doc_id, source, size, source_size, target, taken, quality, key.

    A source's target is met by complete epochs over all its documents first. What is left is taken in order of
    Efraimidis-Spirakis keys (-ln(u) / quality, u from a hash of id and text, so reruns agree) until the budget ends;
    the last document gives only the words that are still missing.

    A null text has size 0; null sources are one source, last in order; sources without words have target 0. Repeated
    rows are documents of their own. Equal keys are ordered by id. Other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    body, q = F.col(text), (symbol_quality(F.col(text)) if quality is None else quality)
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(plain_words(body)).cast("long").alias("size"), q.cast("double").alias("quality"),
        uniform(id_text(F.col(doc_id)), F.coalesce(body, F.lit(""))).alias("u"),
        F.xxhash64(id_text(F.col(doc_id)), F.coalesce(body, F.lit(""))).alias("of_text"),
    )
    slim = slim.withColumn("quality", F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(1e-6)))
    slim = stored(slim.select("doc_id", "source", "size", "quality", "of_text", (-F.log("u") / F.col("quality")).alias("key")), "mix-keys")
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, cap)
    targets = stored(
        targets.select(
            F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("n_docs") / rows_to_sort).alias("parts"),
            F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
        ).withColumn("budget", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")).coalesce(1),
        "mix-targets",
    )
    # a source's keys are cut into ranges of about equal share, so that no range grows with the source
    share = F.floor(F.col("parts") * (F.lit(1.0) - F.exp(-F.col("key"))))
    placed = slim.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("part", F.least(share, F.col("parts") - 1)).drop("of", "parts")
    sums = placed.groupBy(F.col("source").alias("of"), F.col("part").alias("in_part")).agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("of").orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", "in_part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("before_part"))
    within = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("before_doc", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = ranked.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before_part") - F.col("before_doc")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + rest).cast("long").alias("taken"), "quality", F.col("of_text").alias("key"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: Shared with the pipeline's SQL: {docs} is the table to mix.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, length(translate(text, '#*$%&|<>', '')) / length(text)) END AS quality,
    (('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), chr(31), coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM {docs}),
keyed AS (SELECT *, -ln(u) / quality AS key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
rooms AS (SELECT *, source_size * 3 AS lim, source_size * 3 / weight AS room, sum(source_size) OVER () AS total FROM weighted),
placed AS (SELECT *, row_number() OVER w AS place,
    total - coalesce(sum(lim) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM rooms WINDOW w AS (ORDER BY room, source NULLS LAST)),
level AS (SELECT place AS first, rest AS level_rest, open_weight AS level_weight FROM placed WHERE rest <= room * open_weight ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN place < first THEN lim::DOUBLE ELSE level_rest::DOUBLE * weight / level_weight END AS target FROM placed, level),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
ranked AS (SELECT k.*, source_size, target, epochs, round(target)::BIGINT - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM ranked
"""
SQL = {"op9_mix_sources": MIX_SQL.replace("{docs}", "documents")}
QUERIES = {"op9_mix_sources": op9_mix_sources}
