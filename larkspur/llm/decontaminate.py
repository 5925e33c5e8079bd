"""Benchmark decontamination by a positional inverted index, with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Consecutive item words that make a match; a shorter item is one window.
WINDOW = 10
#: Rows of the item side that are sent to every executor at most (about 40 bytes each); beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def folded_words(text: Column) -> Column:
    """Words of ASCII letters and digits and any other characters, A-Z lower-cased; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its row count allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_table(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (a number of its own for each row), item_id as text, its words and its window length."""
    listed = items.select(id_text(F.col(item_id)).alias("item_id"), folded_words(F.col(text)).alias("q")).filter(F.size("q") > 0).distinct()
    return stored(listed.withColumn("item", F.xxhash64("item_id", F.array_join("q", " "))).withColumn("len", F.least(F.size("q"), F.lit(WINDOW))), "leak-items")


def keyed_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key (a hash of id and text; equal rows share it) and words of each document."""
    return docs.select(F.xxhash64(id_text(F.col(doc_id)), F.coalesce(F.col(text), F.lit(""))).alias("key"), folded_words(F.col(text)).alias("w"))


def postings(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index (h, key, pos) of the words whose hash is in ``terms`` (h)."""
    return words.select("key", F.posexplode("w").alias("pos", "term")).select(F.xxhash64("term").alias("h"), "key", "pos").join(_small(terms), "h", "left_semi")


def rarest_terms(table: DataFrame, words: DataFrame) -> DataFrame:
    """Per item window its two rarest terms by their count in the documents: item, h1, off1, h2, off2.

    A window of one word has it twice. Ties go to the smaller hash and offset.
    """
    terms = table.select("item", F.posexplode("q").alias("off", "term")).select("item", "off", F.xxhash64("term").alias("h"))
    counts = stored(postings(words, stored(terms.select("h").distinct(), "leak-vocabulary")).groupBy("h").agg(F.count(F.lit(1)).alias("n")), "leak-counts")
    per_item = terms.join(counts, "h", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("off", F.coalesce("n", F.lit(0)).alias("n"), "h"))).alias("t"))
    per_item = per_item.join(table.select("item", "len"), "item")
    by_count = F.transform("t", lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h"), x["off"].alias("off")))
    pairs = per_item.select("item", "len", by_count.alias("t")).select("item", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - F.col("len")), lambda s: F.slice(F.sort_array(F.slice("t", s + 1, F.col("len"))), 1, 2))).alias("r"))
    second = F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    found = pairs.select("item", F.get("r", F.lit(0))["n"].alias("n"), F.get("r", F.lit(0))["h"].alias("h1"), F.get("r", F.lit(0))["off"].alias("off1"), second["h"].alias("h2"), second["off"].alias("off2"))
    return found.filter("n > 0").drop("n").distinct()


def alignments(docs_words: DataFrame, rare: DataFrame, slop: int = 0) -> DataFrame:
    """(key, item, base): places where both rarest terms of a window stand at their offsets from base.

    The posting lists are shifted by the offsets and intersected. With ``slop`` the second term may be so many words
    away from its place.
    """
    rare = stored(rare, "leak-rare")
    index = stored(postings(docs_words, stored(rare.select(F.explode(F.array("h1", "h2")).alias("h")).distinct(), "leak-terms")), "leak-postings")
    first = index.join(_small(rare), index["h"] == rare["h1"]).select("key", "item", (F.col("pos") - F.col("off1")).alias("base"), "h2", "off2")
    shifts = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    first = first.select("key", "item", "base", F.col("h2").alias("h"), (F.col("base") + F.col("off2")).alias("due"), shifts.alias("shift")).withColumn("pos", F.col("due") + F.col("shift"))
    return stored(first.join(index, ["h", "key", "pos"], "left_semi").select("key", "item", "base").distinct(), "leak-alignments")


def exact_matches(docs: DataFrame, table: DataFrame, places: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, start, len) of every window of an item that occurs whole, checked word by word."""
    listed = places.groupBy("key").agg(F.collect_list(F.struct("item", "base")).alias("places"))
    hit = keyed_words(docs, doc_id, text).join(stored(listed, "leak-places"), "key")
    hit = hit.select("key", "w", F.explode("places").alias("p")).select("key", "w", F.col("p.item").alias("item"), F.col("p.base").alias("base")).join(_small(table), "item")
    same = lambda s: (F.col("base") + s >= 0) & (F.slice("w", F.greatest(F.col("base") + s, F.lit(0)) + 1, F.col("len")) == F.slice("q", s + 1, F.col("len")))
    starts = F.filter(F.sequence(F.lit(0), F.size("q") - F.col("len")), same)
    return hit.select("key", "item_id", "len", F.col("base"), F.explode(starts).alias("s")).select("key", "item_id", (F.col("base") + F.col("s")).alias("start"), "len")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key.

    A document word inside any whole occurrence of an item window is hit. Texts that are null or without words have
    none and match nothing; a null item id counts as ''; items with equal ids count once. Of equally rare
    terms the smaller hash is looked up, which changes no match; long texts are searched whole, a row's words at once.
    Repeated rows are judged
    each; other columns are ignored; with an empty table of documents the result is empty, with one of items nothing
    is hit.
    """
    table = item_table(items, item_id, item_text)
    words = keyed_words(docs, doc_id, text)
    found = exact_matches(docs, table, alignments(words, rarest_terms(table, words)), doc_id, text)
    ranges = F.transform(F.collect_set(F.struct("start", "len")), lambda r: F.sequence(r["start"], r["start"] + r["len"] - 1))
    hits = found.groupBy("key").agg(F.size(F.array_distinct(F.flatten(ranges))).cast("long").alias("hit"), F.sort_array(F.collect_set("item_id")).alias("ids"))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(id_text(F.col(doc_id)), F.coalesce(F.col(text), F.lit(""))).alias("key"), F.size(folded_words(F.col(text))).cast("long").alias("n_words"))
    joined = sized.join(stored(hits, "leak-hits"), "key", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"), "key")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, position): places where the two rarest terms of an item window stand within ``slop`` words of their distance."""
    table = item_table(items, item_id, item_text)
    words = keyed_words(docs, doc_id, text)
    places = alignments(words, rarest_terms(table, words), slop)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(id_text(F.col(doc_id)), F.coalesce(F.col(text), F.lit(""))).alias("key"))
    return places.join(ids, "key").join(_small(table.select("item", "item_id")), "item").select("doc_id", "item_id", F.col("base").alias("position"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")


#: {docs} is the table to check.
LEAK_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
bw AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS q FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(q), 10) AS l, array_to_string(q[s + 1 : s + least(len(q), 10)], ' ') AS g FROM (SELECT item_id, q, unnest(range(0, len(q) - least(len(q), 10) + 1)) AS s FROM bw WHERE len(q) > 0)),
ls AS (SELECT DISTINCT l FROM bg),
dg AS (SELECT doc_id, s, l, array_to_string(w[s + 1 : s + l], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM dw, ls WHERE len(w) >= l)),
m AS (SELECT doc_id, s, l, item_id FROM dg JOIN bg USING (l, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
SQL = {"op8_decontaminate": LEAK_SQL.replace("{docs}", "documents")}
QUERIES = {"op8_decontaminate": op8_decontaminate}
