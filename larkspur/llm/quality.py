"""Quality rules: document statistics and a decision list learned from labels, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, plain_words, stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fewest words, and the largest share (in per cent) of words in repeated windows, of a document that passes.
MIN_WORDS = 50
MAX_REPEAT = 50

#: What conditions may look at.
FEATURES = ("n_words", "mean_word", "symbol_share", "bang_share", "dup_line_share", "repeat_share")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words of each document.

    Words hold anything but ASCII white space; a null text has none. A line counts if it has a word. Windows of three
    words are compared by a 64-bit hash within their document. ``carry`` comes along as the column row.
    """
    row = F.lit(None).cast("boolean") if carry is None else carry
    d = docs.select(row.alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("row", "doc_id", "t", plain_words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"))
    d = d.select(
        "row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), _without(F.col("t"), BLANKS).cast("long").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"), (F.length("t") - _without(F.col("t"), "!")).cast("long").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    hashes = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    d = d.withColumn("g", F.slice(hashes, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))).drop("w")
    # most texts repeat no window; only the others are sorted
    d = d.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))).drop("g")
    # in the sorted list, equal windows are neighbours
    twin = F.filter("s", lambda x, j: (F.get("s", j - 1)["g"] == x["g"]) | (F.get("s", j + 1)["g"] == x["g"]))
    d = d.withColumn("at", F.sort_array(F.transform(twin, lambda x: x["i"]))).drop("s")
    gained = F.transform("at", lambda x, j: F.least(F.lit(3), F.get("at", j + 1) - x))
    d = d.withColumn("n_repeat_words", F.aggregate(gained, F.lit(0), lambda a, x: a + x).cast("long")).drop("at")
    return d.drop("row") if carry is None else d


def features() -> dict[str, Column]:
    """FEATURES as expressions over the columns of statistics()."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "bang_share": share("n_bangs", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def column(self) -> Column:
        return features()[self.feature] >= self.value if self.at_least else features()[self.feature] < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:.6g}"


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn_rules(labelled: DataFrame, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.95, min_share: float = 0.005, cuts: int = 24) -> list[Rule]:
    """A decision list for bad documents, by sequential covering.

    ``labelled`` has the columns of statistics() and ``bad``. Two thirds of the rows (by a hash of the id) grow each
    rule, condition by condition, by FOIL's gain; the other third prunes it to the prefix with the best worth. A rule
    counts if its precision on all rows not yet covered reaches ``min_precision`` and it finds ``min_share`` of the bad
    rows. Thresholds are quantiles of either class. Counts are made by Spark for all features and thresholds at once;
    only those counts (features x cuts) come to the driver. Without rows of both classes there are no rules.
    """
    values = features()
    labelled = labelled.filter(F.col("bad").isNotNull())
    steps = [(k + 0.5) / cuts for k in range(cuts)]
    asked = [F.percentile_approx(F.when(F.col("bad") == side, values[f]), steps, 10_000).alias(f"{f}_{side}") for f in FEATURES for side in (True, False)]
    row = labelled.agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"), *asked).first()
    if not row["n_bad"] or not row["n_good"]:
        return []
    edges = {f: sorted(set(row[f"{f}_True"]) | set(row[f"{f}_False"])) for f in FEATURES}
    bin_of = lambda f: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[f]]), lambda e: e <= values[f]))
    bins = [bin_of(f) for f in FEATURES]
    rows = stored(labelled.select(F.array(*bins).alias("bins"), "bad", (F.crc32(id_text(F.col("doc_id"))) % 3 == 0).alias("prune")).groupBy("bins", "bad", "prune").agg(F.count(F.lit(1)).alias("n")).coalesce(4), "quality-rows")

    def inside(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            b, k = F.get("bins", F.lit(FEATURES.index(c.feature))), edges[c.feature].index(c.value) + 1
            out = out & (b >= k if c.at_least else b < k)
        return out

    n = lambda bad, where=F.lit(True): F.coalesce(F.sum(F.when((F.col("bad") == bad) & where, F.col("n"))), F.lit(0))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        open_rows = rows
        for r in rules:
            open_rows = open_rows.filter(~inside(r))
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts = open_rows.filter(~F.col("prune") & inside(rule)).select("bad", "n", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(n(True).alias("p"), n(False).alias("q")).collect()
            p0, q0 = (sum(c[k] for c in counts if c["f"] == 0) for k in ("p", "q"))
            if not p0 or not q0:
                break
            best = (0.0, None)
            for i, f in enumerate(FEATURES):
                mine = {c["bin"]: (c["p"], c["q"]) for c in counts if c["f"] == i}
                for k, e in enumerate(edges[f], 1):
                    p = sum(v[0] for b, v in mine.items() if b >= k)
                    q = sum(v[1] for b, v in mine.items() if b >= k)
                    for up, a, b in ((True, p, q), (False, p0 - p, q0 - q)):
                        gain = a * (math.log2((a + 0.5) / (a + b + 1)) - math.log2((p0 + 0.5) / (p0 + q0 + 1))) if a else 0.0
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(f, up, e))
            if best[1] is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        tried = [rule[:k] for k in range(1, len(rule) + 1)]
        pruning = open_rows.agg(*[n(bad, F.col("prune") & inside(t)).alias(f"{k}_{bad}") for k, t in enumerate(tried) for bad in (True, False)]).first()
        worth = lambda k: (pruning[f"{k}_True"] - pruning[f"{k}_False"]) / (pruning[f"{k}_True"] + pruning[f"{k}_False"] or 1)
        rule = tried[max(range(len(tried)), key=lambda k: (worth(k), -k))]
        got = open_rows.agg(n(True, inside(rule)).alias("p"), n(False, inside(rule)).alias("q")).first()
        if got["p"] < max(3, min_share * row["n_bad"]) or got["p"] / (got["p"] + got["q"]) < min_precision:
            break
        rules.append(rule)
    return rules


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (the first rule that rejects the document, or null) and kept to statistics()."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        verdict = F.when(rule_column(r), F.lit(" and ".join(map(str, r)))).otherwise(verdict)
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Column | None = None) -> DataFrame:
    """Statistics and verdict of each document; the rules are learned from ``labels`` (doc_id, quality: 0 is bad).

    Labels without a quality, with a null id, or of other documents are not used; a document with several labels is bad
    if any says so. A null or empty text has no words and fails the base rule. Long texts
    are counted whole, a row's words at once. Repeated rows are judged each; other
    columns are ignored; an empty table gives an empty result. ``carry`` comes along as the column row.
    """
    stats = stored(statistics(docs, doc_id, text, carry), "quality-stats")
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return judge(stats, learn_rules(stats.drop("row").join(marks, "doc_id")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


SQL: dict[str, str] = {}  # the rules are learned, which SQL can't express
QUERIES = {"op3_quality_rules": op3_quality_rules}
