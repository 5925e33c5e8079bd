"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, stored

#: Fewest code points and occurrences of a word, and by how much a form must outnumber the word.
LENGTH, LEAST, RATIO = 7, 2, 10
#: Letters of a run.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Index rows of one segment that a task compares with a probe; a segment of more is dealt to several.
PART = 1024


def runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The maximal runs of at least ``length`` letters of each text, A-Z lower-cased, beside their document's id.

    A null text has none. A greedy match of ``length`` or more starts at a run's first letter and ends at its last, as
    matches are searched from the left, so runs that are too short are passed over within the expression.
    """
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"{LETTERS}{{{length},}}"), F.lit(0))
    each = docs.select(id_text(F.col("doc_id")).alias("id"), F.explode(found).alias("run"))
    return each.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))


def word_counts(each: DataFrame, word: Column, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points and ``least`` occurrences; counts combine before the shuffle."""
    return each.select(word.alias("word")).filter(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _segment(word: Column, length: Column, of: Column, i: int) -> tuple[Column, Column, Column]:
    """Segment ``i`` of words of length ``of`` as it lies in ``word``, and the first and the last letter outside it."""
    half = (of / 2).cast("int")
    tail = of - half
    if i == 1:
        return word.substr(F.lit(1), half), word.substr(half + 1, F.lit(1)), word.substr(length, F.lit(1))
    return word.substr(length - tail + 1, tail), word.substr(F.lit(1), F.lit(1)), word.substr(length - tail, F.lit(1))


def _rows(words: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """A row for each word, segment and indexed length; ``lengths`` are relative to the word's own."""
    word, length = F.col("word"), F.char_length("word")
    structs = []
    for less in lengths:
        for i in (1, 2):
            seg, first, last = _segment(word, length, length - less, i)
            structs.append(F.struct((length - less).alias("of"), F.lit(i).alias("i"), seg.alias("seg"), F.ascii(first).alias("first"), F.ascii(last).alias("last"), F.lit(less).alias("less")))
    letters = F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))
    return words.select("word", "n", letters.alias("letters"), F.explode(F.array(*structs)).alias("s")).select("word", "n", "letters", "s.*")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b), each once, of words that differ by exactly one inserted, deleted or replaced code point.

    A word of length l is indexed by its first floor(l/2) code points and by the rest. One edit leaves one of the two
    whole: at the same place in a word of equal length, and in a word of one more either at the start or, shifted by
    one, at the end. So each word probes its own length and the one below with two substrings each. A pair found by both
    segments counts for the first; the edit itself is verified on what is left by two exact bounds: the first or the
    last letter outside the segment is the same, and at most two letters of the alphabet come or go. Segments that are
    indexed over PART times are dealt to several tasks: index rows by their word's hash, probes to each.
    """
    index, probe = _rows(words, (0,)).drop("less"), _rows(words, (0, 1))
    key = ["of", "i", "seg"]
    hot = stored(index.groupBy(*key).agg(F.count("*").alias("rows")).filter(F.col("rows") > PART).select(*key, F.ceil(F.col("rows") / PART).cast("int").alias("parts")), "spelling-hot")
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).drop("parts")
    probe = probe.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    x, y = index.alias("x"), probe.alias("y")
    a, b = F.col("x.word"), F.col("y.word")
    same = F.col("y.less") == 0
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*key, "part")]
    cheap = ((F.col("x.first") == F.col("y.first")) | (F.col("x.last") == F.col("y.last"))) & (F.bit_count(F.col("x.letters").bitwiseXOR(F.col("y.letters"))) <= 2) & (~same | (a < b))
    again = ~same & (F.col("x.i") == 2) & F.startswith(b, a.substr(F.lit(1), (F.col("x.of") / 2).cast("int")))
    pairs = x.join(y, [*on, cheap, F.levenshtein(a, b, 1) == 1, ~again])
    return pairs.select(a.alias("a"), F.col("x.n").alias("n_a"), b.alias("b"), F.col("y.n").alias("n_b"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each row of ``words`` (word, n; words differ) with its near words' number, its form and the root of its forms.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio``
    times the word's; forms are followed to the last, in about log2 rounds over the forms that have forms themselves,
    each a stored table. A word without near words has n_near 0, no form, and itself as root. An empty table gives an
    empty result.
    """
    words = stored(words, "spelling-words")
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "spelling-found")
    links = found.filter(F.col("form").isNotNull()).select("word", "form")
    chain = links.join(links.select(F.col("form").alias("word")).distinct(), "word", "left_semi")
    while True:  # each round doubles the steps that are taken; n grows by the ratio with each, so there are few
        chain = stored(chain, "spelling-chain")
        on = chain.select(F.col("word").alias("form"), F.col("form").alias("further"))
        if chain.join(on, "form", "left_semi").isEmpty():
            break
        chain = chain.join(on, "form", "left").select("word", F.coalesce("further", "form").alias("form"))
    last = chain.select(F.col("word").alias("form"), F.col("form").alias("last"))
    return found.join(last, "form", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("last", "form", "word").alias("root"))


def misspelt(each: DataFrame) -> Column:
    """The run without one code point where 31 divides the CRC-32 of ``<id>:<run>``, else the run."""
    run, length = F.col("run"), F.char_length("run")
    crc = F.crc32(F.concat_ws(":", "id", "run"))
    at = F.pmod(crc, length).cast("int")
    return F.when(crc % 31 == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, length))).otherwise(run)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with planted slips, and the forms that they are variants of.

    Null texts have no words; a null id is written as nothing; repeated rows count again. Ties between forms go to the
    smaller word; long texts are read whole; other columns are not read, whatever their names. An empty table gives an
    empty result.
    """
    each = runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spelling_variants(word_counts(each, misspelt(each)))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
#: CRC-32 by its table of 256 entries, near words by the ways of leaving out or replacing one code point.
SQL = {
    "op13_spelling_variants": r"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (
  SELECT run, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM r, crc
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h
), words AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) AS head, substr(word, p + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.p = b.p AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.head || a.tail
), best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
found AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words LEFT JOIN best ON best.word = words.word
), walk AS (
  SELECT word, word AS root FROM found UNION SELECT walk.word, found.form FROM walk JOIN found ON found.word = walk.root WHERE found.form IS NOT NULL
)
SELECT found.word, found.n, found.n_near, found.form, found.form_n, walk.root
FROM found JOIN walk ON walk.word = found.word JOIN found last ON last.word = walk.root AND last.form IS NULL"""
}
