"""Products that deal texts name, and the prices that stand by them, as joins and windows over spans of words."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases in which a product's word means something else. Fixed values.
IGNORED = ("chips down", "beer battered", "red wine jus", "prize pool", "pot of cash")
#: A line from "with" on names side dishes, unless a price follows at once. Fixed values.
SIDES = r"\b(?:with|w/)(?!\s*\$\d)[^\n]*"
#: Amounts that are taken off a price, after and before the figure. Fixed values.
OFF_AFTER, OFF_BEFORE = r"\s*(?:off|discount|savings?)\b", r"\bsave(?:\s+up\s+to)?\s*"
#: What joins the products that share a price. Fixed values.
JOINED = r"\s*+(?:,\s*+(?:and\s++)?+|&\s*+|and\s++)"
AMOUNT = r"\d+(?:\.\d{1,2})?"
PLURAL = r"(?:es(?![a-z0-9])|s(?![a-z0-9]))?"
PIECES = "[a-z0-9]+|[^a-z0-9]+"
#: Most names of a catalogue: its rows go to every task.
MAX_NAMES = 20_000
#: Stands for a dollar sign that begins no price.
NO_PRICE = "\ue000"


@dataclass(frozen=True)
class Product:
    """An entry of the catalogue; names begin and end with a letter or digit and don't hold the word "with"."""

    name: str
    rank: int | None = None
    synonyms: Sequence[str] = ()
    icon: str | None = None
    match: bool = True
    priced: bool = True

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(n.lower() for n in (self.name, *self.synonyms) if n))


def names_table(spark: SparkSession, catalogue: Sequence[Product], ignored: Sequence[str] = IGNORED) -> DataFrame:
    """Each way of writing a name or an ignored phrase, with plurals: written, pieces, product (null if ignored), place.

    ``place`` orders products: by rank, those without one last, then longer names, then as listed. Products without an
    icon or with ``match`` off are never looked for. Raises ValueError for names that the search can't find and for more
    than MAX_NAMES ways of writing.
    """
    wanted = sorted((p for p in catalogue if p.icon and p.match), key=lambda p: (p.rank is None, p.rank or 0, -len(p.name)))
    listed = [(n, None, -1) for n in ignored] + [(n, p.name.lower(), k) for k, p in enumerate(wanted) for n in p.names]
    bad = [n for n, _, _ in listed if not re.fullmatch("(?s)[a-z0-9](?:.*[a-z0-9])?", n) or "\n" in n or re.search(r"\bwith", n)]
    if bad:
        raise ValueError(f"Names that can't be found: {bad}")
    rows = {(n + end, len(re.findall(PIECES, n)), product, place) for n, product, place in listed for end in ("", "s", "es")}
    if len(rows) > MAX_NAMES:
        raise ValueError(f"Too many names (max {MAX_NAMES})")
    return spark.createDataFrame(sorted(rows, key=str), "written string, pieces int, product string, place int")


def product_spans(texts: DataFrame, key: str, text: str, catalogue: Sequence[Product], ignored: Sequence[str] = IGNORED) -> DataFrame:
    """(key, product, place, at, pieces): products that a text names as whole words, by their place among its pieces.

    A span within a longer one, or within an ignored phrase, goes; of equal spans the product that comes first stays.
    Only the words at which a name can begin are exploded, so what is shuffled are the hits. Null texts have none; equal
    keys are one text's.
    """
    names = names_table(texts.sparkSession, catalogue, ignored)
    ways = [(n + end, n) for n in {*ignored, *(n for p in catalogue if p.icon and p.match for n in p.names)} for end in ("", "s", "es")]
    firsts = sorted({re.match("[a-z0-9]+", way)[0] for way, _ in ways})
    sizes = sorted({len(re.findall(PIECES, n)) for _, n in ways})
    lower = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), SIDES, "")
    split = F.regexp_extract_all(lower, F.lit(PIECES), F.lit(0))

    def begun(pieces: Column) -> Column:
        places = F.filter(F.transform(pieces, lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())
        # pieces are taken one by one, as slice() copies the whole array each time
        written = lambda i, m: F.concat(*[F.coalesce(F.get(pieces, i + j), F.lit("")) for j in range(m)])
        phrase = lambda i: F.array(*[F.struct(i.alias("at"), F.lit(m).alias("pieces"), written(i, m).alias("written")) for m in sizes])
        return F.flatten(F.transform(places, phrase))

    # the pieces are made once in a row, and bound to the expression that uses them
    phrases = texts.select(key, F.explode(F.get(F.transform(F.array(split), begun), F.lit(0))).alias("p")).select(key, "p.*")
    hits = phrases.join(F.broadcast(names), ["written", "pieces"])
    before = Window.partitionBy(key).orderBy("at", F.col("pieces").desc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("at") + F.col("pieces")
    kept = hits.withColumn("_covered", F.coalesce(F.max(ends).over(before) >= ends, F.lit(False)))
    return kept.filter(~F.col("_covered") & F.col("product").isNotNull()).select(key, "product", "place", "at", "pieces")


def match_products(deals: DataFrame, key: str, title: str, details: str, catalogue: Sequence[Product], together: bool = False) -> DataFrame:
    """(key, product, place) of each deal, once.

    The title's products, and only if it has none those of the details; ``together``: those of both as one text, but the
    title's alone if it says "bottomless" and the catalogue has that.
    """
    titles = product_spans(deals, key, title, catalogue).groupBy(key, "product", "place").agg(F.lit(0).alias("_part"))
    if together:
        # the title may say it within a longer name, so names are looked for one by one
        alone = [p for p in catalogue if p.name.lower() == "bottomless"]
        said = product_spans(deals, key, title, alone).select(key).distinct() if alone else titles.select(key).limit(0)
        both = deals.select(key, F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(details, F.lit(""))).alias("_text"))
        rest = product_spans(both.join(said, key, "left_anti"), key, "_text", catalogue).groupBy(key, "product", "place").agg(F.lit(1).alias("_part"))
        return titles.join(said, key, "left_semi").unionByName(rest).drop("_part")
    rest = product_spans(deals, key, details, catalogue).groupBy(key, "product", "place").agg(F.lit(1).alias("_part"))
    first = F.min("_part").over(Window.partitionBy(key))
    return titles.unionByName(rest).withColumn("_first", first).filter("_part = _first").drop("_part", "_first")


def _prices(text: Column) -> Column:
    """Array of (price, after, before) of a text's prices: what follows up to the next dollar sign, what precedes since the last price."""
    t = F.regexp_replace(text, r"\$(?!\d)", NO_PRICE)
    t = F.regexp_replace(t, rf"\$(?={AMOUNT}{OFF_AFTER})", NO_PRICE)
    t = F.regexp_replace(t, rf"({OFF_BEFORE})\$(?=\d)", rf"$1{NO_PRICE}")
    tail = lambda s: F.regexp_replace(s, f"^{AMOUNT}", "")

    def listed(parts: Column) -> Column:
        return F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda s, j: F.struct(
                F.regexp_extract(s, f"^{AMOUNT}", 0).cast("double").alias("price"),
                F.substring_index(tail(s), NO_PRICE, 1).alias("after"),
                F.when(j == 0, F.get(parts, j)).otherwise(tail(F.get(parts, j))).alias("before"),
            ),
        )

    return F.get(F.transform(F.array(F.split(t, r"\$")), listed), F.lit(0))


def price_products(deals: DataFrame, key: str, title: str, details: str, matched: DataFrame, catalogue: Sequence[Product]) -> DataFrame:
    """(key, product, price) of the matched products that a price stands by; the title's prices come before the details'.

    A price goes to the names after it, up to the next dollar sign: the first one and those joined to it by commas, "&" or
    "and". If none follows, it goes to the last name since the price before. Discounts are no prices; the first price of a
    product is its price. Names are found within words too. Title and details are apart.
    """
    names = {p.name.lower(): [n for n in p.names] for p in catalogue if p.icon and p.match and p.priced}
    owned = deals.sparkSession.createDataFrame([(p, n) for p, ns in names.items() for n in ns] or [("", "")], "product string, name string")
    mine = matched.select(key, "product").join(F.broadcast(owned), "product").groupBy(key).agg(F.collect_list(F.struct("name", "product")).alias("_names"))

    def part(k: int, c: str) -> Column:
        return F.transform(_prices(F.lower(F.coalesce(F.col(c), F.lit("")))), lambda p, j: F.struct(F.lit(k).alias("part"), j.alias("nth"), p.alias("p")))

    # texts without a dollar sign go before the shuffle
    priced = deals.filter(F.coalesce(F.col(title).contains("$"), F.lit(False)) | F.coalesce(F.col(details).contains("$"), F.lit(False)))
    amounts = priced.select(key, F.explode(F.concat(part(0, title), part(1, details))).alias("x")).select(key, "x.part", "x.nth", "x.p.*").join(mine, key)
    longest = F.array_sort("_names", lambda a, b: F.when(F.length(a["name"]) != F.length(b["name"]), F.length(b["name"]) - F.length(a["name"])).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    any_name = F.concat(F.lit("(?:"), F.array_join(F.transform("_names", lambda n: F.concat(F.lit("\\Q"), n["name"], F.lit("\\E"))), "|"), F.lit(")"))
    ordered = amounts.withColumn("_names", longest).withColumn("_any", any_name)
    whole = F.concat(F.lit("(?s)"), F.col("_any"), F.lit(f"{PLURAL}(?:{JOINED}"), F.col("_any"), F.lit(f"{PLURAL})*"))
    run = F.call_function("regexp_extract", F.col("after"), whole, F.lit(0))

    def last_end(n: Column) -> Column:
        place = F.instr(F.reverse("before"), F.reverse(n))
        end = F.length("before") - place + 1
        rest = F.substr(F.col("before"), end + 1, F.lit(3))
        more = F.when(rest.rlike("^es(?![a-z0-9])"), 2).when(rest.rlike("^s(?![a-z0-9])"), 1).otherwise(0)
        return F.when(place > 0, end + more)

    ends = F.transform("_names", lambda n: F.struct(last_end(n["name"]).alias("end"), F.length(n["name"]).alias("size"), n["name"].alias("name")))
    back = F.array_max(F.filter(ends, lambda e: e["end"].isNotNull()))["name"]
    found = F.when(run != "", F.regexp_extract_all(run, F.col("_any"), F.lit(0))).when(back.isNotNull(), F.array(back))
    owner = lambda w: F.get(F.filter("_names", lambda n: n["name"] == w), F.lit(0))["product"]
    bound = ordered.select(key, "part", "nth", "price", F.posexplode(found).alias("k", "_name"), "_names").select(key, "part", "nth", "k", "price", owner(F.col("_name")).alias("product"))
    return bound.groupBy(key, "product").agg(F.min_by("price", F.struct("part", "nth", "k")).alias("price"))


def extract_products(deals: DataFrame, key: str, title: str, details: str, catalogue: Sequence[Product]) -> DataFrame:
    """(key, product, place, price) of each deal: products of title and details together, price null if none stands by."""
    matched = match_products(deals, key, title, details, catalogue, together=True)
    return matched.join(price_products(deals, key, title, details, matched, catalogue), [key, "product"], "left")


def product_tally(matched: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, product, n): in how many deals each product of a kind is named."""
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return matched.withColumn("kind", kind[F.col("product")]).filter("kind IS NOT NULL").groupBy("kind", "product").agg(F.count(F.lit(1)).alias("n"))
