"""Slugs of any letters, and paths that are read and written back."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from larkspur.functions import paths, text

CATALOGUE = [("Happy Hour", ["happiest hour"]), ("Beer", ["schooner", "Happy-Hour"]), ("Cocktails", ["cocktail"]), ("Würst", [])]


@pytest.fixture(scope="module")
def names():
    return paths.product_names(CATALOGUE)


def values(spark, column, inputs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r.out.asDict(recursive=True) if hasattr(r.out, "asDict") else r.out for r in rows.select("k", column.alias("out")).orderBy("k").collect()]


def test_slugs(spark):
    said = ["Ōtāhuhu", "Škoda Čafé", "  Café & Bar! ", "ﬁsh ½ price", "Te Whanganui-a-Tara", "ＦＵＬＬ width", "Nguyễn's", "Ō combining", "Straße", "中文", "", None, "㎏ Ⅷ ①"]

    def plain(s):
        d = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", s)).lower().strip()
        return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", d))

    got = values(spark, text.slugify(F.col("v")), said)
    assert got == [None if s is None else plain(s) for s in said] and got[:2] == ["otahuhu", "skoda-cafe"]
    assert values(spark, text.parse_suburb_slug(F.col("v")), ["otahuhu-1062", "East-Bay", "a-b-12345", "2000"]) == [
        {"name_slug": "otahuhu", "postcode": "1062"}, {"name_slug": "east-bay", "postcode": None}, {"name_slug": "a-b-12345", "postcode": None}, {"name_slug": "2000", "postcode": None},
    ]


def test_reading(spark, names):
    def where(kind, slug=None, map=False, day=None, what=()):  # noqa: A002
        return {"kind": kind, "slug": slug, "map": map, "day": day, "what": list(what)}

    cases = {
        "": where("anywhere"), "/": where("anywhere"), "/map": where("anywhere", map=True), "/map-friday": where("anywhere", map=True, day=6), "/nearby": where("nearby"), "/nearby/beer/map": where("nearby", map=True, what=["Beer"]),
        "/nearby/the-local": where("anywhere"), "/bay-2000": where("suburb", "bay-2000"), "/Bay-2000-Monday/": where("suburb", "bay-2000", day=2), "/bay/wednesday-beer-happyhour": where("suburb", "bay", day=4, what=["Beer", "Happy Hour"]),
        "/bay-monday/cocktail": where("suburb", "bay", day=2, what=["Cocktails"]), "/bay-monday/sunday/map": where("suburb", "bay", True, 1), "/bay/the-local": where("anywhere"), "/bay/beer/x": where("anywhere"), "/bay/map": where("suburb", "bay", True),
        "/bay/map/beer": where("anywhere"), "/bay/Schooner-WURST": where("suburb", "bay", what=["Beer", "Würst"]), "/monday": where("suburb", "monday"), "/bay/-": where("anywhere"), "/bay/beer-monday": where("anywhere"),
    }
    assert dict(zip(cases, values(spark, paths.parse_where(F.col("v"), names), cases))) == cases


def test_writing(spark, names):
    what = F.array(F.lit(" happy hour "), F.lit("free text"), F.lit("wurst"), F.lit(""))
    cases = {
        "/bay": "/bay/thursday-happyhour-wurst", "/bay/monday-beer?x=1#top": "/bay/thursday-happyhour-wurst?x=1#top", "/bay-monday": "/bay/thursday-happyhour-wurst", "/": "/", "": "/", "/?q=1": "/?q=1", "/map": "/map", "/map/beer": "/map",
        "/bay/the-local": "/bay/the-local/thursday-happyhour-wurst", "/monday": "/monday/thursday-happyhour-wurst",
    }
    assert dict(zip(cases, values(spark, paths.append_filters(F.col("v"), F.lit(5), what, names), cases))) == cases
    none = F.array().cast("array<string>")
    assert values(spark, paths.append_filters(F.col("v"), F.lit(None).cast("int"), none, names), ["/bay/monday", "/bay-friday/x"]) == ["/bay", "/bay/x"]
    assert values(spark, paths.split_what(paths.what_tokens(F.col("v")), names), ["beer, trivia ,,COCKTAIL", None]) == [{"path_tokens": ["Beer", "Cocktails"], "query_tokens": ["trivia"]}, {"path_tokens": [], "query_tokens": []}]


def test_round_trip(spark, names):
    days, sets = [None, *range(1, 8)], [[], ["Beer"], ["Happy Hour", "Würst"], ["Cocktails", "Beer", "Happy Hour"]]
    rows = spark.createDataFrame([(f"place-{k}" + ("-2000" if k % 2 else ""), d, w) for k, d in enumerate(days) for w in sets], "slug string, day int, what array<string>")
    path = paths.append_filters(F.concat(F.lit("/"), "slug"), F.col("day"), F.col("what"), names)
    back = rows.select("slug", "day", "what", paths.parse_where(path, names).alias("w")).collect()
    assert len(back) == 32 and all((r.w.kind, r.w.slug, r.w.map, r.w.day, r.w.what) == ("suburb", r.slug, False, r.day, r.what) for r in back)


def test_parameters(spark):
    assert values(spark, paths.days_param(F.col("v")), ["1, 3,9,x,7", None, ""]) == [[1, 3, 7], [], []]
    pairs = [("60", "120"), ("", "120"), ("60", None), (None, None), ("1440", "1440"), ("0", "0"), ("300", "200"), ("x", "5"), ("200", "200")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = [r.t and tuple(r.t) for r in rows.select("k", paths.time_range(F.col("a"), F.col("b")).alias("t")).orderBy("k").collect()]
    assert got == [(60, 120), (None, 120), (60, None), None, None, None, None, None, (200, 200)]
