"""Links, and rows that are meant or kept, case by case."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from larkspur.functions import links
from larkspur.functions.text import normalise_url
from larkspur.operators import resolve, sync


def test_links_resolve_as_browsers_do(spark):
    pages = ["https://A.example/a/b/c.html?x=1#f", "http://a.example", "https://a.example/a/"]
    hrefs = ["d", "./d", "../d", "../../../d", "/d/./e/../f", "?y=2", "//b.example/d", "HTTPS://C.example/D", "d?q=../x", "a/..", ".", "..", "d/", " d ", "/"]
    cases = [(p, h) for p in pages for h in hrefs]
    rows = spark.createDataFrame([(k, p, h, urljoin(p, h.strip())) for k, (p, h) in enumerate(cases)], "k int, page string, href string, want string")
    got = rows.select("page", "href", links.resolve_url(F.col("href"), F.col("page")).alias("got"), normalise_url(F.col("want")).alias("want")).collect()
    assert [(r["page"], r["href"], r["got"]) for r in got] == [(r["page"], r["href"], r["want"]) for r in got]
    none = spark.createDataFrame([("",), ("#top",), ("mailto:a@b.example",), ("tel:1",), (None,)], "href string")
    assert {r[0] for r in none.select(links.resolve_url(F.col("href"), F.lit(pages[0]))).collect()} == {None}


def test_origin_and_links_to_follow(spark):
    rows = spark.createDataFrame([("https://www.a.example/x", "http://A.example", True), ("https://b.example", "https://a.example", False), ("x", "y", False)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in rows.select(links.same_origin(F.col("a"), F.col("b")), "want").collect())
    rows = spark.createDataFrame([("https://a/menu.pdf", "x", True), ("https://a/p", "Friday soup", True), ("https://a/p", "What's on", True), ("https://a/p", "about", False), ("https://a/p.png", "Friday", False), ("https://a/p", "Mothers-Day Sunday", False), ("https://a/p", None, False)], "u string, t string, want boolean")
    assert all(r[0] == r[1] for r in rows.select(links.worth_following(F.col("u"), F.col("t"), ["what's on"], ["mother's day"]), "want").collect())


def test_features(spark):
    have = spark.createDataFrame([(1, "Pool"), (2, "Garden")], "venue_id long, feature string")
    wanted = spark.createDataFrame([(1, " garden "), (1, "GARDEN"), (1, "pool"), (3, "x"), (3, " ")], "venue_id long, feature string")
    known = spark.createDataFrame([("Garden",), ("Pool",)], "feature string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(resolve.set_features(have, wanted, known)) == [(1, "Garden"), (1, "Pool"), (2, "Garden")]
    assert rows(resolve.set_features(have, wanted.filter("feature <> 'pool'"), known, keep=True)) == [(1, "Garden"), (1, "Pool"), (2, "Garden")]
    assert rows(resolve.unknown_features(wanted, known).select("venue_id", "feature")) == [(3, "x")]


def test_sources_and_parents(spark):
    schema = "venue_id long, url string, content_hash string, status string, date string"
    current = spark.createDataFrame([(1, "a", "h1", "new", "d0"), (1, "b", None, "rejected", "d0"), (2, "a", "h9", "new", "d0")], schema)
    incoming = spark.createDataFrame([(1, "a", "h2", "approved", "d1", 1), (1, "b", None, "approved", "d1", 2), (1, "c", "h2", "new", "d1", 3), (1, "d", "h1", "new", "d1", 4), (1, "e", "h3", "new", "d1", 5), (1, "f", "h3", "new", "d1", 6), (1, "g", None, "new", "d1", 7), (2, "c", "h3", "new", "d1", 8)], schema + ", k int")
    got = sorted((r["venue_id"], r["url"], r["content_hash"] or "", r["status"], r["date"]) for r in resolve.upsert_sources(current, incoming, "k").collect())
    assert got == [(1, "a", "h2", "approved", "d1"), (1, "b", "", "rejected", "d1"), (1, "e", "h3", "new", "d1"), (1, "g", "", "new", "d1"), (2, "a", "h9", "new", "d0"), (2, "c", "h3", "new", "d1")]
    parents = spark.createDataFrame([(1, True), (2, False), (3, None), (4, False)], "id long, live boolean")
    children = spark.createDataFrame([(3,), (4,), (4,), (None,)], "id long")
    assert sorted(r["id"] for r in sync.prune_childless(parents, children, "id", F.col("live")).collect()) == [1, 3, 4]
