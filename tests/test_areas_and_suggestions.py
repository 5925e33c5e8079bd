"""Area sweeps, suggestions, expanded tokens and site maps against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import areas, crawl, site_maps, suggest


def km(a, b, c, d):
    x = math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.cos(math.radians(d - b)) + math.sin(math.radians(a)) * math.sin(math.radians(c))
    return 6371.0 * math.acos(max(-1.0, min(1.0, x)))


@pytest.mark.parametrize("south", [-34.0, 59.5])
def test_sweep(spark, south):
    r = random.Random(6)
    places = {i: (south + 0.2 + r.gauss(0, 0.03 if i % 2 else 0.004), 150.2 + r.gauss(0, 0.05 if i % 2 else 0.004)) for i in range(400)}
    table = spark.createDataFrame([(i, *p) for i, p in places.items()], "place_id long, lat double, lng double").repartition(3)
    cells = areas.grid(spark, south, 150.0, south + 0.4, 150.4, 7000.0)
    found, searches = areas.sweep(cells, table, 7000.0, most=10, depth=2)
    want, asked, todo = {}, set(), [(c.cell, c.lat, c.lng, c.radius, 0) for c in cells.collect()]
    while todo:
        cell, lat, lng, radius, depth = todo.pop(0)
        inside = sorted((km(lat, lng, *p), i) for i, p in places.items() if km(lat, lng, *p) * 1000 <= radius)[:10]
        asked.add((cell, depth, len(inside), len(inside) == 10 and depth == 2))
        for _, i in inside:
            want[i] = min(want.get(i, (9, "")), (depth, cell))
        if len(inside) == 10 and depth < 2:
            off = radius * areas.OVERLAP / 2 / areas.METRES_PER_DEGREE
            todo += [(f"{cell}/{k}", lat + a * off, lng + b * off / math.cos(math.radians(lat)), radius / 2, depth + 1) for k, (a, b) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)))]
    assert {tuple(x) for x in searches.collect()} == asked and any(a[1] == 2 for a in asked)
    assert {x.place_id: (x.depth, x.cell) for x in found.collect()} == want and max(d for d, _ in want.values()) > 0
    assert areas.grid(spark, 1.0, 1.0, 1.0, 2.0, 5.0).count() == 0


def test_suggestions(spark):
    names = [("Beer", "Beer", 2), ("Beer", "schooner of ale", 2), ("Root beer", "Root beer", None), ("Wine", "Wine", 1), ("Wine", "vino", 1), ("Ale", "ALE", None)]
    table = spark.createDataFrame(names, "product string, written string, rank int")
    typed = [(1, " be"), (2, "E"), (3, ""), (4, None), (5, "oner of a"), (6, "zzz"), (7, "ale"), (8, "eer")]
    asked = spark.createDataFrame(typed, "typed_id int, typed string")

    def plain(t, chosen=()):
        t = (t or "").strip().lower()
        hits = {p: r for p, w, r in names if (t in w.lower() if t else r is not None) and p.lower() not in chosen}
        return [p for p, _ in sorted(hits.items(), key=lambda x: (x[1] is None, x[1] or 0, x[0]))]

    def listed(found):
        out = {}
        for x in sorted(found.collect(), key=lambda x: x.place):
            out.setdefault(x.typed_id, []).append(x.product)
        return out

    assert listed(suggest.suggestions(asked, table)) == {i: plain(t) for i, t in typed if plain(t)}
    out = spark.createDataFrame([(2, "beer"), (3, "WINE")], "typed_id int, product string")
    got = listed(suggest.suggestions(asked, table, most=1, excluded=out))
    assert got[2] == plain("e", {"beer"})[:1] and got[3] == ["Beer"]


def test_expanded_tokens(spark):
    groups = spark.createDataFrame([("drinks", "Beer"), ("Drinks", "wine"), ("beer", "ale"), ("ale", "drinks"), ("food", "pie")], "name string, member string")
    tokens = spark.createDataFrame([(1, " Drinks "), (2, "pie"), (3, ""), (1, "DRINKS")], "token_id int, token string")
    got = {(x.token_id, x.term.lower(), x.step) for x in suggest.expanded_tokens(tokens, groups).collect()}
    assert got == {(1, "drinks", 0), (1, "beer", 1), (1, "wine", 1), (1, "ale", 2), (2, "pie", 0)}


def test_site_maps(spark):
    entries = spark.createDataFrame([(f"https://s.example/{k}?a=1&b=<{k}>", "2026-01-01", "weekly", "0.8") for k in range(95)], "loc string, lastmod string, changefreq string, priority string")
    files = site_maps.write_site_maps(entries, "https://s.example/maps/", 10).cache()
    sizes = {x.url: x.xml.count("<loc>") for x in files.collect()}
    index = sizes.pop("https://s.example/maps/index.xml")
    assert sum(sizes.values()) == 95 and max(sizes.values()) <= 10 and index == len(sizes)
    odd = spark.createDataFrame([("https://s.example/top.xml", '<sitemapindex><sitemap><loc> https://s.example/maps/index.xml </loc></sitemap><sitemap><loc>https://s.example/none.xml</loc></sitemap></sitemapindex>'), ("https://s.example/broken.xml", "<urlset><url>"), ("https://s.example/empty.xml", "<urlset></urlset>"), ("https://s.example/null.xml", None)], "url string, xml string")
    maps = site_maps.read_site_maps(files.unionByName(odd))
    roots = spark.createDataFrame([("s", "https://s.example/top.xml")], "site string, url string")
    found = crawl.site_map_leaves(roots, maps)
    assert {x.url for x in found.collect()} == {x.loc for x in entries.collect()} and found.select(F.max("depth")).first()[0] == 2
    none = site_maps.write_site_maps(entries.limit(0), "https://s.example", 10)
    assert none.count() == 1 and site_maps.read_site_maps(none).count() == 0


def test_packs_of_ids_meet_blocks_of_products(spark, monkeypatch):
    monkeypatch.setattr(suggest, "PACK", 5)
    monkeypatch.setattr(suggest, "BLOCK", 3)
    names = [(f"{a}{b}", f"{a}{b}", None if k % 3 else k % 4) for k, (a, b) in enumerate((a, b) for a in ("ab", "AB", "b", "ba") for b in ("", "a", "b", "é"))]
    typed = [(k, ["a", "B", " ", "é", "ba", "x", None][k % 7]) for k in range(60)]
    gone = [(k, names[(k * j) % len(names)][0].upper()) for k in range(0, 60, 2) for j in (1, 5)]
    asked, table, out = spark.createDataFrame(typed, "typed_id int, typed string"), spark.createDataFrame(names, "product string, written string, rank int"), spark.createDataFrame(gone, "typed_id int, product string")

    def plain(i, t):
        t, chosen = (t or "").strip().lower(), {p.lower() for k, p in gone if k == i}
        hits = {p: r for p, w, r in names if (t in w.lower() if t else r is not None) and p.lower() not in chosen}
        return [(i, p, k + 1) for k, p in enumerate(sorted(hits, key=lambda p: (hits[p] is None, hits[p] or 0, p)))]

    got = suggest.suggestions(asked, table, excluded=out)
    assert sorted(map(tuple, got.collect())) == sorted(x for i, t in typed for x in plain(i, t))
    assert "windowspecdefinition(typed_id" not in got._jdf.queryExecution().analyzed().toString()
