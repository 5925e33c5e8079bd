"""Walks over links against queues that are served one by one, and nested site maps."""

import random

from larkspur.operators import crawl


def walk(seeds, pages, links, budget):
    """A queue of one site, as a crawler serves it."""
    queue, visited, seen, out = [u for _, u in sorted((p, u) for u, p in seeds.items())], {}, set(), []
    depth = dict.fromkeys(queue, 0)
    while queue and len(visited) < budget:
        url = queue.pop(0)
        visited[url] = len(visited) + 1
        identity = pages.get(url)
        again = identity in seen
        out.append((url, depth[url], visited[url], identity, identity is not None and again))
        if identity is None or again:
            continue
        seen.add(identity)
        for _, target in sorted(links.get(url, [])):
            if target not in depth:
                depth[target] = depth[url] + 1
                queue.append(target)
    return out


def test_crawl(spark):
    r = random.Random(8)
    urls = [f"u{k:03}" for k in range(150)]
    pages = {u: f"i{int(u[1:]) // r.choice([1, 1, 2])}" for u in urls if r.random() < 0.8}
    links = {u: [(place, r.choice(urls)) for place in range(r.randint(0, 4))] for u in pages}
    links |= {u: [(p, t) for p, t in ts if t != u] + [(9, u)] for u, ts in links.items()}
    sites = {f"s{k}": ({r.choice(urls): p for p in range(r.randint(1, 4))}, r.choice([1, 2, 7, 20, 60])) for k in range(25)}
    seeds = spark.createDataFrame([(s, u, p, b) for s, (q, b) in sites.items() for u, p in q.items()] + [("s0", u, 99, sites["s0"][1]) for u in sites["s0"][0]], "site string, url string, place int, budget int")
    table = spark.createDataFrame([(u, p, t) for u, ts in links.items() for p, t in ts], "url string, place int, target string")
    known = spark.createDataFrame(list(pages.items()) * 2, "url string, identity string")
    got = {(x.site, x.url, x.depth, x.visit, x.identity, x.duplicate) for x in crawl.crawl(seeds, known, table).collect()}
    want = {(s, *row) for s, (q, b) in sites.items() for row in walk(q, pages, links, b)}
    assert got == want and max(x[2] for x in want) > 3 and any(x[5] for x in want)
    assert crawl.crawl(seeds.limit(0), known, table).count() == 0
    assert crawl.crawl(seeds, known.limit(0), table).filter("depth > 0").count() == 0


def test_site_maps(spark):
    maps = [("r", 0, "a", True), ("r", 1, "p1", False), ("r", 2, "b", True), ("a", 0, "p2", False), ("a", 1, "p1", False), ("b", 0, "c", True), ("b", 1, "lost", True), ("b", 2, "r", True), ("c", 0, "p3", False), ("c", 1, "p2", False)]
    table = spark.createDataFrame(maps, "url string, place int, target string, is_map boolean")
    roots = spark.createDataFrame([("s", "r"), ("t", "c"), ("u", "none")], "site string, url string")
    got = sorted((x.site, x.url, x.visit, x.place) for x in crawl.site_map_leaves(roots, table).collect())
    assert got == [("s", "p1", 1, 1), ("s", "p2", 2, 0), ("s", "p3", 4, 0), ("t", "p2", 1, 1), ("t", "p3", 1, 0)]
    assert {x.url for x in crawl.site_map_leaves(roots, table, most=2).filter("site = 's'").collect()} == {"p1", "p2"}
