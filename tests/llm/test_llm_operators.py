"""Each operator against a brute-force version, on the fixtures and on an empty table."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from fixtures import SCHEMA, prose, rows
from larkspur.llm import dedup, htmltext, jaccard, langid, licenses, lmscore, mixing, quality, sharding
from larkspur.llm.components import components
from larkspur.llm.decontaminate import decontaminate, proximity_matches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in rows()]


def key(x):
    return tuple("" if v is None else str(v) for v in x)


def test_suffix_dedup(docs, none, monkeypatch):
    seen = collections.Counter(t.encode()[k : k + 200] for _, t in texts() for k in range(len(t.encode()) - 199))
    want = []
    for i, t in texts():
        b = t.encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        want.append((i, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    for spread in (8192, 1):
        monkeypatch.setattr(dedup, "SPREAD", spread)
        got = dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(key, got)) == sorted(map(key, want))
    assert dedup.remove_repeats(none).count() == 0


def test_jaccard(docs, none):
    sets = []
    for i, t in texts():
        w = WORD.findall(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links, group = collections.Counter(), list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    ids = [i for i, _ in texts()]
    least = {g: min((ids[k] for k in range(len(ids)) if group[k] == g and ids[k] is not None), default=None) for g in set(group)}
    want = sorted(key((ids[k], least[group[k]], links[k])) for k in range(len(ids)))
    found = jaccard.near_duplicates(docs)
    assert sorted(map(key, found.select("doc_id", "class_id", "n_links").collect())) == want
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_large_group_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE_ROWS", 7)
    monkeypatch.setattr(jaccard, "PART", 5)
    base, pick = prose(9, 150).split(), random.Random(3)
    many = []
    for k in range(60):
        words = list(base)
        for j in pick.sample(range(150), k % 10):
            words[j] = f"new{k}x{j}"
        many.append((k, " ".join(words)))
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in many]
    linked = [[b for b in range(60) if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in range(60)]
    least = list(range(60))
    for _ in range(60):
        least = [min([least[a], *[least[b] for b in linked[a]]]) for a in range(60)]
    assert any(len(x) == 0 for x in linked) and len(set(map(len, linked))) > 5
    assert [(got[k]["class_id"], got[k]["n_links"]) for k in range(60)] == [(least[k], len(linked[k])) for k in range(60)]


def test_components(spark):
    pick = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(pick.randrange(100, 160), pick.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    least = {k: k for e in edges if e[0] != e[1] for k in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == least


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, prose(4, 30)), (2, "One two"), (2, "nothing here"), (None, " ".join(prose(2, 80).split()[5:20])), (3, None), (4, "")], "item_id long, text string")
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    want = []
    for i, t in texts():
        w, hit, items = low(t), set(), set()
        for item, q in ((r["item_id"], low(r["text"] or "")) for r in bench.collect()):
            n = min(10, len(q))
            grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    items.add("" if item is None else str(item))
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(key, decontaminate(docs, bench).drop("key").collect())) == sorted(map(key, want))
    assert decontaminate(none, bench).count() == 0
    assert not decontaminate(docs, bench.limit(0)).filter("contaminated").count()
    assert proximity_matches(docs, bench).filter("doc_id = 8").count() > 0


def test_quality(spark, docs, none):
    want = []
    for i, t in texts():
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    labels = spark.createDataFrame([(1, None), (None, 0), (999, 0)], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels)
    assert sorted(map(key, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())) == sorted(map(key, want))
    assert got.filter("kept = base_failed").count() == 0
    assert quality.quality_rules(none, labels).count() == 0


def test_rules_are_learned(spark):
    table = [(k, " ".join(("## " if k % 3 == 0 else "") + w for w in prose(k, 60).split())) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(table, "doc_id long, text string"), labels).collect()}
    assert all(kept[k] == (k % 3 > 0) for k in range(240))


def test_lm(docs, none):
    tokens = [[w.lower() for w in WORD.findall(t)] + [""] for _, t in texts()]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in texts()]
    counts = collections.Counter(w for ts, h in zip(tokens, held) if not h for w in ts)
    total, types = sum(counts.values()), len(counts)
    for size in (8 << 20, 2000):
        got = lmscore.score_documents(docs, block_bytes=size).collect()
        base = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
        assert base == sorted((len(ts), sum(counts[w] > 0 for w in ts), round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ts), 6)) for ts in tokens)
        assert all(r["train_tokens"] == total and r["score"] < 0 for r in got)
    assert lmscore.score_documents(none).count() == 0


def test_language(spark, docs, none):
    made = [(k, prose(k, 60) if k % 2 else prose(k, 60).translate(str.maketrans("abcdefgh", "mnoprstu")), ("en", "xx")[k % 2 == 0]) for k in range(200)]
    got = {r["doc_id"]: r for r in langid.identify_language(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in made)
    odd = langid.identify_language(docs).collect()
    assert len(odd) == len(rows()) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd if r["doc_id"] in (5, 6))
    assert langid.identify_language(none).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix_sources(docs, rows_to_sort=2).collect()
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[n] for n in capped)
        level = left / max(1, sum(weight[n] for n in names if n not in capped))
        new = {n for n in names if n not in capped and level * weight[n] > 3 * sizes[n]}
        if not new:
            break
        capped |= new
    taken = collections.Counter()
    for r in got:
        target = 3 * sizes[r["source"]] if r["source"] in capped else level * weight[r["source"]]
        assert abs(r["target"] - target) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        if r["source"] in sizes:
            assert r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in got)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(none).count() == 0


def test_sharding(docs, none, tmp_path):
    got = sharding.shard_documents(docs, max_bytes=2000).collect()
    total, ids = collections.Counter(), {r["shard_id"] for r in got}
    for r in got:
        total[r["shard_id"]] += r["n_bytes"]
    assert len(got) == len(rows())
    assert all(total[r["shard_id"]] == r["shard_bytes"] and (r["shard_bytes"] <= 2000 or r["oversize"]) for r in got)
    assert not any(a != b and b.startswith(a) for a in ids for b in ids)
    assert {r["doc_id"] for r in got if r["oversize"]} == {9}
    sharding.write_shards(docs, str(tmp_path / "out"), max_bytes=2000)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(rows())
    assert sharding.shard_documents(none).count() == 0


def test_html():
    model = htmltext.main_text_model()
    page = '<html><body><nav><a href=x>Menu</a></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B</h1><p>' + prose(1, 60) + '.<p>Two\n\n  lines<br>here, and ' + prose(2, 40) + '.<div class="ad">Buy now</div></article><section class="comments"><div class="comment"><p>' + prose(3, 30) + "</p></div></section><footer>&copy; me</footer><script>var a='</p>'</script></body></html>"
    assert htmltext.main_texts([page, None, ""], model) == [f"A & B\n{prose(1, 60)}.\nTwo lines here, and {prose(2, 40)}.", "", ""]
    maker = htmltext.PageMaker(77)
    share = []
    for _ in range(150):
        source = maker.page()
        page = htmltext.dom.read_page(source)
        inside = []
        for k, f in enumerate(page.family):
            inside.append(bool(f & htmltext.dom.KEPT) or (not f & htmltext.dom.LEFT and page.parent[k] >= 0 and inside[page.parent[k]]))
        a = collections.Counter(w for k, t in page.runs if inside[k] for w in t.split())
        b = collections.Counter(htmltext.main_texts([source], model)[0].split())
        share.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert sum(share) / len(share) > 0.93


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>x", 2)], "page_id long, url string, html string, n_chars int")
    assert htmltext.extract_text(pages).count() == 2 and htmltext.extract_text(pages.limit(0)).count() == 0


def test_licenses(spark, none):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", prose(1, 40)), (3, "a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
        (4, "z/y.txt", prose(2, 50) + "\nLicensed under CC BY-NC 4.0.\n" + prose(3, 20)), (5, "a/y.txt", None), (6, None, "the license"), (7, "z/q.txt", ""),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [got[k]["license"] for k in range(1, 8)] == ["MIT", None, "Apache-2.0", "CC-BY-NC-4.0", None, None, None]
    assert (got[2]["effective"], got[2]["from_dir"]) == ("Apache-2.0", "a/b")
    assert (got[5]["effective"], got[5]["from_dir"], got[7]["effective"]) == ("MIT", "a", None)
    assert licenses.scan_licenses(none, path="source").count() == 0
