"""Cases in which an operator once did less than the whole job."""

import collections
import math
import random
import re
import textwrap
import zlib

import pytest

from fixtures import prose, rows
from larkspur.llm import dom, langid, licenses, lmscore

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lm(texts, order):
    """log10 of each text, n-grams smoothed by PRIOR tokens of the shorter one, over all n-grams of its training part."""
    tokens = [[w.lower() for w in WORD.findall(t or "")] + [""] for _, t in texts]
    train = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i, _ in texts]
    n = collections.Counter()
    for ts, yes in zip(tokens, train):
        for k in range(len(ts)):
            if yes:
                n[(ts[k],)] += 1
            for size in range(2, order + 1):
                if yes and k >= size - 2:
                    n[tuple(["", *ts][k + 2 - size : k + 2])] += 1
    single = [c for g, c in n.items() if len(g) == 1]
    out = []
    for ts in tokens:
        score = 0.0
        for k, w in enumerate(ts):
            p = (n[(w,)] + 0.5) / (sum(single) + 0.5 * (len(single) + 1))
            for size in range(2, order + 1):
                h = tuple(["", *ts][k + 2 - size : k + 1])
                if k >= size - 2 and n[h]:
                    p = (n[(*h, w)] + lmscore.PRIOR * p) / (n[h] + lmscore.PRIOR)
            score += math.log10(p)
        out.append(score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_keeps_every_ngram(spark, order):
    # words and pairs far under 1/10,000 and 1/1,000,000 of the tokens count too, and so do single ones
    texts = [(r[0], r[1]) for r in rows()] + [(100 + k, " ".join(prose(50 + k % 7, 40).split()[k % 5 :]) + f" rare{k % 9} pair{k % 4}") for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = sorted(round(x, 6) for x in brute_lm(texts, order))
    for size in (8 << 20, 3000):
        assert sorted(round(r["score"], 6) for r in lmscore.score_documents(docs, block_bytes=size, order=order).collect()) == want


@pytest.mark.parametrize("source, want", [
    ('<p>a <svg class="i"/> b</p><p>rest', "a b|rest"),
    ("<p>a <svg-icon></svg-icon>b</p><p>rest", "a b|rest"),
    ("<body><button>Menu<p>a</p><p>rest</p></body>", "a|rest"),
    ("<div>x <object data=o> old</div><p>rest <button>c</button>", "x|rest"),
    ("<p>a <svg><g><svg/></g><svg><text>t</text></svg> u</svg>b</p>", "a b"),
    ("<div>a<button>x<button>y</button>b</div>", "ab"),
    ("<p>a<noscript><div>n</div></noscript>b<p>c<script>d</p>", "ab|c"),
    ("<title>t</title><p>a<select><option>o</select>b", "ab"),
])
def test_html_unclosed_elements(source, want):
    assert "|".join(text for _, text in dom.read_page(source).runs) == want


def test_every_language_is_learned(spark):
    r = random.Random(3)
    # Latin texts of 70 languages, one of them in long documents alone, and three scripts after more letters than one table of symbols holds
    words = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 7))) for _ in range(30)] for k in range(70)}
    for name, first, n in (("zh", 0x4E00, 600), ("xh", 0x5800, 600), ("ko", 0xAC00, 300)):
        words[name] = ["".join(chr(first + r.randrange(n)) for _ in range(2)) for _ in range(60)]
    table = [(k * 20 + j, " ".join(r.choice(w) for _ in range(1500 if name == "l07" else 60)), name) for k, (name, w) in enumerate(sorted(words.items())) for j in range(12)]
    got = {x["doc_id"]: x for x in langid.identify_language(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()}
    assert any(x["held_out"] for x in got.values())
    assert [(k, got[k]["lang_pred"]) for k, _, lang in table if got[k]["lang_pred"] != lang] == []


def test_wrapped_notices_and_licence_files(spark):
    wrap = lambda text, mark="": "\n".join(mark + x for x in textwrap.wrap(text, 50))
    by_name = collections.defaultdict(list)
    for name, text in licenses.TEMPLATES:
        by_name[name].append(text)
    longest = {name: max(texts, key=len) for name, texts in by_name.items()}
    files = [(1, "s/a.py", "# Copyright 2020 someone\n#\n" + wrap(by_name["GPL-3.0"][1], "# ") + "\n#\n" + prose(1, 80)), (2, "t/b.c", prose(2, 30) + "\n\n" + wrap(by_name["AGPL-3.0"][0], " * ") + "\n\n" + prose(3, 60))]
    files += [(10 + k, f"{name}/LICENSE", "Copyright (c) 2020 someone\n\n" + wrap(longest[name]).replace(". ", ".\n\n")) for k, name in enumerate(("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "LGPL-2.1"))]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string").repartition(2)).collect()}
    assert [got[k]["license"] for k in (1, 2)] == ["GPL-3.0", "AGPL-3.0"]
    assert [got[k]["license"] for k in range(10, 16)] == [f[1].split("/")[0] for f in files[2:]]
    assert all(got[k]["is_license_file"] for k in range(10, 16)) and got[1]["n_lines"] > 1
    # the cosine of every file's best line, with the document frequency of each word
    lines = [re.findall("[a-z0-9]+", x.lower()) for _, _, t in files for x in t.split("\n")]
    lines = [x for x in lines if x]
    often = collections.Counter(w for x in lines for w in set(x))
    vector = lambda ws: {w: n * (math.log((1 + len(lines)) / (1 + often[w])) + 1) for w, n in collections.Counter(ws).items()}
    cosine = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    shapes = [vector(re.findall("[a-z0-9]+", t.lower())) for _, t in licenses.TEMPLATES]
    for k, _, text in files[2:]:
        rows_ = [re.findall("[a-z0-9]+", x.lower()) for x in text.split("\n")]
        blocks = [re.findall("[a-z0-9]+", x.lower()) for x in re.split(r"\n\n+", text)]
        best = max(cosine(vector(u), s) for u in [*rows_, *blocks, sum(rows_, [])] if len(set(u)) > 1 for s in shapes)
        assert abs(best - got[k]["score"]) < 1e-6


def test_inheritance_against_brute_force(spark):
    r = random.Random(5)
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."]
    files = []
    for k in range(60):
        folder = "/".join(r.choice("ab") for _ in range(r.randint(0, 4)))
        name = r.choice(["LICENSE", "x.txt", "y.txt", "z.txt"])
        text = r.choice(notices) if name == "LICENSE" else r.choice(["", prose(k, 30), prose(k, 30) + "\n" + r.choice(notices)])
        files.append((k, f"{folder}/{name}".lstrip("/"), text))
    got = {x["doc_id"]: x for x in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    above = lambda path: path.rpartition("/")[0]
    at = {}
    for k, path, _ in files:
        if got[k]["is_license_file"]:
            at[above(path)] = max(at.get(above(path), (0, "")), (got[k]["score"], got[k]["license"]))
    assert len(at) > 3
    for k, path, text in files:
        folder = above(path)
        while folder not in at and folder:
            folder = above(folder)
        inherited = at.get(folder, (0, None))[1]
        assert got[k]["is_license_file"] == path.endswith("LICENSE")
        assert (got[k]["inherited"], got[k]["from_dir"]) == (inherited, folder if inherited else None)
        assert got[k]["effective"] == (got[k]["license"] or inherited)


def test_languages_of_repeated_rows_are_learned(spark):
    from larkspur.llm import langid

    rows = [(k, "zwei drei vier fünf sechs sieben acht", "de") for k in range(1, 1200)] + [(5000 + k, " ".join(f"word{(k * j) % 17} other" for j in range(30)), "en") for k in range(400)] + [(9000, "uno dos tres cuatro", "es")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.labelled_sample(docs, "doc_id", "text", "lang")
    assert sample["de"] == [rows[0][1]] and len(sample["en"]) == min(langid.SAMPLE_DOCS, len({r[1] for r in rows if r[2] == "en"}))
    assert len(set(sample["en"])) == len(sample["en"]) and sample.get("es", ["uno dos tres cuatro"]) == ["uno dos tres cuatro"]
