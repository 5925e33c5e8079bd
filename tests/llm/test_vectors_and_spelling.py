"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, clashing names and empty tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import hnsw, neighbours, spelling, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, shard int, block int, copies long, part int, entry int, code string, query int"


def vector_rows(n=700, width=16, seed=3):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(8, width))
    x = middle[r.integers(0, 8, n)] + 0.4 * r.normal(size=(n, width)) * r.choice([0.2, 1, 9], n)[:, None]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(n + i, x[0].tolist(), None) for i in range(150)]  # equal vectors, a query among them
    rows += [(40, x[40].tolist(), 1), (40, x[40].tolist(), 1), (40, x[41].tolist(), 1)]  # repeated rows and ids
    rows += [(None, x[7].tolist(), 2), (2000, None, 1), (2020, [0.0] * width, 1), (2040, [math.nan] * width, 1), (2060, [None] + [1.0] * (width - 1), 1), (2080, [math.inf] * width, 1), (2100, [], 1)]
    rows += [(3000 + i, v.tolist(), 5) for i, v in enumerate(r.normal(size=(30, 5)))]
    return [(*row, 1, 2, 3, 4, 5, "c", 6) for row in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS).repartition(3).cache()


def taking_part():
    return [(i, tuple(v)) for i, v, *_ in vector_rows() if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


@pytest.mark.parametrize("shard", [1 << 19, 1 << 11])
def test_neighbours(spark, vectors, monkeypatch, shard):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    monkeypatch.setattr(neighbours, "BLOCK", shard >> 2)
    rows, want = taking_part(), Counter()
    for k, (i, v) in enumerate(rows):
        if i is not None and i % 20 == 0:
            near = sorted((-product(v, w), j is None, j or 0) for m, (j, w) in enumerate(rows) if m != k and len(w) == len(v))[:20]
            want.update((i, rank, None if no else j, -s) for rank, (s, no, j) in enumerate(near, 1))
    got = Counter(tuple(r) for r in neighbours.nearest_neighbours(vectors).collect())
    ranks = Counter((q, rank) for q, rank, *_ in got.elements())
    assert ranks == Counter((q, rank) for q, rank, *_ in want.elements())
    exact = {(q, j, s) for q, _, j, s in want}
    assert sum(((q, j, s) in exact) * n for (q, _, j, s), n in got.items()) >= 0.97 * want.total()
    assert neighbours.nearest_neighbours(vectors.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (20, [-1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, neighbours.nearest_neighbours(few).collect())) == [(0, 1, 1, 2.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0)]
    assert neighbours.nearest_neighbours(few.limit(1)).count() == 0


def test_graph_recall_and_reach():
    x = np.random.default_rng(1).normal(size=(4000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.build(x)
    assert hnsw._reachable(graph.layers[0]).all() and len(graph.layers) > 1
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in graph.layers[0])
    queries = np.random.default_rng(2).normal(size=(200, 24))
    true = np.argsort(((x[None] - queries[:, None]) ** 2).sum(2), 1)[:, :20]
    found = hnsw.search(graph, queries, 20)[:, :20]
    assert sum(len(set(a) & set(b)) for a, b in zip(true, found, strict=True)) >= 0.95 * true.size


def naive_codes(rows, width):
    """The contract in plain Python."""
    kept = [(i, tuple(math.floor(4096 * c) for c in v), label) for i, v, label, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [k for k in kept if len(k[1]) == width]
    at = [p * width // 8 for p in range(9)]
    starts = {}
    for i, v, _ in sorted(fit, key=lambda k: (k[0] is None, k[0] or 0, k[1])):
        starts.setdefault(i, v)
    starts = list(starts.values())[:16]
    books = [[v[at[p] : at[p + 1]] for v in starts] for p in range(8)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[at[p] : at[p + 1]], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        members = [[[] for _ in starts] for _ in range(8)]
        for _, v, _ in fit:
            for p in range(8):
                members[p][near(v, p)[1]].append(v[at[p] : at[p + 1]])
        books = [[tuple(sum(c) // len(m) for c in zip(*m, strict=True)) if m else e for m, e in zip(members[p], books[p], strict=True)] for p in range(8)]
    out = []
    for i, v, label in kept:
        found = [near(v, p) for p in range(8)] if len(v) == width else None
        out.append((i, label, "".join(f"{k:02x}" for _, k in found) if found else None, sum(d for d, _ in found) if found else None))
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error or 0
    return Counter((i, code, error, sums[label] if any(o[1] == label and o[3] is not None for o in out) else None) for i, label, code, error in out), books


def test_vector_codes(vectors):
    want, _ = naive_codes(vector_rows(), 16)
    got = vector_codes.compress(vectors).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert len({r.codebooks_sha256 for r in got}) == 1
    assert vector_codes.compress(vectors.limit(0)).count() == 0


def test_vector_codes_of_few_odd_and_huge(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, -1.5, 2.25, r.random()]) for _ in range(11)], None) for i in range(40)]
    rows += [(50, [1e9, -3e9] + [0.5] * 9, 1), (51, [1e300] * 11, 1)]
    for some in (rows[:5], rows[:41], rows):
        want, _ = naive_codes(some, 11)
        want = Counter({(i, code, e if e < 1 << 63 else None, s) if e < 1 << 63 else (i, code, None, s): n for (i, code, e, s), n in want.items()})
        got = vector_codes.compress(spark.createDataFrame(some, "vec_id long, embedding array<double>, label int")).collect()
        assert Counter((x.vec_id, x.code, x.error) for x in got) == Counter((i, c, e) for i, c, e, _ in want.elements())


def test_partial_distances_keep_ties():
    r = np.random.default_rng(7)
    for _ in range(30):
        block, book = r.integers(-3, 4, (200, 5)), r.integers(-3, 4, (16, 5))
        arg, best = vector_codes.nearest(block, book)
        full = ((block[:, None] - book) ** 2).sum(2)
        assert (arg == full.argmin(1)).all() and (best == full.min(1)).all()


def edits(word, letters):
    for k in range(len(word) + 1):
        for c in letters:
            yield word[:k] + c + word[k:]
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            for c in letters:
                yield word[:k] + c + word[k + 1 :]


def naive_variants(counts):
    letters, out = sorted(set("".join(counts))), {}
    for w, n in counts.items():
        near = {e for e in edits(w, letters) if e != w and e in counts}
        best = min(((-counts[e], e) for e in near), default=None)
        form = best[1] if best and -best[0] >= 10 * n else None
        out[w] = [n, len(near), form, counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {(w, *row) for w, row in out.items()}


@pytest.mark.parametrize("part", [1024, 2])
def test_spelling_variants(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)
    r = random.Random(11)
    counts = {}
    for _ in range(60):
        word = "".join(r.choice("abé×") for _ in range(r.randint(7, 12)))
        counts[word] = r.choice([2, 30, 400, 5000])
        for e in r.sample(list(edits(word, "abz")), 6):
            if len(e) >= 7:
                counts.setdefault(e, r.choice([2, 3, 30, 299, 300, 4000]))
                counts.setdefault(e + "q", 2)
    counts |= {"aaaaaaa": 7, "aaaaaaaa": 70, "aaaaaaaaa": 700, "aaaaaaab": 70, "\U0001d7d8aaaaaaa": 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(x[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for x in spelling.spelling_variants(words).collect()} == naive_variants(counts)
    assert spelling.spelling_variants(words.limit(0)).count() == 0


def test_words_with_slips(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["Éclairs", "SHORT", "Éclairsÿ", "naïvely", "abcdefgh9abcdefg", "sevenletters", "ab-longerword"]) for _ in range(40)) for _ in range(40)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "nullidword nullidword", "x"), (3, None, "x"), (4, "", "x"), (5, "x" * 200_000 + " " + "y" * 200_000, "x"), (5, "x" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(2)
    want = Counter()
    for i, t, _ in rows:
        run = ""
        for c in (t or "") + "\n":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(word) >= 7:
                    want[word] += 1
            run = ""
    each = spelling.runs(docs)
    got = {r.word: r.n for r in spelling.word_counts(each, spelling.misspelt(each)).collect()}
    assert got == {w: n for w, n in want.items() if n > 1}
