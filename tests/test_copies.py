"""The best of near copies against a plain greedy choice."""

import numpy as np

from larkspur.operators import copies


def plain(rows, near):
    kept, out = [], {}
    for i, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        found = v is not None and next((k for k, w in kept if len(w) == len(v) and np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()) <= near), None)
        if found is None or found is False:
            out[i] = i
            if v is not None:
                kept.append((i, v))
        else:
            out[i] = found
    return out


def made(n=300, width=24, seed=5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(40, width))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    x = middle[r.integers(0, 40, n)] + r.normal(size=(n, width)) * r.choice([0.0, 0.01, 0.03, 0.06], n)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, int(r.integers(1, 9)), v.tolist()) for i, v in enumerate(x)] + [(900, 3, None), (901, 3, None), (902, 4, [1.0, 0.0]), (903, 9, [0.9998, 0.02])]


def test_best_copies(spark):
    rows = made()
    got = {r.id: r.keeper for r in copies.best_copies(spark.createDataFrame(rows, "id long, area int, vector array<double>")).collect()}
    want = plain(rows, copies.NEAR)
    assert len(set(want.values())) < len(rows) / 2
    same = sum(got[i] == k for i, k in want.items())
    assert got.keys() == want.keys() and same >= 0.97 * len(want)
    # no row that stays is near another one that does, but for pairs that met in no bucket
    stay = [(i, v) for i, _, v in rows if got[i] == i and v is not None]
    assert sum(len(a) == len(b) and np.linalg.norm(np.array(a) - np.array(b)) <= copies.NEAR for k, (_, a) in enumerate(stay) for _, b in stay[:k]) <= 1


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    angle = 2 * np.arcsin(copies.NEAR / 2)
    b = np.cos(angle) * a + np.sin(angle) * side
    bits, tables = copies.tables_for(1_000_000)
    rows = spark.createDataFrame([(i, v.tolist(), w.tolist()) for i, (v, w) in enumerate(zip(a, b))], "id long, v array<double>, w array<double>")
    sides = copies.buckets(copies.buckets(rows, "v", bits, tables).withColumnRenamed("buckets", "x"), "w", bits, tables)
    assert sides.filter("arrays_overlap(x, buckets)").count() >= 0.965 * 2000


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, area int, vector array<float>")
    assert copies.best_copies(none).count() == 0
    one = spark.createDataFrame([(1, 1, None)], "id long, area int, vector array<float>")
    assert [tuple(r) for r in copies.best_copies(one).collect()] == [(1, 1)]


def test_every_near_pair_counts(spark):
    """Copies at the threshold, of which chance would miss some, with chains whose middles go."""
    r = np.random.default_rng(11)
    x = r.normal(size=(700, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = r.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    angle = 2 * np.arcsin(copies.NEAR / 2) * 0.999
    rows = [(5000 * s + i, int((i * 7 + s) % 5), (np.cos(s * angle) * v + np.sin(s * angle) * w).tolist()) for s in range(4) for i, (v, w) in enumerate(zip(x, side))]
    got = {a.id: a.keeper for a in copies.best_copies(spark.createDataFrame(rows, "id long, area int, vector array<double>")).collect()}
    assert got == plain(rows, copies.NEAR)


def test_repeated_ids(spark):
    rows = [(1, 5, [1.0, 0.0]), (1, 5, [0.0, 1.0]), (2, 4, [0.999, 0.001]), (3, 4, [0.001, 0.999]), (4, 4, [-1.0, 0.0])]
    got = sorted((a.id, a.keeper) for a in copies.best_copies(spark.createDataFrame(rows, "id long, area int, vector array<double>")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
