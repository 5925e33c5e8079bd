"""The five stages together, against brute force on the fixtures."""

import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from fixtures import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def test_stages(spark, tmp_path):
    leak = prose(77, 40)
    many = [(r[0], r[1], r[2], r[3]) for r in rows() if r[0] is not None] + [(50 + k, prose(500 + k, 60 + k), "en", "abc"[k % 3]) for k in range(20)]
    many += [(90, prose(90, 60) + " " + leak[: len(leak) // 2] + " " + prose(91, 60), "en", "a"), (91, " ".join(["same"] * 100), "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in many], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i1", leak), ("i2", None), ("i3", prose(78, 30))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50, 70)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path)).cache()
        found[name] = kept.collect()
        if name != "sharding":
            assert kept.columns == docs.columns

    # labels are all good, so no rule is learned and the base rule decides
    good = []
    for r in many:
        w = WORD.findall(r[1] or "")
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(inside) <= 50 * len(w):
            good.append(r)
    assert sorted(map(str, [tuple(r)[:4] for r in found["quality rules"]])) == sorted(map(str, good))

    unique = {(r[0], r[1]): r for r in good}
    sets = {k: shingles(k[1]) for k in unique}
    group = {k: k for k in unique}
    for _ in unique:
        for a in unique:
            for b in unique:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
    single = [unique[k] for k in unique if group[k] == k]
    assert len(single) < len(good) and sorted(map(str, [tuple(r)[:4] for r in found["near duplicates"]])) == sorted(map(str, single))

    windows = {tuple(w[k : k + 10]) for t in (leak, prose(78, 30)) for w in [[x.lower() for x in FOLDED.findall(t)]] for k in range(len(w) - 9)}
    clean = []
    for r in single:
        w = [x.lower() for x in FOLDED.findall(r[1])]
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append(r)
    assert len(clean) == len(single) - 1 and sorted(map(str, [tuple(r)[:4] for r in found["decontamination"]])) == sorted(map(str, clean))

    # of the mix: documents of the stage before, three times at most, each source within one document of its target
    times = collections.Counter((r["doc_id"], r["text"]) for r in found["mixing"])
    size = {(r[0], r[1]): len(WORD.findall(r[1])) for r in clean}
    assert set(times) <= set(size) and max(times.values()) <= 3
    by = collections.defaultdict(list)
    for r in clean:
        by[r[3]].append((r[0], r[1]))
    names = sorted(by, key=lambda x: (x is None, x or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    whole, total = {s: sum(size[k] for k in by[s]) for s in names}, sum(size.values())
    target, full = {}, set()
    while len(full) < len(names):
        rest, shares = total - sum(3 * whole[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3 * whole[s] if s in full else rest * weight[s] / shares for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * whole[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert abs(sum(times[k] * size[k] for k in by[s]) - target[s]) <= max(size[k] for k in by[s])

    shards = found["sharding"]
    assert collections.Counter((r["doc_id"], r["n_bytes"]) for r in shards) == collections.Counter((r["doc_id"], len(r["text"].encode())) for r in found["mixing"])
    sums = collections.Counter()
    for r in shards:
        sums[r["shard_id"]] += r["n_bytes"]
    assert all(sums[r["shard_id"]] == r["shard_bytes"] for r in shards)


def test_copies_part(spark):
    text = "word " * 100
    docs = spark.createDataFrame([(1, text)] * 3 + [(2, "a")], "doc_id long, text string")
    from larkspur.llm.sharding import shard_documents

    got = shard_documents(docs, max_bytes=700, part_copies=True)
    assert got.filter("oversize").count() == 0 and got.filter("doc_id = 1").select(F.count_distinct("shard_id")).first()[0] == 3
    assert shard_documents(docs, max_bytes=700).filter("oversize").count() == 3


def test_clashing_columns(spark, tmp_path):
    names = ["_key", "_times", "_copy", "key", "often", "shard_id", "row", "col", "times", "taken", "KEY_"]
    several = [(k, prose(900 + k, 60 + k), "en", "ab"[k % 2], 1) for k in range(12)] + [(3, prose(903, 63), "en", "b", 1)] * 2 + [(None, prose(950, 70), "en", None, 1), (3, prose(951, 70), None, "a", 1)]
    spark.createDataFrame([(*r, *names) for r in several], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i1", prose(904, 20))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[: 5 + len(names)] == ["doc_id", "text", "lang", "source", "n_chars", *names] and "shard_id_" in got.columns
    rows = got.collect()
    # the mix may leave whole documents of a source out, but takes no others
    assert rows and {(r["doc_id"], r["text"]) for r in rows} <= {(r[0], r[1]) for r in several if not r[1].startswith(prose(904, 20))}
    assert all([r[n] for n in names] == names for r in rows)


def test_write_shards_keeps_rows(spark, tmp_path):
    from larkspur.llm.sharding import write_shards

    rows = [(1, "ab", "x"), (1, "cd", "y"), (2, "ab", "z"), (2, "ab", "z"), (None, None, "w"), (None, "ab", None)]
    write_shards(spark.createDataFrame(rows, "doc_id long, text string, shard_id string"), f"{tmp_path}/out", max_bytes=3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert collections.Counter(map(tuple, back.select("doc_id", "text", "shard_id").collect())) == collections.Counter(rows) and "shard_id_" in back.columns


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).selectExpr("doc_id", "text", "lang", "source", "0L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
