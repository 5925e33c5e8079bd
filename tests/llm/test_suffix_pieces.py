"""Pieces of repeated passages: what their suffix arrays hold, and texts whose passages hold their core several times."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import dedup
from larkspur.llm.suffixes import suffix_array


def brute(texts):
    """(n_removed, n_spans, kept_sha256) of each text."""
    data = [t.encode() for t in texts]
    seen = collections.Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    out = []
    for b in data:
        cover = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        out.append((sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("spread", [8192, 1])
def test_periodic_and_short_texts(spark, monkeypatch, spread):
    monkeypatch.setattr(dedup, "SPREAD", spread)
    pick = random.Random(7)
    words = ["Lepa ", "ouaiè ", "a", "ab", "the the then ", "Dießung\n"]
    texts = []
    for _ in range(60):  # runs of one word between others, cut anywhere, many of them just over LENGTH bytes
        runs = "".join(pick.choice(words) * pick.randint(1, 60) for _ in range(pick.randint(1, 3)))
        first = pick.randint(0, 30)
        texts.append(runs[first : first + pick.choice([150, 198, 200, 205, 230, 260, 263, 400, 900])])
    passage = "".join(pick.choice("etaoin shrdluéß") for _ in range(230))
    texts += [passage[k : k + n] for k in range(0, 30, 5) for n in (190, 195, 200)] + [passage[:99] + "x" + passage[99:] + y for y in "pq"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in dedup.remove_repeats(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_pieces_hold_no_core():
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(700))
    scanned = text.encode()
    places, _, _ = dedup.anchors(np.frombuffer(scanned, np.uint8), np.array([0, len(scanned)]), dedup.LENGTH)
    at = pa.array([places.astype(np.int32).tolist()], pa.list_(pa.int32()))
    (pieces,) = dedup._piece_rows(iter([pa.RecordBatch.from_arrays([pa.array([text]), pa.array([5]), at], ["t", "th", "at"])]))
    refs = [r | {"kinds": 2, "copies": 1} for r in pieces.to_pylist()]
    (out,) = dedup._piece_bytes(iter([pa.RecordBatch.from_arrays([pa.array([text]), pa.array([5]), pa.array([refs])], ["t", "th", "refs"])]))
    assert len(refs) > 5 and any(r["n"] < 263 for r in refs)
    for ref, row in zip(refs, out.to_pylist(), strict=True):
        whole = scanned[ref["start"] : ref["start"] + ref["n"]]
        assert len(row["data"]) == ref["n"] - dedup.CORE + 1 < 2 * dedup.PIECE
        left, right = row["data"].split(dedup.CORE_MARK)
        assert whole == left + whole[len(left) : len(left) + dedup.CORE] + right


def test_suffix_array_puts_equal_suffixes_in_order_of_places():
    pick = random.Random(3)
    pieces = [bytes(pick.choice(b"ab") for _ in range(pick.randint(0, 20))) for _ in range(40)]
    symbols = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    held = symbols.tobytes()
    want = sorted(range(len(held)), key=lambda k: (held[k : held.index(b"\0", k)], k))
    assert suffix_array(symbols, 32).tolist() == want
