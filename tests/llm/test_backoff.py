"""The backoff automaton against one of dictionaries that is walked token by token."""

import math
import random
import zlib
from collections import Counter

import pytest

from larkspur.llm import backoff, lmscore


def naive(texts, train, order):
    """Scores by states that are tuples of words, arcs in a dictionary, and failure arcs where there is none."""
    end, counts = None, [Counter() for _ in range(order + 1)]
    for words, learn in zip(texts, train, strict=True):
        if learn:
            line = [*words, end]
            for i in range(len(line)):
                before = [end, *line[:i]]
                counts[1][(line[i],)] += 1
                for k in range(2, order + 1):
                    if len(before) >= k - 1:
                        counts[k][(*before[len(before) - k + 1 :], line[i])] += 1
    total, types = sum(counts[1].values()), len(counts[1])
    seen = lambda h: counts[len(h)][h]

    def chance(h, w):
        if not h:
            return (counts[1][(w,)] + 0.5) / (total + 0.5 * (types + 1))
        if not seen(h):
            return chance(h[1:], w)
        return (counts[len(h) + 1][(*h, w)] + lmscore.PRIOR * chance(h[1:], w)) / (seen(h) + lmscore.PRIOR)

    def state(h):
        h = h[max(0, len(h) - order + 1) :] if order > 1 else ()
        while h and not seen(h):
            h = h[1:]
        return h

    out = []
    for words in texts:
        at, score = state((end,)), 0.0
        for w in [*words, end]:
            while at and not counts[len(at) + 1][(*at, w)]:
                score += math.log10(lmscore.PRIOR / (seen(at) + lmscore.PRIOR))
                at = at[1:]
            score += math.log10(chance(at, w))
            at = state((*at, w))
        out.append(score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_a_naive_walk(spark, order):
    r = random.Random(order)
    texts = [[r.choice("abcdefg") * r.randint(1, 2) for _ in range(r.choice([0, 1, 2, 5, 40, 700]))] for _ in range(60)] + [[], ["rare"], ["a"] * 1500]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    train = [zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in rows]
    got = {x.doc_id: x.score for x in lmscore.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000, order=order).collect()}
    for k, want in enumerate(naive(texts, train, order)):
        assert got[k] == pytest.approx(want, abs=1e-7)


def test_pieces_carry_the_state(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    tokens = r.integers(0, 4, 3000)
    lengths = np.array([0, 1, 2999, 0])
    pairs = {(a, b): n for (a, b), n in Counter(zip(tokens[:-1].tolist(), tokens[1:].tolist())).items() if (a + b) % 3}
    keys = sorted(pairs)
    tables = [backoff.Grams(np.bincount(tokens, minlength=4).astype(float), np.zeros(0, int), np.zeros(0, int), np.arange(4)), backoff.Grams(np.array([pairs[k] for k in keys], float), np.array([a for a, _ in keys]), np.array([b for _, b in keys]), np.array([b for _, b in keys]))]
    machine = backoff.build(tables, np.full(4, 0.25), 4.0, 0)
    whole = backoff.walk(machine, tokens, lengths, 2)
    for size in (1, 2, 7, 512):
        monkeypatch.setattr(backoff, "PIECE", size)
        assert backoff.walk(machine, tokens, lengths, 2) == pytest.approx(whole)
    assert whole[0] == whole[3] == 0 and whole[2] < whole[1] < 0
