"""Rows with nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with the operators'."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, key long, size long, t string"


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(words))


def rows():
    base = prose(1, 120)
    changed = base.split()
    changed[60] = "other"
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(changed), "en", None), (4, prose(2, 80), "de", "b"), (5, None, "de", "b"), (6, "", None, None),
        (7, prose(3, 30) + "\n" + base[:260] + "\n" + prose(4, 30), "en", "a"), (8, "one two", "en", "c"), (9, prose(5, 6000), "de", "a"), (9, prose(5, 6000), "de", "a"),
        (None, prose(6, 90), "en", "a"), (None, base, "en", "b"), (10, "ab " * 200, "en", "c"), (11, "x\ny\nx\n\n# $ %", "en", "c"), (12, "Über éa ŝ " * 30, "de", "b"),
    ]
    return [(*r, 7, 8, "clash") for r in out]
