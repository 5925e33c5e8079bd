"""Product spans and prices, against a plain version and by cases."""

import random
import re

import pytest

from larkspur.operators import products as P

CATALOGUE = [
    P.Product("beer", 4, ["lager"], "b"), P.Product("craft beer", 3, [], "b"), P.Product("wine", None, ["house wine"], "w"), P.Product("wings", 5, ["wing"], "f"),
    P.Product("bottomless", 1, [], "x"), P.Product("bottomless brunch", 2, [], "x"), P.Product("pool table", None, [], "g"), P.Product("happy hour", 6, [], "h", priced=False), P.Product("fish & chips", 7, ["chips"], "f"), P.Product("music", 8, [], None),
]


def plain_spans(text):
    text = text.lower()
    cover = [m.span() for w in P.IGNORED for m in re.finditer(rf"(?<![a-z0-9]){re.escape(w)}(?:es|s)?(?![a-z0-9])", text)]
    cover += [m.span() for m in re.finditer(P.SIDES, text)]
    order = sorted((p for p in CATALOGUE if p.icon), key=lambda p: (p.rank is None, p.rank or 0, -len(p.name)))
    spans = [(m.start(), m.end(), p.name) for p in order for n in p.names for m in re.finditer(rf"(?<![a-z0-9]){re.escape(n)}(?:es|s)?(?![a-z0-9])", text)]
    spans = [s for s in spans if not any(c[0] <= s[0] and s[1] <= c[1] for c in cover)]
    taken = []
    for s in sorted(spans, key=lambda s: s[0] - s[1]):
        if not any(t[0] <= s[0] and s[1] <= t[1] for t in taken):
            taken.append(s)
    return sorted({s[2] for s in taken})


def test_spans_equal_a_plain_search(spark):
    rng = random.Random(5)
    words = ["beer", "beers", "craft", "lager", "wine", "house", "wings", "wing", "bottomless", "brunch", "pool", "table", "prize", "fish", "&", "chips", "down", "beer battered", "with", "w/", "$5", "\n", ",", "red", "jus", "pot of cash", "x", "music"]
    texts = [(k, "".join(w + rng.choice([" ", " ", " ", "", "\n", "-"]) for w in rng.choices(words, k=rng.randint(0, 25)))) for k in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "Beer " * 3_000 + "craft beer"), (1003, "BEER, beer; beer")]
    got = {}
    for r in P.product_spans(spark.createDataFrame(texts, "id long, t string"), "id", "t", CATALOGUE).select("id", "product").distinct().collect():
        got.setdefault(r["id"], []).append(r["product"])
    assert {k: sorted(v) for k, v in got.items()} == {k: s for k, t in texts if (s := plain_spans(t or ""))}


def extracted(spark, *deals):
    rows = spark.createDataFrame([(k, *d) for k, d in enumerate(deals)], "id long, title string, details string")
    out = [{} for _ in deals]
    for r in P.extract_products(rows, "id", "title", "details", CATALOGUE).collect():
        out[r["id"]][r["product"]] = r["price"]
    return out


def test_prices(spark):
    cases = {
        ("$8 beers", None): {"beer": 8.0},
        ("Happy Hour $8", "wine $9.50"): {"happy hour": None, "wine": 9.5},
        ("$5 beer, wine and chips", None): {"beer": 5.0, "wine": 5.0, "fish & chips": 5.0},
        ("$5 beer or wine", None): {"beer": 5.0, "wine": None},
        ("Craft beer $9, wine", None): {"craft beer": None, "wine": 9.0},
        ("Craft beer $9", "$7 lager"): {"craft beer": 9.0, "beer": 7.0},
        ("$10 off beer", None): {"beer": None},
        ("Save up to $10 beer", "$4 beer"): {"beer": 4.0},
        ("Beer $10 off $8", None): {"beer": 8.0},
        ("Wings $3 $4 beer", "beer $2"): {"wings": 3.0, "beer": 4.0},
        ("Bottomless brunch", "$50 wine"): {"bottomless brunch": None},
        ("Bottomless", "wine"): {"bottomless": None},
        ("Beer with wine", "w/ chips"): {"beer": None},
        ("wings with $5 beers", None): {"wings": None, "beer": 5.0},
        (None, None): {},
        ("$", "$x"): {},
    }
    assert extracted(spark, *cases) == list(cases.values())


def test_title_before_details_and_tally(spark):
    rows = spark.createDataFrame([(1, "beer", "wine"), (2, "x", "wine, beers"), (3, None, "wings"), (4, "", None)], "id long, title string, details string")
    matched = P.match_products(rows, "id", "title", "details", CATALOGUE)
    assert sorted((r["id"], r["product"]) for r in matched.collect()) == [(1, "beer"), (2, "beer"), (2, "wine"), (3, "wings")]
    tally = P.product_tally(matched, {"beer": "drink", "wine": "drink", "wings": "food"})
    assert sorted(map(tuple, tally.collect())) == [("drink", "beer", 2), ("drink", "wine", 1), ("food", "wings", 1)]


def test_names_that_cannot_be_found(spark):
    for name in ("pie!", "chips with gravy"):
        with pytest.raises(ValueError):
            P.names_table(spark, [P.Product(name, 1, [], "i")])
    assert P.product_spans(spark.createDataFrame([], "id long, t string"), "id", "t", CATALOGUE).count() == 0
