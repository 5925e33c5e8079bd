"""Blocks of written pages."""

import pytest

from larkspur.operators import blocks

PAGES = [
    (1, """<html><body><nav><a href="/menu">Menu</a></nav><main><h2>Our kitchen and bar, all week</h2><p>Meals are served every day from noon on.</p><p>Ask for the board.</p><a href="/book?x=1#top">Book</a><a href="/book?x=1">Again</a>
      <h3>Monday</h3><p>Steak $20</p><h3>On Tuesdays there is a quiz for all</h3><p>Teams of six.</p></main><footer><p>Write to us</p></footer></body></html>"""),
    (2, """<body><div>top of page</div><div id="content"><div><span>HAPPY HOUR EVERY DAY FROM FIVE TO SEVEN</span></div><ul><li>Jugs for fifteen dollars<li><b>Wings and ribs for everyone at the bar</b><li>Half price cocktails on the terrace</ul><p>plain <i>inner</i></p></div></body>"""),
    (3, """<main><div data-hook="item-title">Burger and chips with a drink</div><div data-hook="item-description">Any burger&nbsp;&amp; a schooner</div><h2>Sunday roast with all of it</h2><script>{"description":"Served \\"slow\\"\\n until four","title":"Sunday roast with all of it"}</script></main>"""),
    (4, None), (5, ""), (6, "no markup at all, only words of a page"), (7, "<main>x</main><article class='elementor-post'><p>" + "w " * 40 + "</p></article><article><p>" + "v " * 40 + "</p></article>"),
    (8, "<div>" * 3000 + "deep text" + "</div>" * 3000),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, "https://a.example/x/", h) for i, h in PAGES], "page_id long, url string, html string")
    out = {}
    for r in blocks.content_blocks(rows).orderBy("page_id", "block").collect():
        out.setdefault(r.page_id, []).append((r.title, r.text, [tuple(x) for x in r.links]))
    return out


def test_blocks(found):
    assert found[1] == [
        ("Our kitchen and bar, all week", "Meals are served every day from noon on.\nAsk for the board.\nMonday\nSteak $20", [("Book", "https://a.example/book?x=1")]),
        ("On Tuesdays there is a quiz for all", "Teams of six.", []),
    ]
    assert found[2] == [
        ("HAPPY HOUR EVERY DAY FROM FIVE TO SEVEN", "Jugs for fifteen dollars", []),
        ("Wings and ribs for everyone at the bar", "Half price cocktails on the terrace\ninner", []),
    ]
    assert found[3] == [("Burger and chips with a drink", "Any burger & a schooner", []), ("Sunday roast with all of it", 'Served "slow" until four', [])]


def test_odd_pages(found):
    assert 4 not in found and 5 not in found
    assert found[6] == [(None, "no markup at all, only words of a page", [])]
    assert found[7] == [(None, ("v " * 40).strip(), [])]
    assert found[8] == [(None, "deep text", [])]


def test_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = blocks.content_blocks(pages)
    assert got.select("page_id").distinct().count() >= 0.9 * pages.count()
    assert got.filter("title IS NULL AND text = '' AND size(links) = 0").count() == 0


def test_batches_of_pages_are_bounded(spark):
    rows = spark.range(0, 300, 1, 1).selectExpr("id AS page_id", "'https://a.example' AS url", "concat('<body><p>Pie and mash on Mondays, all day long, for ', id, '</p></body>') AS html")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = blocks.page_segments(rows).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(blocks.BATCH_BYTES) and blocks.PAGES < 300
    assert [(r.page_id, [s.text for s in r.segments]) for r in got] == [(k, [f"Pie and mash on Mondays, all day long, for {k}"]) for k in range(300)]
