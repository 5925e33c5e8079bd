"""Texts and labels of deals, case by case."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from larkspur.functions import deal_text as D
from larkspur.functions import labels as L


def values(spark, f, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["v"] for r in rows.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_titles(spark):
    want = {
        "Soup Night": "Soup Night", "  $8 Cider ": "$8 Cider", "": "", "   ": "", "*Soup Night*": "Soup Night", "TUESDAY Soup Night": "Soup Night", "Monday : Soup Night": "Soup Night", "Monday: Soup": "Soup",
        "Soup Night Thurs": "Soup Night", "Soup Tuesdays": "Soup Tuesdays", "Sunday": "", "Soup Available From 12PM": "Soup", "$19 Soup 4PM - 6PM": "$19 Soup", "Soup Hour 4PM 'til 6PM": "Soup Hour", "Soup Hour 4PM –": "Soup Hour",
        "Soup From 12PM": "Soup", "Soup 6:30PM": "Soup", "Soup 430pm": "Soup", "Soups From $20": "Soups From $20", "Soup From": "Soup", "Soup Night every": "Soup Night", "Every": "Every", "Soup &": "Soup", "Soup & Bread": "Soup & Bread",
        "and Soup and": "Soup", "Friday and Saturday Soup from 5pm to 7pm": "Soup", "Soup 99pm": "Soup 99pm",
    }
    assert values(spark, D.trim_title, *want, None) == [*want.values(), None]


def test_cases(spark):
    want = {"2FOR1 half-price": "2For1 Half-Price", "WON'T wait": "Won't Wait", "'tis": "'Tis", "500ML jug 5PM": "500ml Jug 5pm", "$10PP": "$10PP", "": "", "étude ÀLA": "Étude Àla", "a''b": "A''B"}
    assert values(spark, D.format_title, *want) == list(want.values())
    want = {"SOUP AND 2 Breads\n  *from 5PM": "Soup and 2 breads\n  *From 5pm", "123": "123", "": "", "a\n\nB": "A\n\nB"}
    assert values(spark, D.sentence_case, *want) == list(want.values())
    assert values(spark, D.comparison_key, "  A \t b\n C ", "") == ["a b c", ""]
    assert values(spark, D.condition, "* Members only", "\\* x", "*", " y ") == ["Members only", "x", None, "y"]
    assert values(spark, D.is_price_line, "$10", "$ 12.50pp", "Half-price", "$10 off") == [True, True, True, False]


def test_promotion_dates(spark):
    d = date
    want = {
        "Friday, 14 November – Monday, 1 December 2025": (d(2025, 11, 14), d(2025, 12, 1)), "14 November 2025": (d(2025, 11, 14),) * 2, "until 31 December 2025.": (None, d(2025, 12, 31)), "from July 26, 2026": (d(2026, 7, 26), None),
        "From 18th May through to the end of June": (d(2027, 5, 18), d(2027, 6, 30)), "Black Friday only": (None, None), "31 February": (None, None), "12th September": (d(2027, 9, 12),) * 2, "1 March 2026 to 3 April": (d(2026, 3, 1), d(2026, 4, 3)), "": (None, None),
    }
    assert [tuple(v) for v in values(spark, lambda t: D.promotion_dates(t, 2027), *want)] == list(want.values())


@pytest.mark.parametrize(
    ("f", "yes", "no"),
    [
        (D.has_date, ["on 12th of May", "Sat Nov l2", "2026-01-31", "3/4/26", "DEC 5", "МАY 7"], ["every Monday at 5", "maybe", "", None]),
        (lambda t: D.other_months(t, 12), ["IN MARCH", "in Nov and in December"], ["in December", "in January", "in time", None]),
        (D.nth_weekday, ["First Tuesday of each Month", "3rd fri\nof the month", "(first/second/third/fourth/last) Sun of (each/every/the) month"], ["every Tuesday", "first of the month", None]),
        (lambda t: D.is_deal(t, ["soup"], ["expired"], ["mother's day"]), ["Soup on Monday", "$5 cups from 5pm", "half-price weekdays"], ["soup", "Monday", "Soup Monday Mothers Day", "Soup on Monday 5 May", "expired soup Monday", "", None]),
        (lambda t: D.current_document(t, 2026), ["https://a.b/menu.pdf", "https://a.b/2026/m.pdf", "https://a.b/x?y=2001"], ["https://a.b/2025/m.pdf"]),
    ],
)
def test_filters(spark, f, yes, no):
    assert values(spark, f, *yes, *no) == [True] * len(yes) + [False] * len(no)


def test_addresses_and_pictures(spark):
    got = values(spark, D.address_parts, "1 Low St, Glebe NSW 2037, Australia", "Mount Gambier sa 5290", "1 Low St, Otago 9010", "", None)
    assert [tuple(x) if x else None for x in got] == [("Glebe", "NSW", "2037"), ("Mount Gambier", "SA", "5290"), None, None, None]
    assert values(spark, lambda t: D.thumbnail(t, "venues"), "https://a.b/venues/12.JPG", "https://a.b/venues/x.jpg", " ", None) == ["https://a.b/venues/12-thumb.jpg", "https://a.b/venues/x.jpg", None, None]
    assert values(spark, D.import_status, "https://a.b", "  ", None) == ["normal", "broken", "broken"]


def test_times(spark):
    assert values(spark, L.time_input, "5", "5pm", "12am", "12:30 PM", "13", "5:60", "0:15", "x", None) == [300, 1020, 0, 750, None, None, 15, None, None]
    rows = spark.createDataFrame([(0, 1080), (1170, 1440), (660, 840), (1020, 1140), (690, 750), (1320, 1560)], "a int, b int")
    assert [r[0] for r in rows.select(L.compact_range(F.col("a"), F.col("b"))).collect()] == ["Until 6pm", "From 7:30pm", "11am-2pm", "5-7pm", "11:30am-12:30pm", "10pm-2am"]
    days = spark.createDataFrame([(1, 2, 1020, 1140), (1, 3, 1020, 1140), (1, 3, 1020, 1140), (2, 2, 0, 1440), (3, 2, 600, 660), (3, 3, 0, 1440), (4, 2, 0, 1440), (4, 2, 1020, 1140)], "k int, day int, start int, end int")
    assert {r["k"]: r["badge"] for r in L.time_badges(days, "k").collect()} == {1: "5-7pm", 2: "", 3: "Various", 4: "5-7pm"}
    dates = spark.createDataFrame([(date(2025, 11, 14), date(2025, 12, 1)), (date(2025, 12, 25),) * 2, (date(2025, 3, 2), None), (None, date(2025, 3, 2)), (None, None)], "a date, b date")
    assert [r[0] for r in dates.select(L.date_range(F.col("a"), F.col("b"))).collect()] == ["14 Nov 2025 – 1 Dec 2025", "25 Dec 2025", "From 2 Mar 2025", "Until 2 Mar 2025", None]


def test_opening_hours(spark):
    period = lambda *p: '{"regularOpeningHours": {"periods": [' + ", ".join(p) + "]}}"
    got = values(
        spark, L.opening_hours, period('{"open": {"day": 0, "hour": 0}}'), period('{"open": {"day": 6, "hour": 18, "minute": 30}, "close": {"day": 0, "hour": 2, "minute": 0}}', '{"open": {"day": 1, "hour": 9}, "close": {"day": 1, "hour": 9}}'),
        period('{"open": {"day": 7, "hour": 9}}'), period('{"open": {"day": 2, "hour": 24}}'), period(), "{}", "x", None,
    )
    assert [[tuple(x) for x in g] if g else None for g in got] == [[(1, 0, 1440)], [(7, 1110, 1560)], None, None, None, None, None, None]
