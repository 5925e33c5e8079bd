"""Written days and times, covered hours, links and search terms on hand-made values."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import parsing


def each(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    return [r["x"] for r in rows.select("k", function(F.col("v")).alias("x")).orderBy("k").collect()]


def test_minutes(spark):
    known = {"7:00": 1140, "11:30": 690, "12:00": 720, "630pm": 1110, "midnight": 0, "25:00": None, "4:99": None, "noon.": 720, "12am": 0, "5.30 PM": 1050, "6": 1080, "": None, "late": None}
    assert each(spark, parsing.minutes, [*known, None]) == [*known.values(), None]


def test_hours(spark):
    known = {
        "5pm-630pm": ("between", 1020, 1110), "Open - 6pm": ("between", 0, 1080), "lunch": ("between", 720, 840), "10PM - 2AM": ("between", 1320, 1560), "10PM – midnight": ("between", 1320, 1440),
        "1AM - 2AM": ("between", 60, 120), "All day": ("allDay", 0, 1440), "from 5pm": ("from", 1020, None), "4 to 6pm": ("between", 960, 1080), "6PM REGO FOR 6:30PM START": ("between", 1080, 1440), "whenever": None,
    }
    assert [x and tuple(x) for x in each(spark, parsing.hours, [*known, None])] == [*known.values(), None]


def test_distinct_hours(spark):
    def kept(*texts):
        row = spark.range(1).select(parsing.distinct_hours(F.array(*[parsing.hours(F.lit(t)) for t in texts])).alias("x")).first()
        return [(h["start"], h["end"]) for h in row["x"]]

    assert kept("4pm - 5pm", "5pm") == kept("5pm", "4pm - 5pm") == kept("4pm-5pm", "4pm-5pm") == [(960, 1020)]
    assert kept("4pm - 5pm", "all day") == [(0, 1440)]
    assert kept("4pm - 5pm", "6pm - 7pm") == [(960, 1020), (1080, 1140)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("FRI - MON", ["monday", "friday", "saturday", "sunday"]), ("CHEESEBURGER TUESDAYS", ["tuesday"]), ("EVERY DAY", ["everyDay"]), ("everyday", ["everyDay"]), ("Mon–Wed and Sat", ["monday", "tuesday", "wednesday", "saturday"]),
        ("weekends", ["saturday", "sunday"]), ("weekday lunch", list(parsing.WORKING)), ("Thurs until Fri", ["thursday", "friday"]), ("monitor sunny", []), ("", []), (None, []),
    ],
)
def test_days(spark, text, want):
    assert each(spark, parsing.days, [text]) == [want]


def test_links(spark):
    page = "<a class=x href=\"/a\">A</a><a href='/b#top'>B</a><a href=\"/a\">again</a><a href='#c'>C</a><area href='/d'>"
    assert each(spark, parsing.links, [page, None]) == [["/a", "/b"], []]


def test_search(spark):
    texts = ["Quiz-night beers", "quiz with a night", None, "BEER!"]
    assert each(spark, lambda v: parsing.matches_query(parsing.search_words(v), "quiz night, beer,"), texts) == [True, False, False, True]
    assert parsing.expand_terms(["Drinks", "beer"], {"drinks": ["beer", "wine"], "beer": ["pint", "drinks"]}, {"wine": ["vino"]}) == ["Drinks", "beer", "wine", "vino", "pint"]
