"""Time phrases, deal mapping, merging and condensing: written cases, and the folds against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import phrases
from larkspur.operators import deals
from larkspur.operators.folds import FirstFit

ALL = ("allDay", 0, 1440)


def span(a, b):
    return ("between", a, b)


#: What people write, and the hours that it stands for.
PHRASES = [
    (["FROM 3-7PM"], [span(900, 1140)]), (["1-5pm!"], [span(780, 1020)]), (["till 9pm"], [span(0, 1260)]), (["until 6.30pm"], [span(0, 1110)]), (["from 2pm til 8pm"], [span(840, 1200)]),
    (["5pm ’til 7pm"], [span(1020, 1140)]), (["12 'TIL 4PM"], [span(720, 960)]), (["AVAILABLE 6:15–8:45PM"], [span(1095, 1245)]), (["Available from noon - 3pm"], [span(720, 900)]),
    (["all day"], [ALL]), (["ALL-DAY", "allday"], [ALL]), (["all day", "5pm"], [ALL]), (["lunch"], [span(720, 840)]), (["TUE TO THU LUNCH"], [span(720, 840)]), (["LUNCH 10.30AM-2PM"], [span(630, 840)]),
    (["LUNCH & DINNER"], []), (["(10 AM - 1 PM )"], [span(600, 780)]), (["[*2pm-4pm*]"], [span(840, 960)]), (["**8PM till close**"], [("from", 1200, None)]), (["a start between 11am-2:15pm."], [span(660, 855)]),
    (["6PM — 9PM"], [span(1080, 1260)]), (["FROM 4PM", "DRAWN AT 6:30PM"], [span(960, 1110)]), (["30 TICKETS SOLD FROM 5PM DRAWN 7PM"], [span(1020, 1140)]), (["ON SALE FROM 5PM", "DRAWS FROM 7PM"], [span(1020, 1140)]),
    (["SALES 4.30PM DRAWS 6.30PM"], [span(990, 1110)]), (["1pm, 2:30pm & 4pm"], [span(780, 960)]), (["9PM - 3AM"], [span(1260, 1620)]), (["Time - 3pm-6pm"], [span(900, 1080)]), (["HAPPY HOUR 3-5PM"], [span(900, 1020)]),
    (["KITCHEN OPEN 6PM-9:30PM"], [span(1080, 1290)]), (["4 p.m. – 7 p.m."], [span(960, 1140)]), (["3 HRS FROM 1-5PM"], [span(780, 1020)]), (["• 6PM TO 11PM •"], [span(1080, 1380)]), (["4 Tº 7PM"], [span(960, 1140)]),
    (["ARRIVE AT 5:30PM for 6PM START"], [span(1050, 1440)]), (["5PM REGO FOR 5:30PM START"], [span(1020, 1440)]), (["6.30 pm", "-9.30 pm"], [span(1110, 1290)]), (["3-6pm", "6pm"], [span(900, 1080)]),
    (["6pm", "3-6pm", "3-6PM"], [span(900, 1080)]), (["630pm"], [("from", 1110, None)]), (["nothing here"], []), ([" "], []), ([], []), (None, []), ([None, "5pm"], [("from", 1020, None)]),
]


def test_phrases(spark):
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PHRASES)], "k int, p array<string>")
    got = {r.k: [tuple(x) for x in r.t] for r in rows.select("k", phrases.parse_times(F.col("p")).alias("t")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(PHRASES)}


RAW = "k int, title string, details array<string>, conditions array<string>, days array<string>, times array<string>, promotion_dates array<string>, source struct<type:string,url:string,source_url:string>, place int"


def raw(k, title=None, details=None, conditions=None, days=None, times=None, dates=None, source=("webpage", "https://a.example", None), place=0):
    return (k, title, details, conditions, days, times, dates, source, place)


@pytest.fixture(scope="module")
def mapped(spark):
    rows = [
        raw(0, "BURGER WEDNESDAYS", ["TEN DOLLAR BURGERS WITH CHIPS"], None, ["EVERY WED"], ["all day"]),
        raw(1, "TUESDAY", ["$12 schnitzel\nwith chips", "and salad"], ["* dine in only", "DINE IN ONLY"], ["tues"], ["5-9pm"]),
        raw(2, "FRIDAY", [], [], ["friday"], []),
        raw(3, "$15", ["Steak Night", "steak night", "$15 STEAK NIGHT"], [], ["Thursday through Saturday"], []),
        raw(4, "Pizza", ["$10", "Any 330ML can"], ["pizza", "any 330ml CAN", "ask staff"], ["everyday"], None),
        raw(5, "", ["half price", "Half-Price"], None, None, None),
        raw(6, "live MUSIC", ["x"], None, ["Sun"], None),
        raw(7, None, None, None, None, None),
        raw(8, "Monday - Jug's O'Clock 5PM - 7PM", None, None, ["Mon - Wed", " "], ["from 5pm till 7pm"]),
        raw(9, "MON", ["$9"], None, None, None),
    ]
    return deals.map_deals(spark.createDataFrame(rows, RAW), ["live music"]).cache()


def test_mapping(mapped):
    got = {r.k: (r.title, list(r.details), list(r.conditions), list(r.days), [tuple(t) for t in r.times]) for r in mapped.collect()}
    assert got == {
        0: ("Burger Wednesdays", ["Ten dollar burgers with chips"], [], ["wednesday"], [ALL]),
        1: ("$12 Schnitzel", ["With chips", "And salad"], ["dine in only"], ["tuesday"], [span(1020, 1260)]),
        3: ("$15 Steak Night", ["Steak night"], [], ["thursday", "friday", "saturday"], []),
        4: ("Pizza $10", ["Any 330ml can"], ["pizza", "ask staff"], ["everyDay"], []),
        5: ("half price", ["Half-price"], [], [], []),
        8: ("Jug's O'clock", [], [], ["monday", "tuesday", "wednesday"], [span(1020, 1140)]),
        9: ("$9", [], [], [], []),
    }


def test_processing(spark):
    rows = [
        raw(0, "Lunch plate", ["with soup"], None, ["Mon"], None), raw(1, "Dinner for two", None, None, ["Sat", "Sun"], ["till 9pm"]), raw(2, "Roast", None, None, [], None), raw(3, "Roast", None, None, [], None, ["until 3 May 2031"]),
        raw(4, "Roast", ["only on July 4, 2031"], None, ["Fri"], ["6pm"]), raw(5, "Trivia", ["first Tuesday of every month"], None, ["Tue"], None), raw(6, "Jugs", ["Dinner and lunch"], None, ["every day"], None, ["from 2 March", "9 June to 12 June", "x"], ("pdf", "https://a.example/m.pdf", "https://a.example/")),
        raw(7, "Lunch all day", None, None, ["Wed"], None),
    ]
    got = {r.k: r for r in deals.process_deals(spark.createDataFrame(rows, RAW), 2030).collect()}
    brief = {k: ([tuple(s) for s in r.schedules], str(r.start_date), str(r.end_date), r.status) for k, r in got.items()}
    assert brief == {
        0: ([(2, 720, 840)], "None", "None", "new"), 1: ([(7, 1020, 1260), (1, 1020, 1260)], "None", "None", "new"), 3: ([], "None", "2031-05-03", "new"), 4: ([(6, 1080, 1440)], "2031-07-04", "2031-07-04", "rejected"),
        5: ([(3, 0, 1440)], "None", "None", "rejected"), 6: ([(d, 0, 1440) for d in range(1, 8)], "2030-03-02", "2030-06-12", "new"), 7: ([(4, 0, 1440)], "None", "None", "new"),
    }
    assert (got[6].creative_url, got[6].source_url, got[0].creative_url, got[0].source_url) == ("https://a.example/m.pdf", "https://a.example/", None, "https://a.example")
    assert (got[0].title, got[0].details, got[0].conditions) == ("Lunch Plate", "With soup", None)


def test_merging_within_a_source(spark):
    rows = [
        raw(1, "Wings", ["Hot sauce"], ["ask"], ["Mon"], ["5pm"], place=1), raw(2, "Beer", ["hot SAUCE", "Jugs"], ["Ask", "wings", "jugs"], ["Tue"], ["4-6pm"], place=2),
        raw(3, "Wine", None, None, ["Tue"], ["7pm"], place=3), raw(4, "Gin", None, None, ["Tue"], None, place=4),
    ]
    base = deals.map_deals(spark.createDataFrame(rows, RAW)).select("title", "details", "conditions", "days", "times", "k", "place", F.col("source.url").alias("url"))
    got = [(r.title, list(r.details), list(r.conditions), list(r.days), [tuple(t) for t in r.times]) for r in deals.merge_source(base, "url", "place").orderBy("place").collect()]
    assert got == [("Wings", ["Hot sauce", "Jugs"], ["ask"], ["monday", "tuesday"], [("between", 960, 1080)]), ("Wine", [], [], ["tuesday"], [("from", 1140, None)])]
    timed = deals.supplement_times(base.withColumn("texts", F.array(F.lit("KITCHEN 6PM-9PM"), F.lit("nothing"))), "texts")
    assert {r.k: [tuple(t) for t in r.times] for r in timed.collect()}[4] == [span(1080, 1260)]
    assert {r.k: [tuple(t) for t in r.times] for r in deals.supplement_times(base.withColumn("texts", F.array(F.lit("nothing"))), "texts").collect()}[4] == [ALL]


def plain_condense(rows, words):
    """First fit by comparing each deal with all that were merged before."""
    out = []
    text = lambda r: " ".join(s for s in (r["title"], r["details"]) if s)
    key = lambda s: " ".join((s or "").lower().split())
    lines = lambda s: {key(x) for x in (s or "").split("\n") if x.strip()}
    for r in rows:
        for i, m in enumerate(out):
            same = key(m["title"]) == key(r["title"]) and lines(m["details"]) == lines(r["details"]) and lines(m["conditions"]) == lines(r["conditions"])
            on = {s[0] for s in m["schedules"]} == {s[0] for s in r["schedules"]}
            if same or (on and {w for w in words if w in text(m).lower()} & {w for w in words if w in text(r).lower()}):
                long = lambda d: len(" ".join(s for s in (d["title"], d["details"], d["conditions"]) if s))
                best, other = (m, r) if long(m) >= long(r) else (r, m)
                spans = list(dict.fromkeys(best["schedules"] + other["schedules"]))
                spans = [s for s in spans if not any(t != s and t[0] == s[0] and s[1] <= t[1] and t[2] <= s[2] for t in spans)]
                out[i] = best | {"creative_url": best["creative_url"] or other["creative_url"], "schedules": spans, "products": list(dict.fromkeys(best["products"] + other["products"])), "source_ids": list(dict.fromkeys(best["source_ids"] + other["source_ids"]))}
                break
        else:
            out.append(r)
    return out


def test_condensing(spark):
    r = random.Random(4)
    rows = []
    for venue in [1, 2, None]:
        for k in range(60):
            at = sorted({(r.randint(1, 2), s := 60 * r.randint(8, 12), s + 60 * r.randint(1, 5)) for _ in range(r.randint(0, 3))})
            rows.append({"venue_id": venue, "deal_id": k, "title": r.choice(["Wings night", "wings  NIGHT", "Beer", None, "Jug deal"]), "details": r.choice([None, "Cold beer\nhot wings", "hot  wings\nCold beer", "pies"]), "conditions": r.choice([None, "ask"]), "status": "new", "creative_url": r.choice([None, "c" + str(k)]), "source_url": "s" + str(k), "schedules": at, "products": r.sample(["a", "b", "c"], 2), "source_ids": [k % 7]})
    names = [f.split()[0] for f in deals.CONDENSED.split(", ")]
    table = spark.createDataFrame([tuple(x[n] for n in names) for x in rows], deals.CONDENSED).repartition(5)
    got = [{n: [tuple(s) for s in x[n]] if n == "schedules" else x[n] for n in names} for x in deals.condense(table, ["wings", "BEER"]).collect()]
    want = [m for v in (1, 2, None) for m in plain_condense([x for x in rows if x["venue_id"] == v], ["wings", "beer"])]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) < len(rows)
    assert deals.condense(table.limit(0), ["wings"]).count() == 0


def test_a_day_is_left_to_the_narrower_schedule(spark):
    names = [f.split()[0] for f in deals.CONDENSED.split(", ")]
    rows = [(1, k, "Roast lunch", "With all trimmings" if k == 2 else None, None, "new", "pic" if k == 1 else None, f"s{k}", at, ["roast"], [k]) for k, at in ((1, [(1, 0, 1440)]), (2, [(1, 720, 900)]))]
    one = deals.condense(spark.createDataFrame(rows, deals.CONDENSED), ["roast"]).collect()
    assert [(r.deal_id, r.creative_url, r.source_url, [tuple(s) for s in r.schedules], r.source_ids) for r in one] == [(2, "pic", "s2", [(1, 720, 900)], [2, 1])]
    assert set(names) == set(one[0].asDict())


def test_stale_keys_of_first_fit():
    fold = FirstFit(lambda r: {r["k"]}, lambda r: {r["w"]}, lambda a, b: {"k": b["k"], "w": a["w"]})
    for k, w in ((1, 0), (2, 1), (1, 1), (1, 2)):
        fold.add({"k": k, "w": w})
    assert [i["k"] for i in fold.items] == [1, 1]


def test_keys_of_a_row_that_stays_are_made_once():
    asked = []
    keys = lambda r: asked.append(r["k"]) or {r["k"]}
    fold = FirstFit(keys, keys, lambda a, b: a)
    for k in (1, 2, 1):
        fold.add({"k": k})
    assert [i["k"] for i in fold.items] == [1, 2] and asked == [1, 2, 1, 1]
