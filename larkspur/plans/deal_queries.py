"""Queries from written offers to deals: hours in phrases, processed deals, deals condensed within their venue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases
from ..operators import deals
from ..sources.stored import spread
from .queries import query

_HALF = "CASE WHEN {0} < 12 THEN {0} || 'am' WHEN {0} = 12 THEN '12pm' ELSE ({0} - 12) || 'pm' END"


@query(
    "SELECT phrase, kind, s AS start, e AS \"end\", n FROM (SELECT phrase, n, CASE WHEN shape = 7 THEN 'from' WHEN shape = 8 THEN 'allDay' ELSE 'between' END AS kind, (CASE shape WHEN 2 THEN 0 WHEN 8 THEN 0 ELSE a * 60 + CASE shape WHEN 4 THEN 30 ELSE 0 END END)::INT AS s, (CASE shape WHEN 7 THEN NULL WHEN 8 THEN 1440 WHEN 5 THEN 1440 ELSE b * 60 + CASE WHEN (b < a OR (b = a AND shape = 4)) AND b < 10 AND shape <> 2 THEN 1440 ELSE 0 END END)::INT AS e FROM said_)",
    "num_ AS (SELECT (7 + l_quantity::INT % 12) AS a, (l_linenumber * 5 + 13) % 24 AS b, (l_orderkey % 10)::INT AS shape, count(*) AS n FROM lineitem GROUP BY ALL), "
    f"word_ AS (SELECT a, CASE WHEN b < 5 THEN b + 1 ELSE b END AS b, shape, n, {_HALF.format('a')} AS x, {_HALF.format('(CASE WHEN b < 5 THEN b + 1 ELSE b END)')} AS y FROM num_), "
    "said_ AS (SELECT CASE shape WHEN 0 THEN 'from ' || x || ' till ' || y WHEN 1 THEN '* ' || upper(x) || ' – ' || upper(y) || ' *' WHEN 2 THEN 'UNTIL ' || y WHEN 3 THEN 'Bistro open ' || x || '-' || y || ' daily' WHEN 4 THEN 'between ' || (CASE WHEN a > 12 THEN a - 12 ELSE a END) || '.30' || (CASE WHEN a < 12 THEN 'am' ELSE 'pm' END) || ' to ' || y WHEN 5 THEN 'ARRIVE AT ' || x || ' for a start' WHEN 6 THEN 'Happy hour ' || x || ' to ' || y WHEN 7 THEN 'from ' || x WHEN 8 THEN 'ALL DAY' ELSE 'Sold from ' || x || ' drawn at ' || y END AS phrase, a, b, shape, n FROM word_)",
)
def time_phrases(c):
    """Ten ways of writing hours of lines; each way is read once, and how often it is written is kept."""
    rows = c.table("lineitem").select((7 + F.col("l_quantity").cast("int") % 12).alias("a"), ((F.col("l_linenumber") * 5 + 13) % 24).alias("b"), (F.col("l_orderkey") % 10).cast("int").alias("shape"))
    rows = rows.withColumn("b", F.when(F.col("b") < 5, F.col("b") + 1).otherwise(F.col("b"))).groupBy("a", "b", "shape").agg(F.count(F.lit(1)).alias("n"))
    half = lambda h: F.when(h < 12, F.concat(h, F.lit("am"))).when(h == 12, "12pm").otherwise(F.concat(h - 12, F.lit("pm")))
    x, y, a = half(F.col("a")), half(F.col("b")), F.col("a")
    thirty = F.concat(F.when(a > 12, a - 12).otherwise(a), F.lit(".30"), F.when(a < 12, "am").otherwise("pm"))
    ways = [
        F.concat(F.lit("from "), x, F.lit(" till "), y), F.concat(F.lit("* "), F.upper(x), F.lit(" – "), F.upper(y), F.lit(" *")), F.concat(F.lit("UNTIL "), y), F.concat(F.lit("Bistro open "), x, F.lit("-"), y, F.lit(" daily")),
        F.concat(F.lit("between "), thirty, F.lit(" to "), y), F.concat(F.lit("ARRIVE AT "), x, F.lit(" for a start")), F.concat(F.lit("Happy hour "), x, F.lit(" to "), y), F.concat(F.lit("from "), x), F.lit("ALL DAY"), F.concat(F.lit("Sold from "), x, F.lit(" drawn at "), y),
    ]
    said = F.get(F.array(*ways), F.col("shape"))
    # from a generator: a filter that the planner makes of what is read from a phrase would go to each line else
    read = rows.select(F.explode(F.array(said)).alias("phrase"), "n")
    times = read.select("phrase").distinct().select("phrase", F.explode(phrases.parse_times(F.array("phrase"))).alias("t"))
    return read.join(times, "phrase").select("phrase", "t.kind", "t.start", "t.end", "n")


_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(
    f"SELECT p_partkey, {_NAME} || ' $' || p_size AS title, 'With ' || lower(p_type) || chr(10) || upper(p_name[1]) || lower(p_name[2:]) AS details, CASE WHEN p_partkey % 3 = 0 THEN 'dine in only' WHEN p_partkey % 11 = 0 THEN 'second Friday of each month' END AS conditions, "
    "CASE WHEN (p_partkey % 11 = 0 AND p_partkey % 3 > 0) OR p_partkey % 5 = 4 THEN 'rejected' ELSE 'new' END AS status, CASE WHEN p_partkey % 5 = 4 THEN DATE '2031-07-04' WHEN p_partkey % 5 = 3 THEN DATE '2030-03-02' END AS start_date, CASE p_partkey % 5 WHEN 4 THEN DATE '2031-07-04' WHEN 3 THEN DATE '2030-06-12' END AS end_date, "
    "(CASE WHEN p_partkey % 7 = 6 THEN '' WHEN p_partkey % 4 = 0 THEN d || ':0-1260' WHEN p_partkey % 4 = 1 THEN d || ':1020-1200' ELSE d || ':0-1440' END) AS schedules "
    "FROM (SELECT *, (p_partkey % 7 + 2) % 7 + CASE WHEN (p_partkey % 7 + 2) % 7 = 0 THEN 7 ELSE 0 END AS d FROM part) WHERE p_partkey % 7 <> 6 OR p_partkey % 5 IN (3, 4)"
)
def processed_deals(c):
    """An offer for each part, as a page would have it, processed to a deal; schedules are written as day:start-end."""
    k = F.col("p_partkey")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    none = F.array().cast("array<string>")
    raw = spread(c.table("part").select("p_partkey", "p_name", "p_type", "p_size")).select(
        "p_partkey", F.upper("p_name").alias("title"), F.array(F.concat(F.lit("$"), "p_size"), F.concat(F.lit("WITH "), F.upper("p_type")), F.upper("p_name")).alias("details"),
        F.when(k % 3 == 0, F.array(F.lit("* dine in only"), F.lit("Dine IN only"))).when(k % 11 == 0, F.array(F.lit("second Friday of each month"))).otherwise(none).alias("conditions"),
        F.array(pick(7, "every Monday", "TUES", "Wed", "thursday", "fri", "saturday", "")).alias("days"), F.array(pick(4, "till 9pm", "5pm-8pm", "all day", "")).alias("times"),
        F.when(k % 5 == 3, F.array(F.lit("from 2 March"), F.lit("9 June to 12 June"))).when(k % 5 == 4, F.array(F.lit("July 4, 2031"))).otherwise(none).alias("promotion_dates"),
        F.struct(F.lit("webpage").alias("type"), F.lit("https://a.example").alias("url"), F.lit(None).cast("string").alias("source_url")).alias("source"),
    )
    made = deals.process_deals(raw, 2030)
    written = F.array_join(F.transform("schedules", lambda s: F.concat(s["day"], F.lit(":"), s["start"], F.lit("-"), s["end"])), ",")
    return made.select("p_partkey", "title", "details", "conditions", "status", "start_date", "end_date", written.alias("schedules"))


@query()
def condensed_deals(c):
    """Orders as deals of their customer, merged where they say the same or name a priority on the same weekdays.

    SQL has no first-fit merge; a plain version is held against it in the tests.
    """
    at = c.schedule.groupBy("deal_id").agg(F.array_sort(F.collect_set(F.struct((F.col("day") % 2 + 1).cast("int").alias("day"), (F.col("start") - F.col("start") % 240).cast("int").alias("start"), (F.col("end") - F.col("end") % 240 + 240).cast("int").alias("end")))).alias("schedules"))
    k = F.col("o_orderkey")
    rows = c.table("orders").select(
        F.col("o_custkey").alias("venue_id"), k.alias("deal_id"), F.col("o_orderpriority").alias("title"), F.when(k % 3 > 0, F.concat(F.lit("priority "), F.lower("o_orderpriority"))).alias("details"), F.col("o_orderstatus").alias("conditions"),
        F.lit("new").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("c"), k)).alias("creative_url"), F.concat(F.lit("s"), k).alias("source_url"), F.array(F.concat(F.lit("p"), k % 5)).alias("products"), F.array(k % 9).alias("source_ids"),
    )
    table = rows.join(at, "deal_id", "left").withColumn("schedules", F.coalesce("schedules", F.array().cast("array<struct<day:int,start:int,end:int>>")))
    return deals.condense(table, ["urgent", "high", "low"])
