"""Queries over texts and labels of deals: products and prices, titles, dates, times, opening hours, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import deal_text, english, labels, weekly
from ..operators import products
from .queries import query

#: A catalogue over words that the tables have.
WORDS = [
    products.Product("the", 2, ["this"], "a"), products.Product("of the", 1, ["to the"], "b"), products.Product("that", None, ["than"], "c"), products.Product("and", 3, [], "d"),
    products.Product("bottomless", 4, [], "e"), products.Product("der", 5, ["die"], "f"), products.Product("de la", None, [], "g"), products.Product("was", 6, [], None),
]
PARTS = [products.Product(n, k, [], "x", priced=n != "gear") for k, n in enumerate(("widget", "bolt", "rod", "gear", "economy", "promo"))]

_CATALOGUE = "cat AS (SELECT n || e AS written, p AS product, k AS place, m AS pieces FROM (VALUES ('of the', 'of the', 0, 3), ('to the', 'of the', 0, 3), ('the', 'the', 1, 1), ('this', 'the', 1, 1), ('and', 'and', 2, 1), ('bottomless', 'bottomless', 3, 1), ('der', 'der', 4, 1), ('die', 'der', 4, 1), ('de la', 'de la', 5, 3), ('that', 'that', 6, 1), ('than', 'that', 6, 1), ('chips down', NULL, -1, 3), ('beer battered', NULL, -1, 3), ('prize pool', NULL, -1, 3)) t(n, p, k, m), unnest(['', 's', 'es']) u(e))"


def _spans_sql(parts: str) -> str:
    """CTEs that end in spans_ (doc_id, part, product, pos, pieces), from (doc_id, part, t)."""
    return (
        f"{_CATALOGUE}, cut_ AS (SELECT doc_id, part, regexp_replace(regexp_replace(lower(t), '\\b(?:with|w/)(\\s*\\$\\d)', '~\\1', 'g'), '\\b(?:with|w/)[^\\n]*', '', 'g') AS t FROM ({parts})), "
        "word_ AS (SELECT doc_id, part, unnest(p) AS w, unnest(range(len(p))) AS pos FROM (SELECT doc_id, part, regexp_extract_all(t, '[a-z0-9]+|[^a-z0-9]+') AS p FROM cut_)), "
        "next_ AS (SELECT doc_id, part, pos, w, w || lead(w, 1) OVER o || lead(w, 2) OVER o AS w3 FROM word_ WINDOW o AS (PARTITION BY doc_id, part ORDER BY pos)), "
        "hit_ AS (SELECT doc_id, part, pos, pieces, product, place FROM next_ JOIN cat ON pieces = 1 AND w = written UNION ALL SELECT doc_id, part, pos, pieces, product, place FROM next_ JOIN cat ON pieces = 3 AND w3 = written), "
        "spans_ AS (SELECT * FROM (SELECT *, coalesce(max(pos + pieces) OVER (PARTITION BY doc_id, part ORDER BY pos, pieces DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= pos + pieces, false) AS covered FROM hit_) WHERE NOT covered AND product IS NOT NULL)"
    )


_FIRST_LINE = "coalesce(string_split(text, chr(10))[1], '')"
_SPLIT = f"SELECT doc_id, 0 AS part, {_FIRST_LINE} AS t FROM documents UNION ALL SELECT doc_id, 1, substr(text, length({_FIRST_LINE}) + 2) FROM documents"


@query("SELECT doc_id, product, count(*) AS n, min(pos)::INT AS first_at FROM spans_ GROUP BY ALL", _spans_sql("SELECT doc_id, 0 AS part, text AS t FROM documents"))
def product_spans(c):
    spans = products.product_spans(c.table("documents"), "doc_id", "text", WORDS)
    return spans.groupBy("doc_id", "product").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


@query("SELECT DISTINCT doc_id, product FROM spans_ s WHERE part = (SELECT min(part) FROM spans_ f WHERE f.doc_id = s.doc_id)", _spans_sql(_SPLIT))
def products_of_titles_first(c):
    rows = c.table("documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("details"))
    return products.match_products(rows, "doc_id", "title", "details", WORDS).select("doc_id", "product")


@query("SELECT kind, product, count(DISTINCT doc_id) AS n FROM spans_ JOIN (VALUES ('the', 'article'), ('der', 'article'), ('that', 'pronoun'), ('of the', 'phrase')) k(product, kind) USING (product) GROUP BY ALL", _spans_sql("SELECT doc_id, 0 AS part, replace(text, chr(10), ' ') AS t FROM documents"))
def product_tally(c):
    rows = c.table("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("title"), F.lit(None).cast("string").alias("details"))
    matched = products.match_products(rows, "doc_id", "title", "details", WORDS)
    return products.product_tally(matched, {"the": "article", "der": "article", "that": "pronoun", "of the": "phrase"})


@query(
    "SELECT p_partkey, product, CASE WHEN product = 'gear' THEN NULL WHEN product IN ('economy', 'promo') THEN p_size + 0.5::DOUBLE WHEN p_type NOT IN ('ECONOMY', 'PROMO') THEN p_size + 0.5::DOUBLE END AS price FROM part, unnest(['widget', 'bolt', 'rod', 'gear', 'economy', 'promo']) u(product) WHERE contains(p_name, product) OR lower(p_type) = product"
)
def product_prices(c):
    """A price goes to the type that follows it, else to the part before it."""
    details = F.concat(F.lit("save $2, now $"), F.col("p_size").cast("string"), F.lit(".50 "), F.col("p_type"))
    rows = c.table("part").select("p_partkey", F.lit(None).cast("string").alias("title"), F.concat_ws(" ", "p_name", details).alias("details"))
    return products.extract_products(rows, "p_partkey", "title", "details", PARTS).select("p_partkey", "product", "price")


_CAPITALS = "array_to_string(list_transform(regexp_extract_all(text, '\\p{L}+(?:[''’]\\p{L}+)*|\\P{L}+'), lambda w: CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || lower(w[2:])), '')"


@query(f"SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN {_CAPITALS} END AS title, array_to_string(list_transform(string_split(text, chr(10)), lambda s: regexp_extract(lower(s), '^\\P{{L}}*') || replace(upper(substr(lower(s), length(regexp_extract(lower(s), '^\\P{{L}}*')) + 1, 1)), 'ß', 'SS') || substr(lower(s), length(regexp_extract(lower(s), '^\\P{{L}}*')) + 2)), chr(10)) AS sentence FROM conversations")
def written_cases(c):
    return c.table("conversations").select("conv_id", "turn", deal_text.capitalised(F.col("text")).alias("title"), deal_text.sentence_case(F.col("text")).alias("sentence"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 3 THEN o_orderdate::DATE END AS start_date, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 2 THEN o_orderdate::DATE WHEN 3 THEN last_day(o_orderdate::DATE) END AS end_date FROM orders")
def promotion_dates(c):
    """Dates as people write them, read back."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    day, month = F.date_format(d, "d MMMM yyyy"), F.date_format(d, "EEEE, MMMM d")
    line = F.when(k == 0, day).when(k == 1, F.concat(F.lit("from "), month, F.lit("th, "), F.year(d))).when(k == 2, F.concat(F.lit("Until "), day, F.lit("."))).otherwise(F.concat(day, F.lit(" – "), F.date_format(F.last_day(d), "d MMMM")))
    read = c.table("orders").select("o_orderkey", deal_text.promotion_dates(line, 2000).alias("r"))
    return read.select("o_orderkey", F.col("r.start").alias("start_date"), F.col("r.end").alias("end_date"))


_MONTH = deal_text.MONTH
_DATED = " OR ".join(f"regexp_matches(t, '{p}')" for p in deal_text.DATED)


@query(
    f"SELECT doc_id, {_DATED} AS dated, list_filter(regexp_extract_all(t, '(?i)\\bin\\s+({_MONTH})\\b', 1), lambda m: lower(m[1:3]) NOT IN ('may', 'jun')) <> [] AS other_month, regexp_matches(t, '\\$\\s*[0-9]+(?:\\.[0-9]{{2}})?|(?i)\\bhalf[\\s-]?price\\b') AS priced, contains(lower(text), 'license') OR contains(lower(text), 'password') AS keyword FROM (SELECT doc_id, text, translate(text, '{deal_text.LOOKALIKES[0]}', '{deal_text.LOOKALIKES[1]}') AS t FROM documents)"
)
def text_detectors(c):
    t = F.col("text")
    return c.table("documents").select("doc_id", deal_text.has_date(t).alias("dated"), deal_text.other_months(t, 5).alias("other_month"), deal_text.has_price(t).alias("priced"), deal_text.has_keyword(t, ["License", "password"]).alias("keyword"))


def _compact_sql(m: str) -> str:
    return f"(CASE WHEN ({m}) // 60 % 12 = 0 THEN 12 ELSE ({m}) // 60 % 12 END)::VARCHAR || CASE WHEN ({m}) % 60 = 0 THEN '' ELSE ':' || lpad((({m}) % 60)::VARCHAR, 2, '0') END"


_HALF = lambda m: f"CASE WHEN ({m}) < 720 THEN 'am' ELSE 'pm' END"
_RANGE = (
    f"CASE WHEN s % 1440 = 0 THEN 'Until ' || {_compact_sql('e % 1440')} || {_HALF('e % 1440')} WHEN e % 1440 = 0 THEN 'From ' || {_compact_sql('s % 1440')} || {_HALF('s % 1440')} "
    f"ELSE {_compact_sql('s % 1440')} || CASE WHEN (s >= 720) <> (e % 1440 >= 720) THEN {_HALF('s % 1440')} ELSE '' END || '-' || {_compact_sql('e % 1440')} || {_HALF('e % 1440')} END"
)


@query(
    "SELECT deal_id, CASE WHEN count(DISTINCT times) > 1 THEN 'Various' ELSE min(label) END AS badge FROM per_day GROUP BY deal_id",
    f"per_day AS (SELECT deal_id, day, string_agg(s || '-' || e, ',' ORDER BY s, e) AS times, coalesce(string_agg(label, ', ' ORDER BY s, e) FILTER (label <> ''), '') AS label FROM (SELECT DISTINCT deal_id, day, s, e, CASE WHEN s = 0 AND e >= 1440 THEN '' ELSE {_RANGE} END AS label FROM schedule_) GROUP BY ALL)",
)
def time_badges(c):
    return labels.time_badges(c.schedule, "deal_id")


@query("SELECT deal_id, CASE k WHEN 0 THEN a WHEN 1 THEN a || ' – ' || b WHEN 2 THEN 'From ' || a WHEN 3 THEN 'Until ' || b END AS label FROM (SELECT deal_id, deal_id % 5 AS k, strftime(start_date, '%-d %b %Y') AS a, strftime(start_date + 9, '%-d %b %Y') AS b FROM deal_)")
def date_labels(c):
    k, a = F.col("deal_id") % 5, F.col("start_date")
    start, end = F.when(k.isin(0, 1, 2), a), F.when(k == 0, a).when(k.isin(1, 3), F.date_add(a, 9))
    return c.deal.select("deal_id", labels.date_range(start, end).alias("label"))


@query("SELECT schedule_id, s AS start, e AS \"end\", greatest(600, least(1440, ((s + 30) // 60) * 60))::INT AS snapped, s % 1440 // 60 * 60 + s % 60 AS read_back FROM schedule_")
def filter_hours(c):
    return c.schedule.select("schedule_id", "start", "end", labels.snap_to_hour(F.col("start")).alias("snapped"), labels.time_input(weekly.clock(F.col("start"))).alias("read_back"))


@query("SELECT venue_id, (venue_id % 7 + 1)::INT AS day, (venue_id % 24 * 60 + venue_id % 60)::INT AS start, (CASE WHEN venue_id % 3 = 0 THEN 1440 ELSE (venue_id % 2) * 1440 + (venue_id * 5) % 24 * 60 END)::INT AS \"end\" FROM venue_ WHERE venue_id % 3 = 0 OR (venue_id % 2) * 1440 + (venue_id * 5) % 24 * 60 > venue_id % 24 * 60 + venue_id % 60")
def opening_hours(c):
    k = F.col("venue_id")
    at = lambda day, hour, minute: F.struct(day.cast("int").alias("day"), hour.cast("int").alias("hour"), minute.cast("int").alias("minute"))
    close = F.when(k % 3 != 0, at((k + k % 2) % 7, (k * 5) % 24, F.lit(0)))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(at(k % 7, k % 24, k % 60).alias("open"), close.alias("close"))).alias("periods")).alias("regularOpeningHours")))
    read = c.venue.select("venue_id", F.explode(labels.opening_hours(payload)).alias("h"))
    return read.select("venue_id", "h.day", "h.start", "h.end")


@query("SELECT venue_id, trim(suburb) AS suburb, 'NSW' AS state, postcode FROM venue_ JOIN suburb_ USING (suburb_id)")
def address_parts(c):
    line = F.concat(F.col("venue_id").cast("string"), F.lit(" Low St, "), F.col("suburb"), F.lit(" nsw "), F.col("postcode"), F.when(F.col("venue_id") % 2 == 0, ", Australia").otherwise(""))
    read = c.venue.join(c.suburb.select("suburb_id", "suburb", "postcode"), "suburb_id").select("venue_id", deal_text.address_parts(line).alias("a"))
    return read.select("venue_id", "a.suburb", "a.state", "a.postcode")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN '' ELSE p_name END AS title FROM part")
def trimmed_titles(c):
    """Names between days and times, without them."""
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat(F.lit("Tuesday: "), F.col("p_name"), F.lit(" 4PM - 6PM"))).when(k == 1, F.concat(F.lit("*"), F.col("p_name"), F.lit(" every Fri"))).when(k == 2, F.concat_ws(" ", F.lit("and"), "p_name", F.lit("available from 630pm &"))).otherwise(F.lit("Mon"))
    return c.table("part").select("p_partkey", deal_text.trim_title(title).alias("title"))


@query()
def text_search_stems(c):
    """Documents by stems: a word in any form, or a phrase around stop words."""
    return english.search(c.table("documents").select("doc_id", "text"), "text", "licenses, contacted, notice of copyright").select("doc_id")
