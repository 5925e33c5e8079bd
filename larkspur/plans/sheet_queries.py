"""Queries over text as it lies on sheets: lines' numbers as places, an order's lines as its sheet's runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets
from .queries import query

_WIDTH = 600.0


def _runs(c):
    k, p, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("int")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    x0 = F.when(F.col("l_suppkey") % 2 == 0, 40.0).otherwise(330.0) + (p % 5) * F.lit(11.0)
    y0 = F.lit(800.0) - (k % 8) * F.lit(90.0) - F.col("l_linenumber") * F.lit(12.0) + (p % 4) * F.lit(3.0)
    size = pick(q, 10.0, 10.0, 10.0, 12.4, 16.0, 20.0, 9.6)
    text = F.concat(pick(p, "Steak ", "HAPPY", "• jug ", "2) wing", "- rib", "", "of the day ", "1. beer"), F.when(p % 8 != 5, q.cast("string")).otherwise(""))
    return c.table("lineitem").select(
        (k / 64).cast("int").alias("sheet"), (((k * 10 + F.col("l_linenumber")) * 1000000 + p) * 100 + q).alias("run"), text.alias("text"), x0.alias("x0"), (x0 + 4 + q).alias("x1"), y0.alias("y0"), (y0 + size).alias("y1"), size.alias("size"),
    )


_RUNS = f"""
run_ AS (SELECT (l_orderkey // 64)::INT AS sheet, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + l_quantity::INT AS run, ['Steak ', 'HAPPY', '• jug ', '2) wing', '- rib', '', 'of the day ', '1. beer'][l_partkey % 8 + 1] || CASE WHEN l_partkey % 8 <> 5 THEN l_quantity::INT::VARCHAR ELSE '' END AS text,
  x0, x0 + 4 + l_quantity::INT AS x1, y0, y0 + size AS y1, size FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 40.0::DOUBLE ELSE 330 END + (l_partkey % 5) * 11 AS x0, 800.0::DOUBLE - (l_orderkey % 8) * 90 - l_linenumber * 12 + (l_partkey % 4) * 3 AS y0, [10.0::DOUBLE, 10, 10, 12.4, 16, 20, 9.6][l_quantity::INT % 7 + 1] AS size FROM lineitem)),
gap_ AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY sheet ORDER BY x0, run) > {_WIDTH * 0.12} THEN 1 ELSE 0 END AS far FROM run_),
clus_ AS (SELECT sheet, c, median(x0) AS pos FROM (SELECT *, sum(far) OVER (PARTITION BY sheet ORDER BY x0, run) AS c FROM gap_) GROUP BY ALL),
anch_ AS (SELECT sheet, list(pos ORDER BY pos) AS pos FROM clus_ GROUP BY sheet),
col_ AS (SELECT r.*, CASE WHEN len(pos) = 2 OR (len(pos) = 3 AND pos[2] > {_WIDTH * 0.4} AND pos[2] < {_WIDTH * 0.6}) THEN (x0 >= pos[-1] - {_WIDTH * 0.12})::INT ELSE (list_position(list_transform(pos, lambda a: abs(a - x0)), list_min(list_transform(pos, lambda a: abs(a - x0)))) - 1)::INT END AS col FROM run_ r JOIN anch_ USING (sheet)),
ord_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sheet, col ORDER BY (y0 + y1) / 2 DESC, x0, run) AS k FROM col_),
band_ AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE b AS (SELECT sheet, col, k, run, 0 AS band, (y0 + y1) / 2 AS top FROM ord_ WHERE k = 1 UNION ALL SELECT o.sheet, o.col, o.k, o.run, CASE WHEN b.top - (o.y0 + o.y1) / 2 > 4 THEN band + 1 ELSE band END, CASE WHEN b.top - (o.y0 + o.y1) / 2 > 4 THEN (o.y0 + o.y1) / 2 ELSE b.top END FROM b JOIN ord_ o ON o.sheet = b.sheet AND o.col = b.col AND o.k = b.k + 1) SELECT sheet, run, band FROM b)),
cut_ AS (SELECT o.*, band, CASE WHEN lag(run) OVER w IS NULL OR greatest(size, lag(size) OVER w) / least(size, lag(size) OVER w) >= 1.25 OR x0 - lag(x1) OVER w > 40 THEN 1 ELSE 0 END AS new FROM ord_ o JOIN band_ USING (sheet, run) WINDOW w AS (PARTITION BY o.sheet, col, band ORDER BY x0, run)),
num_ AS (SELECT *, (sum(new) OVER (PARTITION BY sheet, col ORDER BY band, x0, run) - 1)::INT AS line, trim(text) AS t FROM cut_),
sp_ AS (SELECT *, CASE WHEN x0 - max(CASE WHEN t <> '' THEN x0 * 0 + x1 END) OVER (PARTITION BY sheet, col, line ORDER BY x0, run ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) > 2 THEN ' ' ELSE '' END || t AS u FROM (SELECT * FROM num_ WHERE t <> '')),
line_ AS MATERIALIZED (SELECT sheet, col, line, trim(coalesce(string_agg(u, '' ORDER BY x0, run), '')) AS text FROM sp_ GROUP BY ALL),
geo_ AS MATERIALIZED (SELECT sheet, col, line, avg(size) AS size, min(y0) AS y0, max(y1) AS y1 FROM num_ GROUP BY ALL),
full_ AS MATERIALIZED (SELECT sheet, col, line, coalesce(text, '') AS text, size, y0, y1 FROM geo_ LEFT JOIN line_ USING (sheet, col, line))"""


@query('SELECT sheet, col AS "column", line, text, round(size, 6) AS size, y0, y1 FROM full_', _RUNS)
def sheet_lines(c):
    found = sheets.lines(sheets.columns(_runs(c), _WIDTH))
    return found.select("sheet", "column", "line", "text", F.round("size", 6).alias("size"), "y0", "y1")


_BLOCKS = """
kept_ AS (SELECT * FROM full_ WHERE text <> ''),
body_ AS (SELECT sheet, arg_max(half, (n, -half)) AS body FROM (SELECT sheet, round(size * 2) / 2 AS half, count(*) AS n FROM kept_ GROUP BY ALL) GROUP BY sheet),
high_ AS (SELECT sheet, median(greatest(y1 - y0, 1)) AS height FROM kept_ GROUP BY sheet),
kind_ AS (SELECT *, CASE WHEN length(text) <= 80 AND (size >= body * 1.25 OR (regexp_replace(text, '[^A-Za-z]', '', 'g') <> '' AND NOT regexp_matches(text, '[a-z]'))) THEN 'heading' WHEN regexp_matches(text, '^([-*] |[•·]|[0-9]+[.)]\\s)') THEN 'list' ELSE 'paragraph' END AS kind FROM kept_ JOIN body_ USING (sheet) JOIN high_ USING (sheet)),
new_ AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR kind = 'heading' OR lag(kind) OVER w <> kind OR (kind = 'paragraph' AND lag(y0) OVER w - y1 > height * 1.2) THEN 1 ELSE 0 END AS new FROM kind_ WINDOW w AS (PARTITION BY sheet ORDER BY col, line)),
block_ AS (SELECT *, (sum(new) OVER (PARTITION BY sheet ORDER BY col, line) - 1)::INT AS block FROM new_),
level_ AS (SELECT sheet, list(half ORDER BY half DESC) AS levels FROM (SELECT DISTINCT sheet, round(size * 2) / 2 AS half FROM block_ WHERE kind = 'heading') GROUP BY sheet),
md_ AS (SELECT *, CASE kind WHEN 'heading' THEN repeat('#', CASE WHEN len(levels) = 1 THEN 2 ELSE coalesce(least(3, list_min(list_filter(range(1, len(levels) + 1), lambda i: abs(levels[i] - size) < 0.6))), 2) END::INT) || ' ' || text WHEN 'list' THEN CASE WHEN regexp_matches(text, '^[-*] ') THEN text WHEN regexp_matches(text, '^[0-9]+[.)]') THEN regexp_replace(text, '^([0-9]+[.)])\\s*(.+)', '\\1 \\2') ELSE '- ' || regexp_replace(text, '^[•·*_-]\\s*', '') END ELSE text END AS w FROM block_ LEFT JOIN level_ USING (sheet))"""


@query("SELECT sheet, block, any_value(kind) AS kind, string_agg(w, chr(10) ORDER BY col, line) AS markdown FROM md_ GROUP BY ALL", f"{_RUNS}, {_BLOCKS}")
def sheet_blocks(c):
    return sheets.headed_blocks(sheets.lines(sheets.columns(_runs(c), _WIDTH)))
