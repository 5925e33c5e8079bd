"""Hours in phrases as people write them on menus and posters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import _let, between, distinct_hours, hours, minutes

#: A time within a phrase. Fixed value.
TIME = r"\d{1,2}(?:[:.]\d{2})?\s*(?:am|pm)?"
TOKEN = rf"(?i)(?<!\d)({TIME})(?!\d)"
_TILL = r"(?:'?(?:till|til)'?|until)"
_TO = r"\s*(?:-|–|—|to)\s*"
#: What a phrase may be, in the order in which it is tried; times are its groups, None is midnight. Fixed values.
BEFORE_COUNTED = [(rf"(?i)(?:from|sales?)\s+({TIME}).*draw(?:n|s)?(?:\s+(?:from|at))?\s+({TIME})", 1, 2)]
COUNTED = r"(?i)^\d+\s*(?:hrs?|hours?)\s+from\s+(.+)$"
BEFORE_PLAIN = [
    (rf"(?i)from\s+({TIME})\s+{_TILL}\s+({TIME})", 1, 2),
    (rf"(?i)({TIME})\s+{_TILL}\s+({TIME})", 1, 2),
    (rf"(?i){_TILL}\s+({TIME})", None, 1),
    (rf"(?i)arrive\s+at\s+({TIME})(?:\s+for\s+{TIME}\s+start)?", 1, None),
    (rf"(?i)between\s+({TIME}){_TO}({TIME})", 1, 2),
]
EMBEDDED = [(rf"(?i)(?<!\d)({TIME}){_TO}({TIME})(?!\d)", 1, 2)]
#: Phrases that go over two strings of a list. Fixed values.
ENDS = (rf"(?i)^(?:.*\s)?draw(?:n|s)?\s+from\s+({TIME})$", rf"(?i)^(?:.*\s)?drawn(?:\s+at)?\s+({TIME})$")
STARTS = rf"(?i)^(?:.*\s)?from\s+({TIME})$"
ALONE, CONTINUED = rf"(?i)^({TIME})$", rf"(?i)^[-–—]\s*({TIME})$"
#: What lists put in front of a line, and what is wrapped around one. Fixed values.
MARKERS = "•‣·◦∙"
WRAPPERS = ("()", "[]", "**", "__")


def clean_phrase(text: Column) -> Column:
    """A phrase without labels in front, list markers and wrappers, with plain apostrophes, "am", "pm" and "to"."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), "’‘", "''"))
    for pattern, by in ((r"(?i)a\.m\.?", "am"), (r"(?i)p\.m\.?", "pm"), (r"(?i)t[º°0]", "to"), (r"(?i)^(?:times?\s*[-:]|happy\s*hours?)\s*", ""), (rf"^[\s{MARKERS}]+|[\s{MARKERS}]+$", "")):
        t = F.regexp_replace(t, pattern, by)

    def unwrap(s: Column) -> Column:
        both = F.concat(F.substring(s, 1, 1), F.substring(s, -1, 1))
        return F.when((F.length(s) > 1) & both.isin(*WRAPPERS), F.trim(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)

    layers = lambda s: F.sequence(F.lit(0), F.length(F.regexp_extract(s, r"^[(\[*_\s]*", 0)))
    return _let(t, lambda s: F.aggregate(layers(s), s, lambda x, _: _let(x, unwrap)))


def phrase_hours(text: Column) -> Column:
    """The hours that a cleaned phrase holds: one stretch by the first pattern that reads, else its times, else lunch."""
    return _let(text, _phrase)


def _phrase(t: Column) -> Column:
    forms = [*BEFORE_COUNTED, *BEFORE_PLAIN, *EMBEDDED]
    group = lambda p, k: F.lit("midnight") if k is None else F.regexp_extract(t, p, k)
    # a pattern that does not match has no time, also where its other end is midnight
    pairs = [F.when(t.rlike(p), F.struct(group(p, a).alias("a"), group(p, b).alias("b"))) for p, a, b in forms]
    read = F.transform(F.array(*pairs), lambda x: _let(F.struct(minutes(x["a"]).alias("a"), minutes(x["b"]).alias("b")), lambda m: F.when(m["a"].isNotNull() & m["b"].isNotNull(), between(m["a"], m["b"]))))
    plain = F.transform(F.array(F.nullif(F.regexp_extract(t, COUNTED, 1), F.lit("")), t), hours)
    tokens = F.filter(F.transform(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1)), minutes), lambda m: m.isNotNull())

    def chosen(x: Column) -> Column:
        ranged, whole, times = x["ranged"], x["whole"], x["times"]
        several = F.when(t.rlike(r"(?i)[,&]|(?:\band\b)") & (F.size(times) > 1), between(F.array_min(times), F.array_max(times)))
        n = len(BEFORE_PLAIN)
        one = F.coalesce(ranged[0], whole[0], *[ranged[1 + k] for k in range(n)], whole[1], ranged[1 + n], several)
        begun = F.transform(times, lambda m: F.struct(F.lit("from").alias("kind"), m.alias("start"), F.lit(None).cast("int").alias("end")))
        lunch = t.rlike(r"(?i)\blunch\b") & ~t.rlike(r"(?i)\b(?:dinner|evening|night)\b")
        rest = F.when(F.size(begun) > 0, begun).when(lunch, F.array(between(F.lit(720), F.lit(840)))).otherwise(F.slice(begun, 1, 0))
        return _let(one, lambda o: F.when(o.isNotNull(), F.array(o)).otherwise(rest))

    return _let(F.struct(read.alias("ranged"), plain.alias("whole"), tokens.alias("times")), chosen)


def parse_times(strings: Column) -> Column:
    """Distinct hours (kind, start, end) of a list of phrases, in order; none for null, blank and unreadable ones.

    A draw's start and end, and a time and one that begins with a hyphen, may be two strings of the list.
    """
    clean = F.filter(F.transform(F.coalesce(strings, F.array().cast("array<string>")), clean_phrase), lambda s: s != "")
    return _let(clean, _times)


def _times(listed: Column) -> Column:
    caught = lambda s, p: minutes(F.regexp_extract(s, p, 1))
    last = lambda a: F.get(F.reverse(F.filter(a, lambda m: m.isNotNull())), F.lit(0))
    drawn = F.transform(listed, lambda s: _let(F.coalesce(*[caught(s, p) for p in ENDS]), lambda e: F.struct(e.alias("e"), F.when(e.isNull(), caught(s, STARTS)).alias("s"))))
    drawn = _let(drawn, lambda d: F.struct(last(F.transform(d, lambda x: x["s"])).alias("a"), last(F.transform(d, lambda x: x["e"])).alias("b")))
    sides = F.transform(listed, lambda s: F.struct(caught(s, ALONE).alias("a"), caught(s, CONTINUED).alias("b")))
    joined = _let(sides, lambda x: F.filter(F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.size(x)), lambda p, q: F.struct(p["a"].alias("a"), q["b"].alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull()))
    across = _let(drawn, lambda d: F.when(d["a"].isNotNull() & d["b"].isNotNull(), d).otherwise(F.get(joined, F.lit(0))))
    all_day = F.lit(True) & (F.size(listed) > 0) & F.forall(listed, lambda s: F.lower(s).isin("all day", "all-day", "allday"))
    whole = F.array(F.struct(F.lit("allDay").alias("kind"), F.lit(0).alias("start"), F.lit(1440).alias("end")))
    each = _let(F.flatten(F.transform(listed, phrase_hours)), distinct_hours)
    return F.when(all_day, whole).otherwise(_let(across, lambda x: F.when(x.isNotNull(), F.array(between(x["a"], x["b"]))).otherwise(each)))
