"""Texts of deals: how titles and details are written, dates in prose, addresses, and filters for what is no deal."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import DAYS, NAME, _let, days, hours, minutes
from .text import plain_letters

#: Units that stay in lower case after a number. Fixed values.
UNITS = ("kg", "ml", "mg", "lbs", "lb", "oz", "cl", "gm", "g", "l", "am", "pm", "pp")
#: What is cut from both ends of a line. Fixed values.
EDGES = r"[\s\\*._|’,:&-]+"
#: A line that is a price and nothing else. Fixed values.
PRICE_LINES = (r"(?i)^\$\s*[0-9]+(?:\.[0-9]{1,2})?[a-z]*$", r"(?i)^half[\s-]?price$")
#: Prices within a text. Fixed values.
PRICES = (r"\$\s*[0-9]+(?:\.[0-9]{2})?", r"(?i)\bhalf[\s-]?price\b")
#: Letters of another alphabet that are read in place of these. Fixed values.
LOOKALIKES = ("АВЕКМНОРСТХаеорстухн", "ABEKMHOPCTXaeopctyxh")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Names of weekdays and months, short or long, and a day's number as it may be read from an image. Fixed values.
WEEKDAY = "(?:mon(?:day)?|tues?(?:day)?|wed(?:nesday)?|thu(?:rs?)?(?:day)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY_NUMBER = "[0-9il1IL|]{1,2}(?:st|nd|rd|th)?"
DATED = (
    rf"(?i)\b{MONTH}\.?\s+{DAY_NUMBER}\b",
    rf"(?i)\b{DAY_NUMBER}(?:\s+of)?\s+{MONTH}\b",
    r"\b[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b",
    r"\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\b",
)
#: The nth weekday of a month. Fixed values.
NTH = rf"(?is)(?:\b(?:first|second|third|fourth|last|[0-9]+(?:st|nd|rd|th))|\(\s*first\s*/\s*second\s*/\s*third\s*/\s*fourth\s*/\s*last\s*\))\s+{WEEKDAY}\b.*?of\s+(?:(?:each|every|the)|\(\s*each\s*/\s*every\s*/\s*the\s*\))\s+month\b"
#: A time of day, and one after "from". Fixed values.
TIMES = (r"(?i)(?<![0-9])[0-9]{1,2}(?:[:.][0-9]{2})?\s*(?:am|pm)(?![0-9])", r"(?i)\bfrom\s+[0-9]{1,2}[:.][0-9]{2}\b")
TIME = r"(?:\d{1,2}(?:[:.]\d{2})?\s*(?:am|pm)?|\d{3,4}\s*(?:am|pm))"
STATES = "NSW|VIC|QLD|SA|WA|TAS|NT|ACT"


def units_lower(text: Column) -> Column:
    """Units after numbers in lower case, one pass for each unit."""
    for unit in UNITS:
        text = F.regexp_replace(text, rf"(?i)([0-9]\s*){unit}\b", f"$1{unit}")
    return text


def capitalised(text: Column) -> Column:
    """The first letter of each word in upper case, the others in lower case; an apostrophe between letters is in a word."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+(?:['’]\p{L}+)*|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def is_price_line(line: Column) -> Column:
    return F.trim(line).rlike(PRICE_LINES[0]) | F.trim(line).rlike(PRICE_LINES[1])


def format_title(title: Column) -> Column:
    return F.when((title == "") | is_price_line(title), title).otherwise(units_lower(capitalised(title)))


def sentence_case(text: Column) -> Column:
    """Each line in lower case with its first letter in upper case; units after numbers stay in lower case."""

    def line(low: Column) -> Column:
        before = F.regexp_extract(low, r"^\P{L}*", 0)
        n = F.length(before)
        return F.concat(before, F.upper(F.substr(low, n + 1, F.lit(1))), F.substr(low, n + 2))

    return units_lower(F.array_join(F.transform(F.split(text, "[\n\r  \u0085\u000b\u000c]"), lambda s: _let(F.lower(s), line)), "\n"))


def comparison_key(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"^\s+|\s+$", ""), r"\s+", " ")


def clean_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, f"^{EDGES}", ""), f"{EDGES}$", "")


def condition(line: Column) -> Column:
    """A condition without the star that marks it; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^\*\s*", ""), r"^\\\*\s*", "")), F.lit(""))


def trim_title(title: Column) -> Column:
    """A title without days and times at its ends, nor what joined them to it, over and over until nothing more goes."""
    rounds = F.sequence(F.lit(1), F.size(F.split(title, r"\s+")) + 1)
    return F.aggregate(rounds, title, lambda t, _: _let(t, _trim_once))


def _trim_once(title: Column) -> Column:
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    joined = lambda w, a, b: F.array_join(F.slice(w, a, b), " ")
    named = lambda w: F.lower(w).isin(NAME.split("|"))

    def head(w: Column) -> Column:
        first = F.get(w, F.lit(0))
        rest = F.size(w) - 1
        colon = (rest > 0) & (F.get(w, F.lit(1)) == ":") & named(first)
        return F.when(F.size(w) == 0, "").when(colon, joined(w, 3, rest)).when(named(F.regexp_replace(first, ":$", "")), joined(w, 2, F.size(w))).otherwise(F.array_join(w, " "))

    def tail(w: Column) -> Column:
        return F.when((F.size(w) > 1) & named(F.element_at(w, -1)), joined(w, 1, F.size(w) - 1)).otherwise(F.array_join(w, " "))

    def without(t: Column, pattern: str, groups: int) -> Column:
        """The text before the pattern if all its times can be read."""
        times = [minutes(F.regexp_extract(t, pattern, k)) for k in range(1, groups + 1)]
        read = t.rlike(pattern)
        for m in times:
            read = read & m.isNotNull()
        return F.when(read, F.trim(F.regexp_replace(t, pattern, ""))).otherwise(t)

    def orphans(w: Column) -> Column:
        last = lambda a: F.lower(F.element_at(a, -1))
        cut = lambda a, word: F.when((F.size(a) > 1) & (last(a) == word), F.slice(a, 1, F.size(a) - 1)).otherwise(a)
        begun = lambda a: F.when((F.size(a) > 1) & (F.lower(F.get(a, F.lit(0))) == "and"), F.slice(a, 2, F.size(a))).otherwise(a)
        return _let(cut(w, "from"), lambda a: _let(cut(a, "every"), lambda b: _let(begun(b), lambda c: F.array_join(cut(c, "and"), " "))))

    steps = [
        lambda t: _let(words(clean_line(F.trim(t))), head),
        lambda t: _let(words(t), tail),
        lambda t: without(t, rf"(?i)\s+available\s+from\s+({TIME})\s*$", 1),
        lambda t: without(t, rf"(?i)\s+({TIME})\s*(?:-|–|—|to|til|till|'til|until)\s*({TIME})\s*$", 2),
        lambda t: without(t, rf"(?i)\s+({TIME})\s*(?:-|–|—)\s*$", 1),
        lambda t: without(t, rf"(?i)\s+({TIME})\s*$", 1),
        lambda t: _let(words(t), orphans),
        lambda t: F.trim(F.regexp_replace(t, r"\s*(?:-|–|—|&)\s*$", "")),
    ]
    for step in steps:
        title = _let(title, step)
    return title


def _date(year: Column, month: Column, day: Column) -> Column:
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(month))
    return F.when(number > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), number.cast("int"), day.cast("int")), "yyyy-MM-dd"))


def written_date(text: Column, year: Column) -> Column:
    """A date such as '12th September', 'July 26, 2026', with or without a weekday; ``year`` where it has none."""
    t = F.regexp_replace(F.trim(text), rf"(?i)^(?:{'|'.join(DAYS)}),?\s+", "")
    forms = ((r"(?i)^(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]+)(?:\s+(\d{4}))?$", 1, 2), (r"(?i)^([a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?$", 2, 1))
    part = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
    return F.coalesce(*[_date(F.coalesce(part(p, 3).try_cast("int"), year), part(p, m), part(p, d).try_cast("int")) for p, d, m in forms])


def promotion_dates(line: Column, year: int) -> Column:
    """(start, end) of 'until …', 'from …', a range, a single date or 'from … through to the end of month'; nulls if unread.

    ``year`` is that of dates without one and without one on the range's other side.
    """
    return _let(F.regexp_replace(line, r"^[\s.]+|[\s.]+$", ""), lambda t: _promotion(t, F.lit(year)))


def _promotion(t: Column, year: Column) -> Column:
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    none = F.lit(None).cast("date")
    through = r"(?i)^from\s+(.+?)\s+through\s+to\s+the\s+end\s+of\s+([a-z]+)(?:\s+(\d{4}))?$"
    said = F.regexp_extract(t, through, 3).try_cast("int")
    begun = written_date(F.regexp_extract(t, through, 1), F.coalesce(said, year))
    ended = F.last_day(_date(F.coalesce(said, F.year(begun), year), F.regexp_extract(t, through, 2), F.lit(1)))
    in_year = lambda s: F.regexp_extract(s, r"\b(?:19|20)\d{2}\b", 0).try_cast("int")

    def ranged(p: Column) -> Column:
        a, b = F.trim(F.get(p, F.lit(0))), F.trim(F.get(p, F.lit(1)))
        return F.when((F.size(p) == 2) & (a != "") & (b != ""), pair(written_date(a, F.coalesce(in_year(a), in_year(b), year)), written_date(b, F.coalesce(in_year(b), in_year(a), year))))

    single = written_date(t, year)
    ranges = F.coalesce(*[_let(F.split(t, s), ranged) for s in (" – ", " — ", " - ", " to ")])
    return (
        F.when(begun.isNotNull() | ended.isNotNull(), pair(begun, ended))
        .when(t.ilike("until %"), pair(none, written_date(F.substr(t, F.lit(7)), year)))
        .when(t.ilike("from %"), pair(written_date(F.substr(t, F.lit(6)), year), none))
        .otherwise(F.coalesce(ranges, pair(single, single)))
    )


def fold_lookalikes(text: Column) -> Column:
    return F.translate(text, *LOOKALIKES)


def has_date(text: Column) -> Column:
    """Whether a text names a calendar date, digits read as letters included."""
    t = fold_lookalikes(text)
    found = [t.rlike(p) for p in DATED]
    return F.coalesce(found[0] | found[1] | found[2] | found[3], F.lit(False))


def other_months(text: Column, month: int) -> Column:
    """Whether a text says 'in' any month other than this one and the next."""
    named = F.regexp_extract_all(fold_lookalikes(text), F.lit(rf"(?i)\bin\s+({MONTH})\b"), F.lit(1))
    number = lambda m: F.array_position(F.array(*[F.lit(x[:3]) for x in MONTHS]), F.lower(F.substring(m, 1, 3)))
    return F.coalesce(F.exists(named, lambda m: ~number(m).isin(month, month % 12 + 1)), F.lit(False))


def nth_weekday(text: Column) -> Column:
    return F.coalesce(text.rlike(NTH), F.lit(False))


def has_price(text: Column) -> Column:
    return text.rlike(PRICES[0]) | text.rlike(PRICES[1])


def has_keyword(text: Column, keywords: Sequence[str], squeezed: bool = False) -> Column:
    """Whether a text holds one of the keywords in any case; ``squeezed``: dashes, apostrophes and spaces aside in both."""
    squeeze = lambda s: s.lower().replace("-", "").replace("'", "").replace(" ", "")
    t = F.translate(F.lower(text), "-' ", "") if squeezed else F.lower(text)
    wanted = [squeeze(k) if squeezed else k.lower() for k in keywords]
    return F.coalesce(F.exists(F.array(*[F.lit(k) for k in wanted]).cast("array<string>"), lambda k: t.contains(k)), F.lit(False))


def is_deal(text: Column, deal_words: Sequence[str], expired: Sequence[str] = (), excluded: Sequence[str] = ()) -> Column:
    """Whether a text may be a deal: it names a day or time, and a keyword or price; no date, nothing expired or excluded."""
    timed = text.rlike(TIMES[0]) | text.rlike(TIMES[1]) | hours(text).isNotNull()
    said = (F.size(days(text)) > 0) | timed
    bad = has_keyword(text, expired) | has_keyword(text, excluded, squeezed=True) | has_date(text)
    return F.coalesce((F.trim(text) != "") & ~bad & said & (has_keyword(text, deal_words) | has_price(text)), F.lit(False))


def address_parts(address: Column) -> Column:
    """(suburb, state, postcode) at the end of an Australian address; null if it has none."""
    t = F.trim(address)
    forms = [rf"{front}([^,]+?)\s+((?i){STATES})\s+(\d{{4}})\s*(?:,\s*Australia)?\s*$" for front in (r",\s*", "^")]
    read = lambda p: F.when(t.rlike(p), F.struct(F.trim(F.regexp_extract(t, p, 1)).alias("suburb"), F.upper(F.regexp_extract(t, p, 2)).alias("state"), F.regexp_extract(t, p, 3).alias("postcode")))
    return F.coalesce(*map(read, forms))


#: Regions in which an address of New Zealand may lie, two of them in two spellings. Fixed values.
REGIONS_NZ = (
    "Manawatu-Wanganui", "Manawatū-Whanganui", "Bay of Plenty", "Hawke's Bay", "Hawkes Bay", "West Coast", "Marlborough", "Canterbury", "Southland",
    "Northland", "Wellington", "Taranaki", "Gisborne", "Waikato", "Auckland", "Tasman", "Nelson", "Otago",
)


def address_parts_nz(address: Column) -> Column:
    """(suburb, state, postcode) at the end of an address of New Zealand; state is a region or ''. Null if it has none.

    Forms with a street come before those without, and a town or region behind a comma before one behind a space. An
    address with an Australian state and postcode is none. A region is meant in any case and without its marks.
    """
    t, end, region = F.trim(address), r"\s+(\d{4})\s*(?:,\s*New Zealand)?\s*$", "|".join(REGIONS_NZ)
    australian = rf"(?i)\b(?:{STATES})\s+\d{{4}}\b"

    bare = {re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", r)).lower(): r for r in REGIONS_NZ}
    regions = F.create_map(*[F.lit(x) for pair in bare.items() for x in pair])

    def read(form: str, town: int | None, code: int) -> Column:
        place = F.lit("") if town is None else F.regexp_extract(t, form, town)
        return F.when(t.rlike(form), F.struct(F.trim(F.regexp_extract(t, form, 1)).alias("suburb"), place.alias("place"), F.regexp_extract(t, form, code).alias("postcode")))

    forms = []
    for front, whole in ((r",\s*", r",\s*([^,]+),\s*([^,]+?)"), ("^", r"^([^,]+),\s*([^,]+?)")):
        forms += [read(whole + end, 2, 3), read(rf"{front}([^,]+?)\s+((?i){region}){end}", 2, 3), read(rf"{front}([^,]+?){end}", None, 2)]
    state = lambda x: F.coalesce(F.try_element_at(regions, F.lower(plain_letters(F.trim(x["place"])))), F.lit(""))
    return _let(F.when(~t.rlike(australian), F.coalesce(*forms)), lambda x: F.when(x["suburb"] != "", F.struct(x["suburb"].alias("suburb"), state(x).alias("state"), x["postcode"].alias("postcode"))))


def thumbnail(url: Column, folder: str) -> Column:
    """The address of a numbered picture's small form; other addresses stay, blank ones are null."""
    return F.when(F.trim(url) != "", F.regexp_replace(url, rf"(?i)^([^?#]*/{folder}/\d+)\.jpe?g(?=$|[?#])", "$1-thumb.jpg"))


def current_document(url: Column, year: int) -> Column:
    """Whether a document's path names no year of this century, or this one or a later one."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.regexp_extract(path, r"\b(20\d{2})\b", 1).try_cast("int") >= year, F.lit(True))


def import_status(website: Column) -> Column:
    return F.when(F.trim(F.coalesce(website, F.lit(""))) == "", "broken").otherwise("normal")
