"""Slugs, trigrams, addresses of pages and people, hashes."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks of letters. Fixed value.
MARKS = "[\u0300-\u036f]"


@functools.cache
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """By the compatibility decomposition: letters that become one plain letter or digit, those letters, and what becomes more.

    Others don't matter here, as what has no plain letter or digit in it is a gap in a slug either way.
    """
    plain: dict[str, str] = {}
    for k in range(0x80, sys.maxunicode + 1):
        d = re.sub(MARKS, "", unicodedata.normalize("NFKD", chr(k)))
        if d != chr(k) and re.search("[0-9A-Za-z]", d):
            plain[chr(k)] = d
    one = {c: d for c, d in plain.items() if len(d) == 1}
    return "".join(one), "".join(one.values()), {c: d for c, d in plain.items() if len(d) > 1}


TRACKING = "(?i)utm_(source|medium|campaign|term|content)"


def plain_letters(name: Column) -> Column:
    """Letters of any script's forms as their plain ones, without marks: macrons, carons, ligatures, full-width forms."""
    single, into, several = _decomposed()
    # the few that become several letters are looked up letter by letter, only where a text holds one
    some = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(some[c], c)), "")
    whole = F.when(name.rlike(f"[{''.join(several)}]"), spelt).otherwise(name)
    # a text of ASCII letters, as most are, has none of these
    return F.when(name.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(whole, single, into), MARKS, "")).otherwise(name)


def slugify(name: Column) -> Column:
    """Plain letters in lower case, one dash for each run of anything else, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(plain_letters(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def compact_slug(name: Column) -> Column:
    """Plain letters in lower case and digits, nothing else."""
    return F.regexp_replace(F.lower(plain_letters(name)), "[^a-z0-9]+", "")


def suburb_slug(name: Column, postcode: Column) -> Column:
    return F.when(F.trim(F.coalesce(postcode, F.lit(""))) == "", slugify(name)).otherwise(F.concat_ws("-", slugify(name), F.trim(postcode)))


def parse_suburb_slug(slug: Column) -> Column:
    """(name_slug, postcode) of a suburb's slug; the postcode is four digits behind the last dash, else null."""
    t, form = F.lower(F.trim(slug)), r"^(.+)-(\d{4})$"
    return F.struct(F.when(t.rlike(form), F.regexp_extract(t, form, 1)).otherwise(t).alias("name_slug"), F.when(t.rlike(form), F.regexp_extract(t, form, 2)).alias("postcode"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each alphanumeric word, padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, 0 if there are none."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, shared / every).otherwise(F.lit(0.0))


def similarity_of_distance(distance: Column, longest: Column) -> Column:
    """1 less the distance over the length of the longer text; empty texts are equal."""
    return F.when(longest > 0, 1 - distance / longest).when(distance.isNotNull(), F.lit(1.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return similarity_of_distance(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


#: Domains of tools, whose addresses are nobody's contact. Fixed values.
TOOL_DOMAINS = ("wixpress.com", "sentry.io")


def emails(text: Column) -> Column:
    """Distinct addresses in order, lower case; not the names of scaled images (a@2x.png) nor addresses of tools."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9._%+-]+@(?![0-9]+[xX]\\.)[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"), F.lit(0)), lambda e: F.lower(e))
    domain = lambda e: F.substring_index(e, "@", -1)
    tool = lambda e: domain(e).isin(*TOOL_DOMAINS) | domain(e).rlike("\\.(" + "|".join(d.replace(".", "\\.") for d in TOOL_DOMAINS) + ")$")
    return F.array_distinct(F.filter(found, lambda e: ~tool(e)))


def normalise_url(url: Column) -> Column:
    """http and https alone; host in lower case, no fragment, no slash at the end of a path that is more than one."""
    base = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(base, "^(?i)(https?://[^/?]*)", 1))
    path = F.regexp_extract(base, "^(?i)https?://[^/?]*([^?]*)", 1)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(host != "", F.concat(host, path, F.regexp_extract(base, "(\\?.*)$", 1)))


def strip_tracking(url: Column) -> Column:
    """The address without its tracking parameters, and without a question mark that nothing follows."""
    query = F.regexp_extract(url, "(\\?.*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(query, f"([?&]){TRACKING}=[^&]*(?=&|$)", "$1"), "&{2,}", "&")
    kept = F.regexp_replace(F.regexp_replace(kept, "\\?&+", "?"), "[?&]+$", "")
    return F.concat(F.substring_index(url, "?", 1), kept)


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def source_type(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    return F.when(path.endswith(".pdf"), "pdf").when(path.rlike("\\.(png|jpe?g|gif|webp|avif)$") | F.lower(url).contains("image"), "image").otherwise("webpage")
