"""What a model answers when it is asked for deals, as rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import _let


def strip_fence(content: Column) -> Column:
    """A text without the code fence around it; the fence's first line goes whole."""
    t = F.regexp_replace(content, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n|^```", ""), r"```$", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def strings_of(value: Column, path: str) -> Column:
    """The strings of a list, a single string as a list of one, and none for anything else or nothing."""
    at = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(at)
    each = F.transform(F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>")), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.when(kind == "STRING", F.array(F.try_variant_get(value, path, "string"))).when(kind.startswith("ARRAY"), F.array_compact(each)).otherwise(F.array().cast("array<string>"))


def deals_of(content: Column) -> Column:
    """An array of (title, details, conditions, days, times, promotion_dates) of a list of deals or of {"deals": [...]}.

    Null if the text is neither; entries that are no objects or whose title is no string go. promotion_dates is null
    where it is missing or null.
    """

    def deal(v: Column) -> Column:
        dates = F.schema_of_variant(F.try_variant_get(v, "$.promotionDates", "variant"))
        return F.when(
            F.schema_of_variant(F.try_variant_get(v, "$.title", "variant")) == "STRING",
            F.struct(
                F.try_variant_get(v, "$.title", "string").alias("title"), *[strings_of(v, f"$.{c}").alias(c) for c in ("details", "conditions", "days", "times")],
                F.when(dates.isNotNull() & (dates != "VOID"), strings_of(v, "$.promotionDates")).alias("promotion_dates"),
            ),
        )

    parsed = F.try_parse_json(strip_fence(content))
    listed = _let(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.deals", "array<variant>")))
    return F.array_compact(F.transform(listed, deal))
