"""Text normalization for listing names, notes and briefs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemill.functions.money import half_up, percent_text

# Fixed value: a model number is one letter and two digits, standing alone.
MODEL_NUMBER = r"\b[a-z]\d{2}\b"


def normalized(text: Column) -> Column:
    """Lower case, everything but letters and digits (and _) to a space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", " "))


def words(text: Column) -> Column:
    """Distinct words of the normalized text, sorted; empty array for an empty text."""
    split = F.split(normalized(text), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(split, lambda w: w != "")))


def first_word(text: Column) -> Column:
    """First word as written, lower case; null for a blank text."""
    return F.lower(F.get(F.split(F.trim(text), r"\s+"), F.lit(0)))


def model_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(MODEL_NUMBER), F.lit(0)))


def trend_class(trend: Column, limit: float = 0.01) -> Column:
    known = F.coalesce(trend, F.lit(0.0))
    return (
        F.when(known > limit, "rising").when(known < -limit, "falling").otherwise("flat")
    )


def signed_tenths_text(tenths: Column) -> Column:
    """-12 tenths of a percent -> '-1.2%', with a sign for positive values too."""
    sign = F.when(tenths < 0, "-").otherwise("+")
    return F.concat(sign, percent_text(F.abs(tenths)))


def market_note(gap_num: Column, gap_den: Column, trend: Column) -> Column:
    """'Overpriced vs market by 3.4%, trend +1.2%' from an exact gap fraction and a trend."""
    # fixed values: the words of the note
    side = F.when(gap_num > 0, "Overpriced").otherwise("Underpriced")
    gap = percent_text(half_up(F.abs(gap_num) * 1000, gap_den))
    trend_tenths = F.round(trend * F.lit(1000.0)).cast("long")
    return F.concat(
        side, F.lit(" vs market by "), gap, F.lit(", trend "), signed_tenths_text(trend_tenths)
    )


def collection_summary(value: Column, kind: str = "items", limit: int = 20) -> Column:
    """JSON of an array or map, or only its size when it holds more than `limit` entries."""
    return F.when(F.size(value) > limit, F.format_string(f"<%d {kind}>", F.size(value))).otherwise(
        F.to_json(value)
    )
