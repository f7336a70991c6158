"""Text and number parsing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_number(s: Column) -> Column:
    """An optional sign, digits, and a point with further digits or none, over the whole text."""
    return F.coalesce(s.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), F.lit(False))


def to_number(s: Column) -> Column:
    """As double; else the part before the first point as double; else 0."""
    return F.coalesce(s.try_cast("double"), F.substring_index(s, ".", 1).try_cast("double"), F.lit(0.0))


def composite_key(*parts: Column) -> Column:
    """Parts joined, without a pair of outer quotes."""
    return F.regexp_replace(F.concat(*[p.cast("string") for p in parts]), r"^(['\"])(.*)\1$", "$2")


def contains_any(s: Column, tokens: Sequence[str]) -> Column:
    """Whether any token occurs within the text."""
    found = F.lit(False)
    for t in tokens:
        found = found | F.contains(s, F.lit(t))
    return found


def split(s: Column, delimiter: str) -> Column:
    """[M25] Pieces between literal delimiters; empty ones stay."""
    return F.split(s, re.escape(delimiter), -1)


def join(parts: Column, delimiter: str) -> Column:
    """[M26]"""
    return F.array_join(parts, delimiter)


def zero_padded(n: Column, width: int = 3) -> Column:
    """[M38] Padded on the left to ``width`` signs; longer numbers stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def progress_bar(share: Column, width: int = 30) -> Column:
    """[M27] A bar of ``width`` signs, filled by share."""
    n = F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("="), n), F.repeat(F.lit(" "), F.lit(width) - n))
