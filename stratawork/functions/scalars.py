"""Scalar expressions whose usual Spark spelling differs from the intended
meaning: 0-based slices, floor division, half-even rounding, guarded ratios."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col


def slice_text(c: str | Column, start: int, stop: int) -> Column:
    """Characters ``start`` up to, not including, ``stop``, counted from 0."""
    return F.substring(col(c), start + 1, stop - start)


def strip_lower(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def matches(c: str | Column, pattern: str) -> Column:
    """Regular-expression search anywhere in the text (Java syntax)."""
    return col(c).rlike(pattern)


def floor_div(a: str | Column, b: Any) -> Column:
    return F.floor(F.try_divide(col(a), b if isinstance(b, Column) else F.lit(b)))


def modulo(a: str | Column, b: Any) -> Column:
    """Remainder with the sign of the divisor; null for divisor 0."""
    d = b if isinstance(b, Column) else F.lit(b)
    r = F.try_mod(col(a), d)
    return F.when((r != 0) & ((r < 0) != (d < 0)), r + d).otherwise(r)


def half_even(c: str | Column, places: int = 0) -> Column:
    return F.bround(col(c), places)


def ratio(a: str | Column, b: str | Column, places: int | None = None) -> Column:
    """a / b, null when b is 0 or missing."""
    r = F.try_divide(col(a), col(b))
    return r if places is None else F.round(r, places)


def clip(c: str | Column, low: Any, high: Any) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def number_or_null(c: str | Column, kind: str = "double") -> Column:
    """Cast that gives null instead of an error."""
    return col(c).try_cast(kind)


def lookup(c: str | Column, mapping: Mapping[Any, Any], key_type: str | None = None) -> Column:
    """Static value to label; null when unmatched. For short mappings."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k).cast(key_type) if key_type else F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col(c))


def day_span(low: str | Column, high: str | Column) -> Column:
    """Days from ``low`` to ``high``, both counted."""
    return F.datediff(col(high), col(low)) + 1

