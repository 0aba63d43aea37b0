"""Small column helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rd(col, digits: int = 6) -> Column:
    """Round for reporting."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def clip(col: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col, F.lit(float(lo))), F.lit(float(hi)))


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` where the denominator is positive, else ``default``."""
    return F.when(den > 0, num / den).otherwise(F.lit(float(default)))


def null_nan(col: Column) -> Column:
    """NaN and infinities become NULL; inside the engine only NULL marks a missing value."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


def sorted_median(arr: Column) -> Column:
    """Median of a non-empty numeric array, mean of the middle two for an even size."""
    s = F.array_sort(arr)
    n = F.size(s)
    lower = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    upper = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def rank_value(col: Column, table: dict[str, int]) -> Column:
    """Map a label to its rank."""
    pairs = [x for kv in table.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.element_at(F.create_map(*pairs), col)
