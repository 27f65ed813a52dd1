"""Numeric helpers: safe reads, NaN ordering, confidence bands."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.constants import CONFIDENCE_BANDS
from trapline.functions.text import col_


def safe_double(c) -> Column:
    """Text -> double, non-numeric -> 0."""
    return F.coalesce(col_(c).try_cast("double"), F.lit(0.0))


def nan_low(c) -> Column:
    """Order NaN below every number (Spark ranks NaN highest)."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(c)


def band_index(c) -> Column:
    """0-based confidence band, highest first; NaN falls in the lowest band."""
    c = col_(c)
    expr = F.when(F.isnan(c), F.lit(len(CONFIDENCE_BANDS) - 1))
    for i, (_, low) in enumerate(CONFIDENCE_BANDS):
        expr = expr.when(c >= low, F.lit(i)) if low is not None else expr.otherwise(F.lit(i))
    return expr


def band_label(c) -> Column:
    idx = band_index(c)
    expr = None
    for i, (label, _) in enumerate(CONFIDENCE_BANDS):
        expr = F.when(idx == i, label) if expr is None else expr.when(idx == i, label)
    return expr


def percent(n, total) -> Column:
    """P25: 100*n/total, 0 when total is 0."""
    return F.coalesce(F.try_divide(col_(n) * F.lit(100.0), col_(total)), F.lit(0.0))
