"""Score arithmetic (S4, S5) in double precision.

Spark SQL reads a literal such as ``0.7`` as DECIMAL, which rounds 45 * 0.7
to 32 instead of 31; every constant here is cast to DOUBLE first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def layer1(positive, negative) -> Column:
    """max(0, positive - negative), no upper cap."""
    return F.greatest(F.lit(0).cast("double"), (_c(positive) - _c(negative)).cast("double"))


def blend(l1, l2, w1: float = 0.7, w2: float = 0.3) -> Column:
    """round(l1 * 0.7 + l2 * 0.3), half up, double arithmetic."""
    return F.round(_c(l1).cast("double") * _d(w1) + F.coalesce(_c(l2), F.lit(0)).cast("double") * _d(w2)).cast("bigint")
