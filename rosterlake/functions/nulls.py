"""Comparisons whose null rules differ from Spark's defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_greatest(*cs: Column) -> Column:
    """Null if any argument is null."""
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in cs)), F.greatest(*cs))


def strict_least(*cs: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in cs)), F.least(*cs))


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)
