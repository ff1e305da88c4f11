"""Slots to rows, codes to columns, typed unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_slots(df: DataFrame, keys: list[str], slots: list[dict[str, str]], first: int = 1, need: str | None = None) -> DataFrame:
    """One row per slot: ``slots`` maps output columns to the slot's columns; rows whose ``need`` is blank or null go.

    A single generator over one scan, not a union of scans.
    """
    names = list(slots[0])
    rows = F.array(*(F.struct(F.lit(i).alias("slot"), *(F.col(s[n]).alias(n) for n in names)) for i, s in enumerate(slots, first)))
    out = df.select(*keys, F.inline(rows))
    return out if need is None else out.filter(F.col(need).isNotNull() & (F.trim(F.col(need).cast("string")) != ""))


def pivot_codes(df: DataFrame, keys: list[str], code: str, value: Column, codes: dict[str, str]) -> DataFrame:
    """A column per code: the largest value, null if the code is absent."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(code) == c, value)).alias(n) for c, n in codes.items()))


def conditional_sums(df: DataFrame, keys: list[str], code: str, value: str, codes: dict[str, str], digits: int = 2) -> DataFrame:
    """A rounded sum per code, 0 if absent."""
    return df.groupBy(*keys).agg(*(F.round(F.sum(F.when(F.col(code) == c, F.coalesce(F.col(value), F.lit(0.0))).otherwise(0.0)), digits).alias(n) for c, n in codes.items()))
