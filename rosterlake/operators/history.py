"""A registry's history from its periodic files: each key's open version against the next file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators import ranking

# A key is listed as active or deactivated, or is no longer listed.
ACTIVE, DEACTIVATED, GONE = "active", "deactivated", "gone"


class TruncatedFile(ValueError):
    """A file lists far fewer rows than the one before it."""


def check_listed(rows: int, before: int, least_ratio: float = 0.95) -> None:
    """Keys that a cut-off file lacks would all look deactivated, so such a file is refused."""
    if before > 0 and rows < least_ratio * before:
        raise TruncatedFile(f"{rows} rows listed, {before} by the file before")


def last_listed(listed: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key of a file: the last one where a key is listed twice (``order`` puts it first)."""
    return ranking.latest(listed, [key], order)


def apply_period(now: DataFrame, listed: DataFrame, key: str, values: list[str], period: Column, carried: list[str] = (), places: list[str] = (), special: str | None = None) -> DataFrame:
    """Every key's open version after a file, with what the file changed.

    ``now``: key, status, values, from_period, one row per key; ``listed``: key,
    status, values, one row per key.  A key that is new or differs (null-safe)
    gets a version from ``period`` on; an active key that isn't listed is gone,
    all its values null; other keys stay.  A value of ``carried`` that the file
    doesn't have (null) is kept from an active version.  Added: change (new,
    changed, gone, null if none), was_status, moved (a value of ``places``
    differs), special_changed, deactivated, reactivated.
    """
    fields = ["status", *values]
    old = now.select(key, F.struct(*fields, "from_period").alias("_o"))
    new = listed.select(key, F.struct(*fields).alias("_n"))
    both = old.join(new, key, "full_outer")
    o, n = F.col("_o"), F.col("_n")
    was_active = F.coalesce(o["status"] == ACTIVE, F.lit(False))
    is_active = F.coalesce(n["status"] == ACTIVE, F.lit(False))
    value = {c: F.when(n[c].isNull() & was_active & is_active, o[c]).otherwise(n[c]) if c in carried else n[c] for c in values}
    same = o["status"].eqNullSafe(n["status"])
    for c in values:
        same = same & o[c].eqNullSafe(value[c])
    change = F.when(o.isNull(), "new").when(n.isNull(), F.when(was_active, "gone")).when(~same, "changed")
    out = both.withColumn("change", change)
    stays, gone = F.col("change").isNull(), F.col("change") == "gone"
    differs = lambda names: F.coalesce(F.col("change") == "changed", F.lit(False)) & was_active & is_active & reduce(Column.__or__, (~o[c].eqNullSafe(value[c]) for c in names), F.lit(False))
    return out.select(
        key, F.when(stays, o["status"]).when(gone, GONE).otherwise(n["status"]).alias("status"),
        *(F.when(stays, o[c]).when(gone, None).otherwise(value[c]).alias(c) for c in values),
        F.when(stays, o["from_period"]).otherwise(period).alias("from_period"), "change", o["status"].alias("was_status"),
        differs(places or []).alias("moved"), differs([special] if special else []).alias("special_changed"),
        (was_active & ~stays & ~is_active).alias("deactivated"), (o.isNotNull() & ~was_active & ~stays & is_active).alias("reactivated"),
    )


def period_summary(applied: DataFrame) -> DataFrame:
    """One row: how many keys a file added, changed, lost and brought back, and how many are active after it."""
    return applied.agg(
        F.count_if(F.col("change").isNotNull()).alias("versions"), F.count_if(F.col("change") == "new").alias("new"), F.count_if("moved").alias("moved"), F.count_if("special_changed").alias("special_changed"),
        F.count_if("deactivated").alias("deactivated"), F.count_if(F.col("change") == "gone").alias("gone"), F.count_if("reactivated").alias("reactivated"), F.count_if(F.col("status") == ACTIVE).alias("active"),
    )
