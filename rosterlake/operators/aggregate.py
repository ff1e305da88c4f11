"""Aggregations: money sums, conditional and multi-distinct counts, rollups, bitmasks, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(c: str | Column, digits: int = 2) -> Column:
    """A rounded sum with nulls as 0."""
    return F.round(F.sum(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))), digits)


def named_nature(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("Not specified"))


def any_of(c: Column) -> Column:
    """True if some row is true; nulls don't count."""
    return F.coalesce(F.bool_or(c), F.lit(False))


def area_rollup(df: DataFrame, levels: list[list[str]], kinds: list[list[str]], key: str, name: str) -> DataFrame:
    """Distinct keys for every pair of an area level and a kind level, by grouping sets over one scan.

    Many-to-many areas fan out, so keys are counted, never sums of counts.
    Columns outside a grouping are null; area_level and kind_level tell which.
    """
    every = list(dict.fromkeys(c for g in levels + kinds for c in g))
    sets = [sorted({*a, *k}, key=every.index) for a in levels for k in kinds]
    columns = [F.col(c) for c in every]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.count_distinct(key).alias(name), F.grouping_id().cast("long").alias("grouping"))


def bit_or_of(df: DataFrame, by: list[str], bits: dict[str, Column], name: str = "bits") -> DataFrame:
    """OR of one bit per condition that some row of the key meets."""
    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, c in enumerate(bits.values())]
    return df.groupBy(*by).agg(F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), parts)).cast("int").alias(name))


def multiset_hash(df: DataFrame, by: list[str], columns: list[str], name: str = "hash") -> DataFrame:
    """An MD5 of a key's rows that does not depend on their order; nulls and empty texts differ."""
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)))
    return df.groupBy(*by).agg(F.md5(F.array_join(F.sort_array(F.collect_list(row)), ",")).alias(name))


def two_role_sums(df: DataFrame, one: str, two: str, period: str, value: str) -> DataFrame:
    """Sums per key and period in role one, role two, both at once, and any: one + two - both."""
    roles = F.when(F.col(one) == F.col(two), F.array(F.struct(F.col(one).alias("id"), F.lit(True).alias("a"), F.lit(True).alias("b")))).otherwise(
        F.array(F.struct(F.col(one).alias("id"), F.lit(True).alias("a"), F.lit(False).alias("b")), F.struct(F.col(two).alias("id"), F.lit(False).alias("a"), F.lit(True).alias("b")))
    )
    rows = df.select(F.col(period), F.col(value).alias("v"), F.inline(roles)).filter("id is not null")
    return rows.groupBy("id", period).agg(money(F.when(F.col("a"), F.col("v"))).alias("as_one"), money(F.when(F.col("b"), F.col("v"))).alias("as_two"), money(F.when(F.col("a") & F.col("b"), F.col("v"))).alias("as_both"), money("v").alias("any_role"))


def bands(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first band whose upper edge is not below the value; null stays null."""
    out = F.when(c.isNull(), None)
    for e, name in zip(edges, labels, strict=False):
        out = out.when(c <= e, name)
    return out.otherwise(labels[-1])


def rate_per(count: Column, population: Column, base: int = 100_000, digits: int = 1) -> Column:
    """Null without a population."""
    return F.when(population > 0, F.round(count * float(base) / population, digits))
