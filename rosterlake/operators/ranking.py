"""Top-n per key, newest row per key, modes and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key in ``order``.

    ``order`` must end in a unique tie-breaker.  Spark turns the filter on
    ``row_number`` into a per-partition group limit, so a hot key is cut to
    ``k`` rows before the shuffle.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (its end must be unique)."""
    return top_n(df, by, order, 1)


def mode_value(df: DataFrame, by: list[str], value: str, amount: str) -> DataFrame:
    """The value with the largest amount, then the most rows, then the least text; nulls don't count."""
    sums = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(amount).alias("amount"), F.count("*").alias("rows"))
    return latest(sums, by, [F.desc("amount"), F.desc("rows"), F.asc(value)])


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """A page with the total on each row. At most 200 rows a page, within the first 10,000."""
    if not (1 <= size <= 200 and number >= 1 and number * size <= 10_000):
        raise ValueError("a page holds 1 to 200 rows and lies within the first 10,000")
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))  # one row


def in_request_order(request: list, df: DataFrame, key: str) -> DataFrame:
    """One row per requested key, unknown ones too, with its position; repeated keys are answered each."""
    asked = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(request)], f"position int, requested {df.schema[key].dataType.simpleString()}")
    return asked.join(df, asked["requested"] == df[key], "left").withColumn("known", F.col(key).isNotNull())


def widening(df: DataFrame, distance: str, steps: list[float], least: int) -> DataFrame:
    """Rows within the first radius that holds ``least`` rows, else within the last; one pass counts all radii."""
    counts = df.agg(*(F.count_if(F.col(distance) <= s).alias(f"_{i}") for i, s in enumerate(steps)))
    radius = F.coalesce(*(F.when(F.col(f"_{i}") >= least, F.lit(float(s))) for i, s in enumerate(steps)), F.lit(float(steps[-1])))
    return df.join(F.broadcast(counts.select(radius.alias("radius")))).filter(F.col(distance) <= F.col("radius"))  # one row


def next_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows behind the row whose ``order`` values are ``after`` (None: the first ones), all ascending and not null: pages without offsets."""
    if after is not None:
        df = df.filter(F.struct(*order) > F.struct(*(F.lit(v).alias(c) for c, v in zip(order, after, strict=True))))
    return df.orderBy(*order).limit(size)


def nearest(df: DataFrame, distance: str, tie: str, k: int) -> DataFrame:
    """The ``k`` nearest rows, and whether there are more (one row further is looked at)."""
    near = df.orderBy(distance, tie).limit(k + 1)
    more = near.agg((F.count("*") > k).alias("more"))
    return near.orderBy(distance, tie).limit(k).join(F.broadcast(more))  # one row
