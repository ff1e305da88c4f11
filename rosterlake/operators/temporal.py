"""Months, gaps, periods, versions and differences over time, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month(c: Column) -> Column:
    return F.trunc(c, "month")


def open_month(event: Column, open_from: Column, as_of: Column) -> Column:
    """The month an event counts in: its own if still open, else the first open one; the as-of month without a date."""
    return F.when(event.isNull(), month(as_of)).otherwise(F.greatest(month(event), month(open_from)))


def merge_periods(df: DataFrame, key: list[str], start: str, end: str, gap_days: int = 31) -> DataFrame:
    """Periods of each key merged where the next starts within ``gap_days`` of the latest end so far.

    The running maximum decides, not the previous end; a null end is open and
    swallows all later periods.  One shuffle, one sort.
    """
    far = F.lit("9999-12-31").cast("date")
    order = Window.partitionBy(*key).orderBy(start, F.coalesce(F.col(end), far))
    before = F.max(F.coalesce(F.col(end), far)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.coalesce((F.datediff(F.col(start), before) > gap_days).cast("int"), F.lit(1)))
    df = df.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.coalesce(F.col(end), far))
    return df.groupBy(*key, "_group").agg(F.min(start).alias(start), F.when(last != far, last).alias(end), F.count("*").alias("parts")).drop("_group")


def cut_at_termination(periods: DataFrame, terms: DataFrame, key: str, start: str, end: str, term: str, gap_days: int = 31) -> DataFrame:
    """Periods ended the day before the first termination that starts inside them or within ``gap_days`` after their end; other columns stay.

    One sort by key, newest first: the last termination passed is the first one
    after the period's start, so periods and terminations never fan out.
    """
    row = F.struct(*periods.columns)
    both = periods.select(F.col(key).alias("_k"), F.col(start).alias("_at"), F.lit(0).alias("_kind"), row.alias("_p"), F.lit(None).cast("date").alias("_t"))
    both = both.unionByName(terms.select(F.col(key).alias("_k"), F.col(term).alias("_at"), F.lit(1).alias("_kind"), F.col(term).cast("date").alias("_t")), allowMissingColumns=True)
    newest_first = Window.partitionBy("_k").orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_next", F.last("_t", ignorenulls=True).over(newest_first)).filter("_kind = 0").select("_p.*", "_next")
    hit = F.col("_next").isNotNull() & (F.col(end).isNull() | (F.col("_next") <= F.date_add(F.col(end), gap_days)))
    day = F.date_sub("_next", 1)
    ended = F.when(hit, F.least(F.coalesce(F.col(end), day), day)).otherwise(F.col(end))
    return out.withColumns({end: ended, "terminated": F.when(hit, F.col("_next"))}).drop("_next")


def versions(df: DataFrame, key: list[str], order: list[Column], values: list[str], at: str) -> DataFrame:
    """Slowly changing dimension: a row per run of equal values, from ``valid_from`` to ``valid_to`` (null: current)."""
    w = Window.partitionBy(*key).orderBy(*order)
    state = F.struct(*values)
    changed = df.withColumn("_was", F.lag(state).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    starts = changed.filter(F.col("_first") | ~F.col("_was").eqNullSafe(state)).drop("_was", "_first")
    return starts.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def row_diff(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """A row per key that is new, gone or changed, with old and new values (null-safe)."""
    a = old.select(*key, F.struct(*values).alias("_old"))
    b = new.select(*key, F.struct(*values).alias("_new"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.withColumn("change", kind).filter("change is not null").select(*key, "change", *(F.col(f"_old.{v}").alias(f"old_{v}") for v in values), *(F.col(f"_new.{v}").alias(f"new_{v}") for v in values))


def signed_delta(old: DataFrame, new: DataFrame, by: list[str], name: str = "delta") -> DataFrame:
    """Rows that new has more of (positive) or fewer (negative) per key; unchanged keys are left out."""
    rows = new.select(*by, F.lit(1).alias("_d")).unionByName(old.select(*by, F.lit(-1).alias("_d")))
    return rows.groupBy(*by).agg(F.sum("_d").alias(name)).filter(F.col(name) != 0)


def fill_months(df: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Every month between the table's first and last for each key: 0 inside the key's own span, null outside."""
    span = df.agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
    own = df.groupBy(*key).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    spine = own.join(F.broadcast(span)).withColumn(at, F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))))  # one row
    out = spine.join(df, [*key, at], "left")
    return out.select(*key, at, F.when(F.col(at).between(F.col("_first"), F.col("_last")), F.coalesce(F.col(value), F.lit(0))).alias(value))


def net_change(df: DataFrame, key: list[str], at: str, value: str, basis: str | None = None) -> DataFrame:
    """Change from the row before; null on the first and where the basis changes."""
    w = Window.partitionBy(*key).orderBy(at)
    change = F.col(value) - F.lag(value).over(w)
    if basis:
        change = F.when(F.lag(basis).over(w).eqNullSafe(F.col(basis)), change)
    return df.withColumn("net", change)


def year_spans(df: DataFrame, key: list[str], year: str) -> DataFrame:
    """Years as text, "2013–2016, 2019": islands of consecutive years."""
    w = Window.partitionBy(*key).orderBy(year)
    islands = df.select(*key, year).distinct().withColumn("_g", F.col(year) - F.row_number().over(w)).groupBy(*key, "_g").agg(F.min(year).alias("a"), F.max(year).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", "a", "b"))
    return islands.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda s: s["t"]), ", ").alias("years"))


def sessions(df: DataFrame, key: list[str], at: str, gap_seconds: int) -> DataFrame:
    """Sessions of events no more than the gap apart: start, end, events."""
    w = Window.partitionBy(*key).orderBy(at)
    new = F.coalesce((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"))


def as_of(df: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The version in force at a moment."""
    return df.filter((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def carry_forward(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """The last known value where it is missing."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
