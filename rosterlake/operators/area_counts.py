"""Distinct counts by area and specialty that move with what changed, and the monthly events behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators import temporal

AREA = ["area_type", "area_id"]
CELL = [*AREA, "category", "subcategory"]
# Kinds of monthly events.
MOVED_IN, MOVED_OUT, GONE = "moved_in", "moved_out", "deactivated"


def areas(locations: DataFrame, zip_county: DataFrame) -> DataFrame:
    """(npi, area_type, area_id): the nation, states and counties of locations (npi, state, zip5), each once.

    Rows without a state lie nowhere; ids of more than five characters don't count; a ZIP code of several counties counts in each.
    """
    return _held(locations, zip_county).select("npi", F.explode("held").alias("a")).select("npi", "a.*")


def _held(locations: DataFrame, zip_county: DataFrame) -> DataFrame:
    """(npi, held): each provider's areas as one array, so that they are shuffled once, by provider."""
    counties = zip_county.select("zip5", F.col("county_fips").alias("county"))
    located = locations.filter("state is not null").select("npi", "state", "zip5").join(counties, "zip5", "left")
    area = lambda kind, id_: F.struct(F.lit(kind).alias("area_type"), id_.alias("area_id"))
    own = located.select("npi", F.explode(F.array(area("us", F.lit("US")), area("state", F.col("state")), area("county", F.col("county")))).alias("a"))
    return own.filter(F.length("a.area_id") <= 5).groupBy("npi").agg(F.collect_set("a").alias("held"))


def contributions(locations: DataFrame, taxonomies: DataFrame, zip_county: DataFrame, categories: DataFrame) -> DataFrame:
    """(area_type, area_id, category, subcategory, npi): every cell that a provider counts in, once.

    In all (category ''), and for each of its codes' categories and their
    subcategories; a category's own cell has subcategory ''.  ``categories``: code, category, subcategory.
    A provider's areas and kinds are sets beside each other, so no cell comes twice and none is shuffled.
    """
    blank = F.lit("").alias("subcategory")
    level = F.explode(F.array(F.struct("category", blank), F.struct("category", "subcategory")))
    kinds = taxonomies.join(categories.withColumnRenamed("code", "taxonomy_code"), "taxonomy_code").select("npi", level.alias("k"))
    kinds = kinds.groupBy("npi").agg(F.collect_set("k").alias("kinds"))
    everyone = F.array(F.struct(F.lit("").alias("category"), blank))
    both = _held(locations, zip_county).join(kinds, "npi", "left").select("npi", "held", F.when(F.col("kinds").isNull(), everyone).otherwise(F.array_union(everyone, "kinds")).alias("kinds"))
    return both.select("npi", "kinds", F.explode("held").alias("a")).select("npi", "a.*", F.explode("kinds").alias("k")).select(*AREA, "k.*", "npi")


def counted(cells: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """A full build: the cells' distinct members."""
    return cells.groupBy(*keys).agg(F.count("*").alias("providers"))


def moved(counts: DataFrame, old: DataFrame, new: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Counts after some members' cells went from ``old`` to ``new``: only cells that differ move, and empty ones go."""
    signed = new.select(*keys, F.lit(1).alias("d")).unionByName(old.select(*keys, F.lit(-1).alias("d")))
    delta = signed.groupBy(*keys).agg(F.sum("d").alias("d")).filter("d <> 0").select(*keys, F.col("d").alias("providers"))
    return counts.select(*keys, "providers").unionByName(delta).groupBy(*keys).agg(F.sum("providers").alias("providers")).filter("providers > 0")


def support(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, member, n): how many rows hold a member in a cell."""
    return rows.groupBy(*keys, member).agg(F.count("*").alias("n"))


def apply_rows(supports: DataFrame, signed: DataFrame, keys: list[str], member: str) -> tuple[DataFrame, DataFrame]:
    """Supports (keys, member, n) after signed rows (keys, member, d), and what they add to each cell's distinct count.

    A member counts while rows hold it: the count moves only where n leaves zero
    or comes back to it.  One shuffle by (keys, member) for both.  More rows taken
    off than there are is an error (NEGATIVE_SUPPORT).
    """
    both = supports.select(*keys, member, "n", F.lit(0).cast("long").alias("d")).unionByName(signed.select(*keys, member, F.lit(0).cast("long").alias("n"), F.col("d").cast("long").alias("d")))
    now = both.groupBy(*keys, member).agg(F.sum("n").alias("was"), F.sum(F.col("n") + F.col("d")).alias("n"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("NEGATIVE_SUPPORT: more rows taken off than there are")).cast("long")).otherwise(F.col("n"))
    now = now.withColumn("n", checked)
    crossed = (F.col("n") > 0).cast("int") - (F.col("was") > 0).cast("int")
    return now.filter("n > 0").drop("was"), now.groupBy(*keys).agg(F.sum(crossed).alias("d")).filter("d <> 0")


def add_deltas(counts: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (keys, members) after deltas (keys, d); cells without members go."""
    return counts.select(*keys, "members").unionByName(delta.select(*keys, F.col("d").alias("members"))).groupBy(*keys).agg(F.sum("members").alias("members")).filter("members > 0")


def area_events(old: DataFrame, new: DataFrame, providers: DataFrame, deactivated: DataFrame, open_from: Column, as_of: Column) -> DataFrame:
    """(area_type, area_id, month, kind, npi): moves and deactivations between two states of providers' areas (npi, area_type, area_id).

    Moved out: an area that an active provider (npi, last_update_date) has left.
    Moved in: a new area of one who had areas before; a new one doesn't move.
    Deactivated: the old areas of one who is in ``deactivated`` (npi,
    deactivation_date) and no longer in ``providers``.  An event counts in its own
    month, in the first open one if that is frozen, in the as-of month without a
    date.  The event rows are the counts' provenance: each holds its member.
    """
    at = ["npi", *AREA]
    old, new = (df.select(*at).filter(F.col("area_type") != "us").distinct() for df in (old, new))
    active = providers.select("npi", F.col("last_update_date").alias("day"))
    left = old.join(new, at, "left_anti").join(active, "npi").withColumn("kind", F.lit(MOVED_OUT))
    come = new.join(old, at, "left_anti").join(old.select("npi").distinct(), "npi", "left_semi").join(active, "npi").withColumn("kind", F.lit(MOVED_IN))
    gone = old.join(deactivated.select("npi", F.col("deactivation_date").alias("day")), "npi").join(active, "npi", "left_anti").withColumn("kind", F.lit(GONE))
    events = left.unionByName(come).unionByName(gone)
    return events.select(*AREA, temporal.open_month(F.col("day"), open_from, as_of).alias("month"), "kind", "npi").distinct()


def monthly(events: DataFrame) -> DataFrame:
    """(area_type, area_id, month, kind, members): what each month's events count."""
    return events.groupBy(*AREA, "month", "kind").agg(F.count("*").alias("members"))


def behind(events: DataFrame, area_type: str, area_id: str, month: Column, kind: str) -> DataFrame:
    """(npi): the members behind one monthly count, exactly as many as it tells."""
    return events.filter((F.col("area_type") == area_type) & (F.col("area_id") == area_id) & (F.col("month") == month) & (F.col("kind") == kind)).select("npi").orderBy("npi")


def months_without_file(versions: DataFrame, periods: DataFrame, key: str, at: str) -> DataFrame:
    """(key, at, missing): the months without a file that each version may date from.

    ``periods``: period, status (Completed or Missing).  Those are the missing
    months behind the last month with a file before the version's own, not before
    the key's previous version: unchanged through later files, it can't have
    changed earlier.  A first version has none.  Periods are months, so there are
    few; they are gathered once into an array that all versions share.
    """
    from pyspark.sql import Window

    months = periods.agg(F.array_sort(F.collect_set(F.when(F.col("status") == "Completed", F.col("period")))).alias("_files"), F.array_sort(F.collect_set(F.when(F.col("status") == "Missing", F.col("period")))).alias("_gaps"))
    own, before = F.col(at), F.col("_before")
    last_file = F.coalesce(F.array_max(F.filter("_files", lambda p: (p >= before) & (p < own))), before)
    told = versions.withColumn("_before", F.lag(at).over(Window.partitionBy(key).orderBy(at))).join(F.broadcast(months))  # one row
    gaps = F.filter("_gaps", lambda p: (p > last_file) & (p < own))
    return told.select(key, at, F.when(before.isNull(), F.array().cast("array<date>")).otherwise(gaps).alias("missing"))
