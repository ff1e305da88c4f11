"""Area history as state: a stream of providers' versions becomes +1 and -1 per area and month, the same as in one batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rosterlake.operators import temporal

OUTPUT = "npi string, area string, month date, delta int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state; a stream's checkpoint holds them, so the number can't change between its runs.
BUCKETS = 4096


def area_deltas(versions: DataFrame, open_from: Column) -> DataFrame:
    """(npi, area, month, delta): -1 for each area that a version leaves, +1 for each that it enters.

    ``versions``: npi, from_period (date), active, areas (array of text), one row
    for each npi and period.  An inactive version has no areas.  A version counts
    in its month, or in the first open month where that is frozen.
    """
    own = F.when(F.col("active") & F.col("areas").isNotNull(), F.array_distinct("areas")).otherwise(F.array().cast("array<string>"))
    now = versions.withColumn("_now", own).withColumn("_was", F.coalesce(F.lag("_now").over(Window.partitionBy("npi").orderBy("from_period")), F.array().cast("array<string>")))
    month = temporal.open_month(F.col("from_period"), open_from, open_from)
    signed = F.concat(
        F.transform(F.array_except("_was", "_now"), lambda a: F.struct(a.alias("area"), F.lit(-1).alias("delta"))),
        F.transform(F.array_except("_now", "_was"), lambda a: F.struct(a.alias("area"), F.lit(1).alias("delta"))),
    )
    return now.select("npi", month.alias("month"), F.explode(signed).alias("s")).select("npi", "s.area", "month", "s.delta")


class _Versions(StatefulProcessor):
    """Of each provider of a bucket: the newest version's period and areas."""

    def __init__(self, open_from: str):
        self.open_from = pd.Timestamp(open_from).date().replace(day=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "held array<struct<npi:string,period:date,areas:array<string>>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: (r[1], set(r[2])) for r in self.held.get()[0]} if self.held.exists() else {}
        out: list[tuple] = []
        listed = [r for part in rows for r in part[["npi", "from_period", "active", "areas"]].itertuples(index=False)]  # a bucket's new versions
        for version in sorted(listed, key=lambda r: pd.Timestamp(r.from_period)):
            day = pd.Timestamp(version.from_period).date()
            period, areas = held.get(version.npi, (None, set()))
            if period is not None and day <= period:
                continue  # a newer one has been counted
            now = {a for a in version.areas if a is not None} if version.active and version.areas is not None else set()
            month = max(day.replace(day=1), self.open_from)
            out += [(version.npi, a, month, -1) for a in sorted(areas - now)] + [(version.npi, a, month, 1) for a in sorted(now - areas)]
            held[version.npi] = day, now
        self.held.update(([(npi, period, sorted(areas)) for npi, (period, areas) in held.items()],))
        if out:
            yield pd.DataFrame(out, columns=["npi", "area", "month", "delta"])

    def close(self) -> None:
        pass


def area_delta_stream(versions: DataFrame, open_from: str) -> DataFrame:
    """``area_deltas`` of a stream, by keyed state; periods of a provider must arrive in order, an older or equal one is passed over.

    Providers are kept in BUCKETS by hash, as each key costs several calls between
    Spark and Python, whatever its rows.  State is a list of small entries for each
    bucket, kept in RocksDB, so it can outgrow memory; the session must name
    PROVIDER as its state store before the query starts.
    """
    keyed = versions.withColumn("_bucket", F.pmod(F.xxhash64("npi"), F.lit(BUCKETS)).cast("int"))
    return keyed.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=_Versions(open_from), outputStructType=OUTPUT, outputMode="append", timeMode="none")
