"""Exports: CSV with chosen columns, key ranges in one compressed set, JSON records, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", header: bool = True, compression: str | None = None) -> None:
    out = df.select(*columns) if columns else df
    writer = out.write.mode("overwrite").option("header", header).option("sep", sep)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_ranges(df: DataFrame, path: str, key: str, parts: int) -> None:
    """The full export: ordered key ranges, written in parallel, gzip."""
    write_csv(df.repartitionByRange(parts, key).sortWithinPartitions(key), path, compression="gzip")


def json_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_manifest(df: DataFrame, path: str, name: str, version: str) -> None:
    """One row that tells what a table holds: name, version, rows, columns."""
    row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "rows", F.lit(json.dumps(df.dtypes)).alias("columns"))
    row.coalesce(1).write.mode("overwrite").json(path)
