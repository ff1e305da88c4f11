"""Table maintenance: guarded replacement, keyed replacement and upserts, as DataFrame algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TooFewRows(ValueError):
    """A build would replace a table by far fewer rows."""


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def recover(spark: SparkSession, path: str) -> None:
    """Undo a swap that ended half way: where the table is missing and the one before it is there, that one comes back."""
    fs, make = _file_system(spark, path)
    if not fs.exists(make(path)) and fs.exists(make(path + "_old")):
        _move(fs, make(path + "_old"), make(path))


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def guarded_replace(new: DataFrame, path: str, least_ratio: float = 0.9) -> int:
    """Write ``new`` beside ``path`` and swap, unless it has under ``least_ratio`` of the rows there; returns the rows written.

    Paths go through Hadoop's file system, so that any store works.  A swap that
    ended half way is undone by the next call, or by ``recover`` before a read.
    """
    spark = new.sparkSession
    new.write.mode("overwrite").parquet(path + "_staging")
    recover(spark, path)
    fs, make = _file_system(spark, path)
    target, staged, old = make(path), make(path + "_staging"), make(path + "_old")
    rows = spark.read.parquet(path + "_staging").count()
    if fs.exists(target):
        before = spark.read.parquet(path).count()
        if rows < least_ratio * before:
            fs.delete(staged, True)
            raise TooFewRows(f"{rows} rows would replace {before}")
        fs.delete(old, True)
        _move(fs, target, old)
    _move(fs, staged, target)
    fs.delete(old, True)
    return rows


def replace_keys(table: DataFrame, fresh: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The table with all rows of the changed keys taken from ``fresh``."""
    return table.join(keys, key, "left_anti").unionByName(fresh.join(keys, key, "left_semi"))


def upsert(table: DataFrame, changes: DataFrame, key: list[str], keep_old: bool = False) -> DataFrame:
    """Changed rows replace, new ones are added; a null in a change is written, or with ``keep_old`` keeps the old value."""
    rest = [c for c in table.columns if c not in key]
    joined = table.select(*key, F.struct(*rest).alias("_t")).join(changes.select(*key, F.struct(*rest).alias("_c")), key, "full_outer")
    old, new = F.col("_t"), F.col("_c")
    return joined.select(*key, *((F.coalesce(new[c], old[c]) if keep_old else F.when(new.isNotNull(), new[c]).otherwise(old[c])).alias(c) for c in rest))


def or_bits(table: DataFrame, changes: DataFrame, key: list[str], bits: str) -> DataFrame:
    return table.select(*key, bits).unionByName(changes.select(*key, bits)).groupBy(*key).agg(F.bit_or(bits).alias(bits))


def add_counts(table: DataFrame, deltas: DataFrame, key: list[str], count: str) -> DataFrame:
    return table.select(*key, count).unionByName(deltas.select(*key, count)).groupBy(*key).agg(F.sum(count).alias(count))


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows whose key is new are added; of those that repeat a key, the first in ``order``."""
    from rosterlake.operators.ranking import latest

    return table.unionByName(latest(rows, key, order).join(table, key, "left_anti"))
