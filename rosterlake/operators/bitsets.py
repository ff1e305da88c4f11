"""Sets of whole-number ids as bitmaps: union, intersection and difference without joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of one bitmap (Spark's own).
WIDTH = 32_768


def bitmaps(members: DataFrame, name: str, member: str) -> DataFrame:
    """(name, bucket, bits): each set's members as bitmaps of 32,768 ids. Null ids are left out.

    The ids are dealt out by bucket and sorted by bucket and set, which counting by
    set and by bucket both go on from: a bitmap, large beside the few ids that a
    task has of it, is neither shuffled nor sorted.
    """
    rows = members.filter(F.col(member).isNotNull()).select(name, F.bitmap_bucket_number(F.col(member)).alias("bucket"), F.bitmap_bit_position(F.col(member)).alias("_bit"))
    return rows.repartition("bucket").groupBy("bucket", name).agg(F.bitmap_construct_agg(F.col("_bit")).alias("bits")).select(name, "bucket", "bits")


def union(sets: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, bucket, bits): the members of any set."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg(F.col("bits")).alias("bits"))


def intersection(sets: DataFrame, name: str, of: int, by: list[str] = ()) -> DataFrame:
    """(by, bucket, bits): the members of all ``of`` sets; a bucket that one of them lacks has none."""
    both = sets.groupBy(*by, "bucket").agg(F.bitmap_and_agg(F.col("bits")).alias("bits"), F.count_distinct(name).alias("_n"))
    return both.filter((F.col("_n") == of) & (F.bitmap_count(F.col("bits")) > 0)).drop("_n")


def count(sets: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, members): how many ids there are."""
    return sets.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count(F.col("bits"))), F.lit(0)).cast("long").alias("members"))


def holds(bits: Column, member: Column) -> Column:
    """Whether a bitmap of the id's bucket has it."""
    at = F.bitmap_bit_position(member)
    byte = F.conv(F.substring(F.hex(bits), (2 * F.floor(at / 8) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1


def members(ids: DataFrame, member: str, found: DataFrame) -> DataFrame:
    """The rows of ``ids`` whose id is in the set ``found`` (bucket, bits): an equi join on buckets."""
    at = ids.withColumn("bucket", F.bitmap_bucket_number(F.col(member)))
    return at.join(found.select("bucket", "bits"), "bucket").filter(holds(F.col("bits"), F.col(member))).select(*ids.columns)
