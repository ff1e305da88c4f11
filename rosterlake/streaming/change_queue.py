"""A queue of changed keys for several consumers: an append-only log, one offset for each consumer, and old rows kept until nobody needs them.

Each batch of the log holds changed keys with the rows that they had before.  A
consumer takes all keys of the batches behind its offset, each once, with its
rows as the consumer last saw them: those of the first such batch that has the
key.  Its offset moves only when it commits, together with the place of what it
has built; so what a crash interrupts is taken again, with no key lost, and what
was built but not committed is never looked at.  All of it are Parquet tables in
one shared folder; a batch counts from the moment that its number is listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class StaleBatch(RuntimeError):
    """A batch whose consumer has committed another one since it was taken."""


@dataclass(frozen=True)
class Taken:
    """What a consumer has to work on: batches above ``after`` up to ``upto``."""

    consumer: str
    after: int
    upto: int
    keys: DataFrame  #: one row per changed key
    old: DataFrame  #: the keys' rows as the consumer last saw them; none for a key that was new


class ChangeQueue:
    def __init__(self, spark: SparkSession, root: str, key: str, old_schema: str):
        """``old_schema``: the columns of a key's old rows, besides the key."""
        self.spark, self.root, self.key = spark, root, key
        self.old_schema = old_schema
        for name, schema in (("batches", "batch long"), ("offsets", "consumer string, batch long, built string")):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")

    def _listed(self) -> list[int]:
        # One row for each batch that hasn't been trimmed.
        return sorted(r["batch"] for r in self.spark.read.schema("batch long").parquet(f"{self.root}/batches").distinct().collect())

    def _put(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def append(self, keys: DataFrame, old: DataFrame) -> int:
        """Add a batch of changed ``keys`` with the rows of them in ``old``, the table before it changes; returns its number.

        A batch that a crash left unlisted is written over.
        """
        number = max(self._listed(), default=0) + 1
        wanted = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        columns = [c for c in old.columns if c != self.key]
        rows = wanted.join(old.select(self.key, F.struct(*columns).alias("old")), self.key, "left")
        rows.write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")
        self._put("batches", (number,), "batch long")
        return number

    def offset(self, consumer: str) -> tuple[int, str | None]:
        """The last batch that the consumer has committed, and what it had built by then."""
        told = self.spark.read.schema("consumer string, batch long, built string").parquet(f"{self.root}/offsets").filter(F.col("consumer") == consumer)
        last = told.agg(F.max(F.struct("batch", "built")).alias("last")).first()["last"]
        return (last["batch"], last["built"]) if last else (0, None)

    def take(self, consumer: str) -> Taken:
        """All keys behind the consumer's offset. Taking changes nothing."""
        after, _ = self.offset(consumer)
        numbers = [n for n in self._listed() if n > after]
        kind = self.spark.createDataFrame([], f"{self.key} string, old struct<{self.old_schema}>").schema["old"].dataType
        if numbers:
            log = self.spark.read.option("basePath", f"{self.root}/log").parquet(*(f"{self.root}/log/batch={n}" for n in numbers))
        else:
            log = self.spark.createDataFrame([], f"{self.key} string, old {kind.simpleString()}, batch long")
        first = log.withColumn("_first", F.min("batch").over(Window.partitionBy(self.key))).filter("batch = _first")
        old = first.filter("old is not null").select(self.key, "old.*")
        return Taken(consumer, after, max(numbers, default=after), log.select(self.key).distinct(), old)

    def commit(self, taken: Taken, built: str | None = None) -> None:
        """Move the consumer's offset behind what it has taken, and name what it has built."""
        now, _ = self.offset(taken.consumer)
        if now != taken.after:
            raise StaleBatch(f"{taken.consumer}: taken after batch {taken.after}, but {now} is committed")
        self._put("offsets", (taken.consumer, taken.upto, built), "consumer string, batch long, built string")

    def trim(self, consumers: list[str]) -> list[int]:
        """Empty the batches that all of ``consumers`` have committed; returns their numbers."""
        least = min((self.offset(c)[0] for c in consumers), default=0)
        gone = [n for n in self._listed() if n <= least]
        for n in gone[:-1] if gone and gone[-1] == max(self._listed()) else gone:  # the last number stays, so that none is given twice
            schema = self.spark.read.parquet(f"{self.root}/log/batch={n}").schema
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/log/batch={n}")
        return gone
