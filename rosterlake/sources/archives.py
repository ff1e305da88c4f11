"""Rows of delimited files inside zip archives, without unpacking them: one Spark partition for each entry, streamed.

Deflated entries can't be split, so an entry is one task's work; it is read as it
unzips, in batches of rows, and neither the driver nor a task holds a whole one.
The archives lie on a file system that the driver and all executors mount.
"""

from __future__ import annotations

import csv
import glob
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructType

from rosterlake.functions import text
from rosterlake.sources.sniffing import Dialect, sniff

ROWS, SAMPLE = 10_000, 1 << 16
#: Columns that are told of each row besides its cells.
ARCHIVE, ENTRY, NUMBER = "_archive", "_entry", "_number"


class ArchiveError(ValueError):
    """An archive without a fitting entry, or an entry whose rows don't fit its header."""


@dataclass
class Entry(InputPartition):
    archive: str
    name: str
    size: int

    def __post_init__(self):
        super().__init__((self.archive, self.name))


def entries(paths: list[str], pattern: str, largest: bool = False) -> list[Entry]:
    """The entries whose name has ``pattern``, in order; ``largest``: of each archive only the largest one. Looks at directories only."""
    found = []
    for path in paths:
        for archive in sorted(glob.glob(path.removeprefix("file://").removeprefix("file:"))):
            with zipfile.ZipFile(archive) as z:
                fits = [Entry(archive, i.filename, i.file_size) for i in z.infolist() if not i.is_dir() and re.search(pattern, i.filename)]
            found += sorted(fits, key=lambda e: (-e.size, e.name))[:1] if largest else sorted(fits, key=lambda e: e.name)
    if not found:
        raise ArchiveError(f"no entry like {pattern} in {paths}")
    return found


def _open(entry: Entry, encoding: str) -> io.TextIOWrapper:
    # The archive stays open as long as its entry is read.
    return io.TextIOWrapper(zipfile.ZipFile(entry.archive).open(entry.name), encoding=encoding, newline="")


def _records(entry: Entry, options: dict[str, str]) -> tuple[list[str], Iterator[list[str]]]:
    """The header's cells and the rows below, as they are unzipped."""
    encoding = options.get("encoding", "utf-8-sig")
    if options.get("sep", "auto") == "auto":
        with _open(entry, encoding) as sample:
            dialect = sniff(sample.read(SAMPLE))
    else:
        dialect = Dialect(options["sep"], options.get("quote", '"'))
    quoting = {"quotechar": dialect.quote, "doublequote": True} if dialect.quote else {"quoting": csv.QUOTE_NONE}
    rows = csv.reader(_open(entry, encoding), delimiter=dialect.sep, strict=bool(dialect.quote), **quoting)
    header = next(rows, None)
    if not header:
        raise ArchiveError(f"{entry.archive}: {entry.name} has no header")
    return [c.strip() for c in header], rows


class ZippedRows(DataSource):
    """``spark.read.format("zipped_rows")``: all cells as text, empty ones null, named by the header of the first entry.

    Options: ``paths`` (a JSON list, patterns allowed), ``entry`` (a regular
    expression of entry names), ``largest``, ``sep`` and ``quote`` (told from the
    first lines if ``sep`` is ``auto``), ``encoding``, ``ragged``.  Other entries
    may have the columns in another order, or fewer.  A row with another number of
    cells fails the read, or if ``ragged`` keeps the cells that it has.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_rows"

    def _entries(self) -> list[Entry]:
        return entries(json.loads(self.options["paths"]), self.options.get("entry", r"(?i)\.(csv|txt)$"), self.options.get("largest", "false") == "true")

    def schema(self) -> StructType:
        header, _ = _records(self._entries()[0], self.options)
        out = StructType().add(ARCHIVE, StringType()).add(ENTRY, StringType()).add(NUMBER, LongType())
        for column in header:
            out.add(column, StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedReader(self.options, schema, self._entries())


class ZippedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType, found: list[Entry]):
        self.options, self.names, self.found = dict(options), schema.names[3:], found

    def partitions(self) -> list[Entry]:
        return self.found

    def read(self, entry: Entry) -> Iterator[pa.RecordBatch]:
        header, rows = _records(entry, self.options)
        at = {c: i for i, c in enumerate(header)}
        ragged, width = self.options.get("ragged", "false") == "true", len(header)
        cells: list[list[str | None]] = [[] for _ in self.names]
        numbers: list[int] = []

        def batch() -> pa.RecordBatch:
            n = len(numbers)
            out = pa.RecordBatch.from_arrays(
                [pa.array([entry.archive] * n, pa.string()), pa.array([entry.name] * n, pa.string()), pa.array(numbers, pa.int64()), *(pa.array(c, pa.string()) for c in cells)],
                [ARCHIVE, ENTRY, NUMBER, *self.names],
            )
            numbers.clear()
            for c in cells:
                c.clear()
            return out

        for number, row in enumerate(rows, 1):
            if not row:
                continue
            if len(row) != width and not ragged:
                raise ArchiveError(f"{entry.archive}: row {number} of {entry.name} has {len(row)} cells, its header {width}")
            numbers.append(number)
            for name, column in zip(self.names, cells, strict=True):
                i = at.get(name)
                column.append(row[i] or None if i is not None and i < len(row) else None)
            if len(numbers) == ROWS:
                yield batch()
        if numbers:
            yield batch()


def read_zipped(spark: SparkSession, paths: list[str], entry: str = r"(?i)\.(csv|txt)$", **options: str) -> DataFrame:
    """The rows of all fitting entries, with their archive, entry and number."""
    spark.dataSource.register(ZippedRows)
    return spark.read.format("zipped_rows").options(paths=json.dumps(paths), entry=entry, **options).load()


def row_hash(columns: list[str]) -> Column:
    """The digest of a row's cells as they are in the file, in the order of the columns' names, so that the file's order doesn't matter."""
    cells = [F.coalesce(F.nullif(F.col(f"`{c}`"), F.lit("")), F.lit("\x00")) for c in sorted(columns, key=str.upper)]
    return F.md5(F.concat_ws("\x1f", *cells))


def staged(spark: SparkSession, paths: list[str], parts: dict[str, str], hashed: str | None = None) -> dict[str, DataFrame]:
    """Staging tables of archives, one for each name and entry pattern of ``parts``; the one named ``hashed`` has ``source_hash``, all have ``loaded_from``."""
    out = {}
    for name, pattern in parts.items():
        rows = read_zipped(spark, paths, pattern)
        cells = [c for c in rows.columns if c not in (ARCHIVE, ENTRY, NUMBER)]
        more = [row_hash(cells).alias("source_hash")] if name == hashed else []
        out[name] = rows.select(*cells, *more, F.col(ENTRY).alias("loaded_from"))
    return out


def with_locations(main: DataFrame, locations: DataFrame | None, key: str, state: str, postal: str, country: str) -> DataFrame:
    """Rows of the main entry with ``places``: the distinct (state, zip5) of the key's rows in the locations entry, in order.

    A key without rows there has none; without a locations entry (the older
    files) ``places`` is null, not empty.  States longer than five characters and
    ZIP codes of other countries are left out of a place.  Of a key's rows in the
    main entry the last one stands.
    """
    if NUMBER in main.columns:
        last = Window.partitionBy(ARCHIVE, key).orderBy(F.desc(NUMBER))
        main = main.withColumn("_last", F.row_number().over(last)).filter("_last = 1").drop("_last")
    place = "array<struct<state:string,zip5:string>>"
    if locations is None:
        return main.withColumn("places", F.lit(None).cast(place))
    shown = F.col(state)
    each = F.struct(F.when(F.length(shown) <= 5, shown).alias("state"), text.zip5(F.col(postal), F.col(country)).alias("zip5"))
    known = locations.filter(shown.isNotNull() & (F.length(shown) <= 5)).groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(each)).alias("places"))
    return main.join(known, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("places", F.coalesce("places", F.array().cast(place)))


# Kinds of enrollment that count.
ENROLLED = ("ENROLLMENT", "LIMITED", "LIMITED ENROLLMENT")


def active_enrollments(rows: DataFrame, columns: dict[str, str], today: Column) -> DataFrame:
    """(npi, effective, limited): active enrollments of a ragged pipe-separated list.

    ``columns`` names name, type, npi, status, effective and end.  A line without
    a name is one more address of the provider above and doesn't count; an
    enrollment counts if its kind does, its status is A, its end isn't past and
    its number's check digit holds.
    """
    c = {k: F.trim(F.col(f"`{v}`")) for k, v in columns.items()}
    day = {k: F.when(F.rlike(c[k], F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_timestamp(c[k], F.lit("yyyy-MM-dd")).cast("date")) for k in ("effective", "end")}
    day = {k: F.when(F.year(d) > 1900, d) for k, d in day.items()}
    kept = (F.coalesce(c["name"], F.lit("")) != "") & F.upper(c["type"]).isin(*ENROLLED) & (c["status"] == "A") & text.check_digit_ok(c["npi"]) & F.coalesce(day["end"] >= today, F.lit(True))
    return rows.filter(kept).select(c["npi"].alias("npi"), day["effective"].alias("effective"), (F.upper(c["type"]) != "ENROLLMENT").alias("limited"))
