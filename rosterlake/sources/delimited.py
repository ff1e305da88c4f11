"""Delimited files: typed by a spec, named columns only, letterheads skipped, constants added."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import text
from rosterlake.sources.sniffing import sniff

CONVERTERS = {
    "text": text.trimmed, "date_mdy": text.mdy_date, "date_ymd": text.ymd_date, "date": text.flexible_date, "yes_no": text.yes_no, "npi": text.registry_id,
    "number": text.number, "whole": text.whole_number, "optional_number": text.number, "optional_whole": text.whole_number,
}


class HeaderError(ValueError):
    """A required column is not in the file."""


@dataclass(frozen=True)
class Field:
    name: str  #: output column
    header: str  #: the file's header, compared without case and signs
    kind: str = "text"
    required: bool = True


@dataclass(frozen=True)
class FileSpec:
    fields: tuple[Field, ...]
    sep: str = ","  #: ``auto``: told, with the quote, from the first lines
    quote: str = '"'
    encoding: str = "UTF-8"
    header_starts_with: str | None = None  #: the first cell of the header, below a letterhead
    constants: dict[str, str] = field(default_factory=dict)


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lstrip("﻿").lower()).strip("_")


def _told(spark: SparkSession, path: str, spec: FileSpec, most: int = 100) -> FileSpec:
    """The spec with the separator and quote that the first lines show, if it leaves them open."""
    if spec.sep != "auto":
        return spec
    # Line breaks are those that Spark has found, so only the separator and the quote are told here.
    lines = [r["value"] for r in spark.read.option("encoding", spec.encoding).text(path).limit(most).collect()]
    dialect = sniff("\n".join(lines) + "\n", whole=len(lines) < most)
    return replace(spec, sep=dialect.sep, quote=dialect.quote)


def header_of(spark: SparkSession, path: str, spec: FileSpec, most: int = 100) -> tuple[list[str], int]:
    """The header's cells and how many lines stand above it, within the first ``most`` lines."""
    import csv

    for n, row in enumerate(spark.read.option("encoding", spec.encoding).text(path).limit(most).collect()):
        cells = next(csv.reader([row["value"].lstrip("﻿")], delimiter=spec.sep, quotechar=spec.quote), [])
        if cells and (spec.header_starts_with is None or header_key(cells[0]) == header_key(spec.header_starts_with)):
            return cells, n
    raise HeaderError(f"no header in the first {most} lines of {path}")


def _rows(spark: SparkSession, path: str, spec: FileSpec, mode: str, corrupt: str | None = None) -> tuple[DataFrame, list[str]]:
    """The file's data rows as text columns _0, _1, ..., and the header's cells."""
    spec = _told(spark, path, spec)
    cells, above = header_of(spark, path, spec)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(cells))])
    # Without pruning, so that a row's number of cells is looked at whatever columns are read.
    options = {"sep": spec.sep, "quote": spec.quote, "escape": spec.quote, "mode": mode, "columnPruning": "false"}
    if corrupt:
        schema.add(corrupt, "string")
        options["columnNameOfCorruptRecord"] = corrupt
    if spec.header_starts_with is None or (above == 0 and len(spark.read.text(path).inputFiles()) == 1):
        reader = spark.read.options(**options, encoding=spec.encoding, multiLine="true", header="true", enforceSchema="true")
        return reader.schema(schema).csv(path), cells
    # Below a letterhead, lines are skipped by their place. A file's first lines are in one partition, in its block that
    # starts at 0, numbered in order; each file has its own header line there, and all other blocks are data.
    lines = spark.read.option("encoding", spec.encoding).text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = F.regexp_extract("value", rf"^\x{{FEFF}}?{re.escape(spec.quote)}?([^{re.escape(spec.quote + spec.sep)}]*)", 1)
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(first)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    heads = lines.filter((F.col("_block") == 0) & (key == header_key(spec.header_starts_with))).groupBy(F.col("_file").alias("_f")).agg(F.min("_at").alias("_head"))
    lines = lines.join(heads, F.col("_file") == F.col("_f"), "left")
    lacking = F.when((F.col("_block") == 0) & F.col("_head").isNull(), F.raise_error(F.concat(F.lit("HEADER_MISSING: "), F.col("_file"))).cast("boolean")).otherwise(True)
    lines = lines.filter(lacking & ((F.col("_block") > 0) | (F.col("_at") > F.col("_head"))) & (F.trim("value") != ""))
    return lines.select(F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r")).select("r.*"), cells


def read(spark: SparkSession, path: str, spec: FileSpec, strict: bool = True) -> DataFrame:
    """A file's rows, typed. All columns are read as text by name, only those of the spec are parsed.

    ``strict``: rows with another number of cells fail the read; otherwise they
    are read as far as they go, and ``bad_rows`` lists them.  A path may be a
    folder of files with one header.  A letterhead is told from data by its
    position alone, each file's by its own, so no cell of a data row matters;
    below one, a cell can't hold a line break.
    """
    rows, cells = _rows(spark, path, spec, "FAILFAST" if strict else "PERMISSIVE")
    found = {header_key(c): i for i, c in enumerate(cells)}
    missing = [f.header for f in spec.fields if f.required and header_key(f.header) not in found]
    if missing:
        raise HeaderError(f"{path} lacks {missing}")
    columns: list[Column] = []
    for f in spec.fields:
        i = found.get(header_key(f.header))
        columns.append((CONVERTERS[f.kind](F.col(f"_{i}")) if i is not None else CONVERTERS[f.kind](F.lit(None).cast("string"))).alias(f.name))
    return rows.select(*columns, *(F.lit(v).alias(k) for k, v in spec.constants.items()))


def bad_rows(spark: SparkSession, path: str, spec: FileSpec) -> DataFrame:
    """(line, first): the rows that have another number of cells than the header, and their first cells."""
    rows, _ = _rows(spark, path, spec, "PERMISSIVE", "line")
    return rows.filter("line is not null").select("line", F.col("_0").alias("first"))


def read_all(spark: SparkSession, parts: list[tuple[str, FileSpec]]) -> DataFrame:
    """Several files of one shape, each with its constants, as one table."""
    first, *rest = (read(spark, p, s) for p, s in parts)
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
