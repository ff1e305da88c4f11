"""JSON feeds, scraped pages and columnar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, path: str, schema: str, array: str = "results") -> DataFrame:
    """The objects of a JSON document's array, one row each, by an explicit schema."""
    return spark.read.schema(f"{array} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(array))


def exploded(df: DataFrame, array: str, name: str) -> DataFrame:
    """A row per element; rows without elements go."""
    return df.select(*(c for c in df.columns if c != array), F.explode(array).alias(name))


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """zip5, county_fips, tot_ratio of a ZIP to county crosswalk document."""
    rows = spark.read.schema("data struct<results: array<struct<zip:string, geoid:string, tot_ratio:string>>>").option("multiLine", True).json(path)
    return rows.select(F.inline("data.results")).select(F.lpad("zip", 5, "0").alias("zip5"), F.lpad("geoid", 5, "0").alias("county_fips"), F.col("tot_ratio").try_cast("decimal(12,10)").alias("tot_ratio"))


def links(pages: DataFrame, html: str = "html", pattern: str = r'href\s*=\s*"([^"]+)"') -> DataFrame:
    """A row per link of a scraped page."""
    return pages.select(*(c for c in pages.columns if c != html), F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("position", "link"))


def read_points(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: list[str]) -> DataFrame:
    """Points of a Parquet file inside a box; the box and the columns reach the scan."""
    south, west, north, east = box
    return spark.read.parquet(path).filter(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select(*columns)
