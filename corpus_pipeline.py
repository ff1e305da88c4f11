"""The corpus pipeline: five stages over ``documents``, each one operator of ``rosterlake.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared checkpoint folder and reads again for the next
stage.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import decontam, jaccard, line_dedup, mixing, toxicity
from rosterlake.llm.common import cut, ensure_checkpoint_dir, join_counted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the CRF learns from labels outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tag = toxicity.scorer(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for told in tag(iter([batch.select(["text"])])):
                yield batch.slice(at, told.num_rows).filter(pa.array(told.column("predicted").to_numpy() == 0))
                at += told.num_rows

    return docs.mapInArrow(keep, docs.schema)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each line; documents of which no text is left go, n_chars follows the text."""
    out = line_dedup.deduplicate(docs)
    emptied = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    return out.filter(~emptied).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id (null last), and of equal ids one text; documents without words all stay.

    A row is known by id and text, so that a row that repeats another's id with
    other text is judged by itself; of rows equal in both, one stays.
    """
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"))
    keyed = docs.select(row.alias("row"), F.struct(*docs.columns).alias("given"))
    groups = jaccard.join(docs.select(row.alias("doc_id"), "text"))
    told = groups.groupBy("doc_id").agg(F.min("component_id").alias("kept"), F.count("*").alias("k"), F.max("n_shingles").alias("n"))
    told = cut(told.filter("n > 0 and (k > 1 or doc_id <> kept)").select(F.col("doc_id").alias("row"), (F.col("doc_id") != F.col("kept")).alias("gone")))
    marked = join_counted(keyed, told, "row", "left", F.spark_partition_id())
    once = marked.filter("not gone").groupBy("row").agg(F.first("given").alias("given"))  # rows that are there several times
    return marked.filter("gone is null").select("given.*").unionByName(once.select("given.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's passage."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at the same weight, replicated and shuffled."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
]

#: The chain, SimHashes and tilings have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
