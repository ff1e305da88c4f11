"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each row gets a uniform number from a seeded hash; inverting the Poisson
distribution at it gives the row's number of copies, with the source's target
repetition rate as the mean.  Copies are exploded and shuffled globally.

Defined cases: a null source is a source of its own; a source without a target
weight gets ``rest`` (0: its rows go); rows that are equal in key get equal
counts; null text has zero length but still counts as a row; columns of the
input stay, whatever their names, but those named like the added ones (copy,
shuffle_key) are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import cut, join_counted

#: A rate above this is drawn as the sum of several smaller Poisson numbers, so that exp(-rate) keeps its precision.
LARGEST_MEAN = 8.0
#: Terms of the inverted distribution: at a mean of 8, the tail beyond 47 is under 2**-53.
TERMS = 48


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None, rest: float = 0.0, total: float = 1.0) -> DataFrame:
    """(source, rate, draws, cdf): rate = weight x total x rows / the source's rows; weights default to equal ones and are normalised over the sources at hand."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "s string, w double")
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("w", F.coalesce("w", F.lit(rest))).drop("s")
    weighed = cut(weighed)
    rows, mass = weighed.agg(F.sum("n"), F.sum("w")).first()
    out = weighed.withColumn("rate", F.col("w") / F.lit(float(mass or 1)) * F.lit(float(rows or 0) * total) / F.col("n"))
    out = out.withColumn("draws", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + s["p"] * mean / k).alias("cdf")),
        lambda s: s["cdf"],
    )
    return cut(out.select("source", "rate", "draws", walk.alias("cdf")))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", seed: int = 17, rest: float = 0.0, total: float = 1.0) -> DataFrame:
    """The rows of ``docs`` with ``copy`` (from 0) and ``shuffle_key``, in global random order.

    Rows are dealt by the hash of the key and copy, then sorted by it within
    each partition: both the file and the place in it are random, without the
    sampling pass of a range sort.
    """
    clash = {"copy", "shuffle_key"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added by this operator")
    # The columns go along in a struct, so that no name clashes.
    given = docs.select("source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))
    out = join_counted(given, rates(docs, weights, rest, total), "source", "left", F.col("given")[key])
    name = F.coalesce(F.col("given")[key].cast("string"), F.lit(""))
    drawn = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(F.lit(seed), name, j))
    copies = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    out = out.withColumn("n", copies).filter("n > 0").select("given", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    out = out.select("given.*", "copy", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, "copy")).alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
