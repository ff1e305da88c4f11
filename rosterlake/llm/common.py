"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after it has been counted.
BROADCAST_ROWS = 10_000


#: Edges of a partition, where they are read again.
EDGES = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a local folder only where it is unset and the master is local (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="rosterlake-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(left: DataFrame, right: DataFrame, key: str, how: str, salt_by: Column, salts: int = 16) -> DataFrame:
    """Join a large side with one row per key of ``right``; ``right`` should be materialised.

    ``right`` is counted: up to BROADCAST_ROWS rows it is broadcast; beyond, a
    hot key of ``left`` is dealt over ``salts`` copies of its row.  Null keys
    match null keys.
    """
    return join_sized(left, right, key, how, salt_by, right.count(), salts)


def join_sized(left: DataFrame, right: DataFrame, key: str, how: str, salt_by: Column, rows: int, salts: int = 16) -> DataFrame:
    """``join_counted`` where ``right`` is known to have ``rows`` rows."""
    if rows <= BROADCAST_ROWS:
        right = right.withColumnRenamed(key, "_key")
        return left.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = right.withColumnRenamed(key, "_key").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, (F.col("_salt") == F.col("_s")) & F.col(key).eqNullSafe(F.col("_key")), how).drop("_key", "_s", "_salt")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: it cuts the lineage as a checkpoint does, in fewer bytes."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], rows: int, salt_by: list[str], how: str = "inner") -> DataFrame:
    """Join with one row per key of ``right``, which has the key's number of rows of ``left`` as ``k``; ``rows`` is their sum.

    A key with more than 2 rows / BROADCAST_ROWS of them is dealt over so many
    salts; there are fewer than BROADCAST_ROWS / 2 such keys, so their list is
    broadcast. ``right`` should be materialised. Null keys match nothing.
    """
    many = max(64, -(-2 * rows // BROADCAST_ROWS))
    salts = F.ceil(F.col("k") / many).cast("int")
    hubs = right.filter(F.col("k") > many).select(*keys, salts.alias("_salts"))
    left = left.join(F.broadcast(hubs), keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*salt_by), F.col("_salts"))).cast("int")).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("k") > many, salts - 1).otherwise(0))))
    return left.join(right.drop("k"), [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (id, component), component = the smallest id.

    Alternating large-star and small-star steps: each halves path lengths, so
    the rounds grow with the logarithm of a component's diameter; edges that are
    stars to their smallest id already take one.  Where a node's least neighbour
    goes back to its edges, nodes of many edges are broadcast and their edges
    stay where they are: fewer than BROADCAST_ROWS nodes can have more than
    2 n / BROADCAST_ROWS of n edges.  Each round is cut by a checkpoint, and its
    steps keep one partition for EDGES edges, so that few edges make few files.
    """

    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut(df)
        state = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return df.coalesce(parts(state[0])), state

    def parts(n: int) -> int:
        return max(1, -(-n // EDGES))

    def with_least(pairs: DataFrame, least: DataFrame, many: int) -> DataFrame:
        hubs = least.filter(F.col("k") > many).select("u", "m")
        marked = pairs.join(F.broadcast(hubs), "u", "left")
        return marked.filter("m is not null").unionByName(marked.filter("m is null").drop("m").join(least.filter(F.col("k") <= many).select("u", "m"), "u"))

    now, before = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(most):
        if not before[0]:
            break
        many = max(64, -(-2 * before[0] // BROADCAST_ROWS))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        few = parts(2 * before[0])
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k").coalesce(few)
        large = with_least(both, least, many).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(few)
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).coalesce(few)
        small = (
            with_least(large, floor, many).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(floor.select("u", F.col("m").alias("v"))).filter("u <> v").coalesce(few).distinct()
        )
        now, state = settle(small)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: not settled after {most} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_UP = _DOWN = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse, modulo 2^64."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, 2 * len(_UP), 1 << 16)
        with np.errstate(over="ignore"):
            _UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
    return _UP, _DOWN


#: ASCII A-Z to a-z; every other byte as it is.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLUS_ONE = np.arange(1, 257, dtype=np.uint64)
#: Bytes that end a word: space, tab to carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Bytes outside words of letters and digits; bytes of non-ASCII characters are inside.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_spans(data: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs of bytes that are not ``between`` words."""
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = between[data]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[0::2], turn[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``data`` (bytes): a polynomial of its bytes, relative to its start, then mixed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_PLUS_ONE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, in order; fewer words than k give none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, _ = powers(k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += words[i : n + i] * up[i + 1]
        return mix(out + np.uint64(k))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct, sorted hashes of the runs of ``k`` words; a shorter text is one shingle, no words give none."""
    if not len(words):
        return words
    out = ngrams(words, min(k, len(words)))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def lowered(text: str | bytes | None) -> np.ndarray:
    """The text's UTF-8 bytes, A-Z in lower case."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return _LOWER[np.frombuffer(raw, dtype=np.uint8)]


def groups_of(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of about ``most`` characters, with the first one's place."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def stream_groups(keys: list[str], each: Callable[[tuple, dict[str, list]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over partitions sorted by ``keys``: calls ``each`` with a key and its rows' columns, one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done():
            rows = pa.Table.from_batches(parts)
            out = each(now, {n: rows.column(n).to_pylist() for n in rows.schema.names if n not in keys})
            return [] if out is None or not out.num_rows else [out]

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_pylist() for k in keys]
            rows = list(zip(*columns, strict=True))
            start = 0
            for i in range(1, len(rows) + 1):
                if i < len(rows) and rows[i] == rows[start]:
                    continue
                if rows[start] != now:
                    if parts:
                        yield from done()
                    now, parts = rows[start], []
                parts.append(batch.slice(start, i - start))
                start = i
        if parts:
            yield from done()

    return run


#: Bits of a bitmap of wanted keys: 2 MB to broadcast, whatever the number of keys.
BITMAP = 1 << 24


def bit_of(hashes: np.ndarray) -> np.ndarray:
    """Each 64-bit hash's place in a bitmap."""
    return (hashes.view(np.uint64) >> np.uint64(40)).astype(np.int64)


def bitmap(hashes: DataFrame) -> bytes:
    """The bitmap of a column of 64-bit hashes. It lets all of them through and few others; a join must drop those."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BITMAP, dtype=bool)
        for batch in batches:
            seen[bit_of(batch.column(0).to_numpy())] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros(BITMAP // 8, dtype=np.uint8)
        for batch in batches:
            for bits in batch.column("bits").to_pylist():
                both |= np.frombuffer(bits, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], ["bits"])

    marked = hashes.coalesce(64).mapInArrow(mark, "bits binary")
    return marked.coalesce(1).mapInArrow(either, "bits binary").first()["bits"]


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
