"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words (of a shorter item, the whole item).  The seeds of
the benchmark go into a bitmap of fixed size; each document's seeds in it are
hits.  A document that covers the threshold of an item must hit ``need`` of its
n positions, so it hits one of any n - need + 1: only the positions whose seeds
fewest documents have are joined with the hits, and an opening that all items and
documents share joins none of them.  Of the pairs so found those that hit too few
positions go; the others meet with their texts and are tiled: running Karp-Rabin
hashes of the windows of unmarked words find the longest common run, all runs of
that length are marked where they don't overlap, and so on with the longest of
what is left until no run of five words is.  The share of the item's words that
tiles cover shows passages even if they are reordered.  A document that covers
``threshold`` of an item is contaminated.

Words are runs of ASCII letters and digits and of other characters, ASCII case
folded; punctuation does not count.  Defined cases: null texts and items count
as empty; an item without words matches nothing; an item of fewer than five
words matches only as a whole; rows that repeat a doc_id or item_id are tiled
each; null ids stay; other columns are dropped by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import NOT_ALNUM, bit_of, bitmap, cut, join_counted, lowered, mix, ngrams, powers, unpacked, word_hashes, word_spans

#: Words of the shortest tile.
SEED = 5
#: Share of an item's words that makes a document contaminated.
THRESHOLD = 0.6


def words_of(text: str | None) -> np.ndarray:
    data = lowered(text)
    return word_hashes(data, *word_spans(data, NOT_ALNUM))


class Windows:
    """Karp-Rabin hashes of the windows of unmarked words, for any width."""

    def __init__(self, words: np.ndarray):
        self.words, self.used = words, np.zeros(len(words), dtype=bool)
        up, self.down = powers(len(words) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)])])

    def free(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows without a marked word."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(marked[width:] == marked[:n])
        with np.errstate(over="ignore"):
            return at, mix((self.sums[at + width] - self.sums[at]) * self.down[at])

    def open(self, at: int, width: int) -> bool:
        """Of a window free before tiles of its own width were marked: whether it still is (only its ends can lie in one)."""
        return not (self.used[at] or self.used[at + width - 1])


def _within_seeds(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The document's words that lie in a window of ``least`` words that the item has, each run of them behind one word that is in no item; and their places."""
    hit = np.flatnonzero(np.isin(ngrams(doc, least), ngrams(item, least)))
    if not len(hit):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    reach = np.zeros(len(doc) + 1, np.int64)
    np.add.at(reach, hit, 1)
    np.add.at(reach, hit + least, -1)
    inside = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
    gap = np.flatnonzero(np.diff(inside) > 1) + 1
    return np.insert(doc[inside], gap, np.uint64(0)), np.insert(inside, gap, -1)


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc position, item position, length) of non-overlapping common runs of ``least`` words or more, longest first.

    Ties go to the first item position, then the first document position.  Memory
    is linear in the texts; each length takes a logarithmic number of passes.
    """
    short, places = _within_seeds(doc, item, least)
    a, b = Windows(short), Windows(item)
    a.used = places < 0
    most, tiles = min(len(short), len(item)), []

    def common(width: int) -> bool:
        return bool(np.isin(b.free(width)[1], a.free(width)[1]).any())

    while most >= least and common(least):
        low, high = least, most  # the longest common run of unmarked words
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        at, hashes = a.free(low)
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        here, sought = b.free(low)
        begin, end = np.searchsorted(hashes, sought, "left"), np.searchsorted(hashes, sought, "right")
        next_of: dict[int, int] = {}  # by a hash's first place: the next one to try
        for i, x, y in zip(here.tolist(), begin.tolist(), end.tolist(), strict=True):
            if x == y or not b.open(i, low):
                continue
            k = next_of.get(x, x)
            while k < y and not a.open(int(at[k]), low):
                k += 1
            next_of[x] = k
            if k < y and np.array_equal(short[(d := int(at[k])) : d + low], item[i : i + low]):
                a.used[d : d + low] = b.used[i : i + low] = True
                tiles.append((int(places[d]), i, low))
        most = low - 1
    return tiles


def item_seeds(benchmark: DataFrame, threshold: float) -> DataFrame:
    """(seed, item, width, positions, need): a row for each position of an item; need: how many must be hit to cover the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                width = min(SEED, len(words))
                if width:
                    found = ngrams(words, width).view(np.int64)
                    need = min(len(found), max(1, math.ceil(threshold * len(words) / width - 1e-9)))
                    yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.full(len(found), x, np.int64)) for x in (item, width, len(found), need))], ["seed", "item", "width", "positions", "need"])

    return benchmark.select("item", "text").dropDuplicates(["item"]).mapInArrow(run, "seed long, item long, width long, positions long, need long")


def seed_hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, seed): the benchmark's seeds that each document (row, text) has, once (and few others, which no join finds)."""
    widths = sorted(r[0] for r in seeds.select("width").distinct().collect())  # SEED numbers at most
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(seeds.select("seed")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = unpacked(shared.value)
        for batch in batches:
            rows, found = [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for width in widths:
                    own = ngrams(words, width)
                    own = np.unique(own[wanted[bit_of(own)]]) if len(own) else own
                    if len(own):
                        rows.append(np.full(len(own), row, np.int64))
                        found.append(own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(found).view(np.int64))], ["row", "seed"])

    return docs.select("row", "text").mapInArrow(run, "row long, seed long").distinct()


def pairs(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, item, met): the pairs that share one of the item's rarest positions, and how many of these."""
    known = cut(hits.groupBy("seed").agg(F.count("*").alias("k")))
    ranked = join_counted(seeds, known, "seed", "left", F.col("item"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("k", F.lit(0)), "seed")
    ranked = ranked.withColumn("at", F.row_number().over(rarest)).filter((F.col("at") <= F.col("positions") - F.col("need") + 1) & F.col("k").isNotNull())
    wanted = cut(ranked.select("seed", "item"))
    return join_counted(hits, wanted, "seed", "inner", F.col("row")).groupBy("row", "item").agg(F.count("*").alias("met"))


def reaching(found: DataFrame, hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """The pairs (row, item) that hit enough of the item's positions to cover the threshold."""
    each = found.select("row", "item").join(hits, "row").join(seeds, ["item", "seed"])
    return each.groupBy("row", "item").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n >= need").select("row", "item")


def leaks(found: DataFrame, docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """(row, item_id, item_words, covered_words, tiles): of the pairs ``found`` (row, item) of documents (row, text) and items (item_id, item, text), those that cover the threshold; each distinct row once."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("row")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = unpacked(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(wanted[bit_of(batch.column("row").to_numpy())]))

    texts = docs.select("row", "text").mapInArrow(pick, "row long, text string").groupBy("row").agg(F.first("text").alias("text"))
    met = found.join(texts, "row")
    items = cut(benchmark.select("item", "item_id", F.col("text").alias("item_text")))
    met = join_counted(met, items, "item", "inner", F.col("row"))
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, (text, item_text) in enumerate(zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), strict=True)):
                item = words_of(item_text)
                tiles = tile(words_of(text), item, min(SEED, len(item)))
                covered = sum(t[2] for t in tiles)
                if covered >= threshold * len(item):
                    keep.append(k)
                    out.append((len(item), covered, len(tiles)))
            chosen = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column("row"), chosen.column("item_id"), *(pa.array([o[c] for o in out], pa.int64()) for c in range(3))], ["row", "item_id", "item_words", "covered_words", "tiles"])

    return met.select("row", "item_id", "text", "item_text").mapInArrow(run, f"row long, item_id {kind}, item_words long, covered_words long, tiles long")


def _keyed(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    row, item = (F.xxhash64(c, F.coalesce("text", F.lit(""))) for c in ("doc_id", "item_id"))
    return docs.select("doc_id", "text", row.alias("row")), benchmark.select("item_id", "text", item.alias("item"))


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles, coverage: a row for each document row and item of which it covers the threshold."""
    base, items = _keyed(docs, benchmark)
    seeds = cut(item_seeds(items, threshold))
    hits = cut(seed_hits(base, seeds))
    found = cut(leaks(cut(reaching(pairs(hits, seeds), hits, seeds)), base, items, threshold))
    out = join_counted(base.select("doc_id", "row"), found, "row", "inner", F.spark_partition_id())
    return out.select("doc_id", "item_id", "item_words", "covered_words", "tiles", (F.col("covered_words") / F.col("item_words")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    base, items = _keyed(docs, benchmark)
    seeds = cut(item_seeds(items, threshold))
    hits = cut(seed_hits(base, seeds))
    found = cut(pairs(hits, seeds))
    best = cut(found.groupBy("row").agg(F.min(F.struct((-F.col("met")).alias("less"), "item")).alias("best")).select("row", "best.item"))
    gone = cut(leaks(best, base, items, threshold).select("row").distinct())
    rest = cut(reaching(found.join(gone, "row", "left_anti").join(best, ["row", "item"], "left_anti"), hits, seeds))
    if not rest.isEmpty():
        gone = cut(gone.unionByName(leaks(rest, base, items, threshold).select("row").distinct()))
    given = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))
    return join_counted(given, gone.withColumn("gone", F.lit(True)), "row", "left", F.spark_partition_id()).filter("gone is null").select("given.*")
