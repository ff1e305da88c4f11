"""Substring dedup: words of passages that also stand in an earlier document go.

Difference-cover anchors.  D is a set of residues whose differences give every
residue modulo PERIOD.  Of each document, runs of ``ANCHOR = words - PERIOD + 1``
words are hashed only where their start modulo PERIOD lies in D.  Two documents
that share ``words`` words at places i and j share an anchor inside them: for
some shift below PERIOD both i + shift and j + shift are cover positions.

1. Anchors are counted; only those of two or more rows are kept.
2. The rows that hold such anchors get them by a join (a bitmap only spares the
   exchange of others), and their texts are written once; rows whose whole text a
   smaller doc_id has are repeats from end to end and go no further.
3. Each anchor is extended: the windows of ``words`` words around it, once for
   each row, are brought together by their hash (64 bits and 32 more, so that
   windows of one hash are equal).  All but those of the smallest doc_id are
   repeats.  Windows around an anchor that very many rows hold are counted
   first and dealt over salts; whether a window is one of these depends on its
   words alone.
4. The repeats go back to their rows, which drop each word that one covers.

Windows are judged on the input.  Defined cases: null text has no words; a text
shorter than ``words`` words stays; rows of one doc_id don't count against each
other, whether their texts are equal or not; a null doc_id counts as larger than
any other (and rows without one not against each other); repeats within one
document stay; a text of which nothing goes is left as it is, else the words
left are joined by one space.  Other columns stay, whatever their names, but
n_words and n_removed, which are set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import BROADCAST_ROWS, bit_of, bitmap, groups_of, join_dealt, mix, powers, unpacked, word_hashes, word_spans, written

WORDS = 50
#: A perfect difference set: each residue but 0 is one difference.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Rows that hold an anchor, from which on its windows are counted before they are brought together. A window of which no
#: anchor is held so often has at most 31 / 6 times as many rows, about a megabyte in one task.
HOT = 4096
#: A row's key: its doc_id and two hashes of its text, of 64 and 32 bits; rows equal in it are one.
ROW = ["doc_id", "t", "u"]
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def read_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined by a line break: the bytes, word starts and ends, word hashes, and each text's first word and number of words."""
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    starts, ends = word_spans(data)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(starts, begin)
    return data, starts, ends, word_hashes(data, starts, ends), first[:-1], np.diff(first)


def runs(words: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place, by differences of one running sum."""
    with np.errstate(over="ignore"):
        up, down = powers(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix((sums[places + k] - sums[places]) * down[places] + np.uint64(k))


def starts_of(first: np.ndarray, counts: np.ndarray, k: int, residues: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of each run of k words, where the place in its text has one of the ``residues`` modulo PERIOD."""
    most = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(first)), most)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most)
    if residues is not None:
        some = np.flatnonzero(residues[at % PERIOD])
        owner, at = owner[some], at[some]
    return owner, at + first[owner]


def once(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first place of each pair of owner and hash."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    return order[np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))] if len(order) else order


def _raw(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


class Cover:
    """Windows of ``words`` words and the anchors inside them."""

    def __init__(self, words: int = WORDS, hot: int = HOT):
        if words < PERIOD:
            raise ValueError(f"windows of fewer than {PERIOD} words")
        self.words, self.anchor, self.hot = words, words - PERIOD + 1, hot
        self.residues = np.zeros(PERIOD, dtype=bool)
        self.residues[list(COVER)] = True

    def anchors(self, base: DataFrame, bits: bytes | None = None) -> DataFrame:
        """(hash) or, of those in the bitmap ``bits``, (hash, doc_id, t, u): each row's distinct anchors."""
        kind = base.schema["doc_id"].dataType.simpleString()
        sent = None if bits is None else base.sparkSession.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None if sent is None else unpacked(sent.value)
            for batch in batches:
                for start, texts in groups_of(batch.column("text").to_pylist()):
                    _, _, _, words, first, counts = read_words(_raw(texts))
                    owner, at = starts_of(first, counts, self.anchor, self.residues)
                    hashes = runs(words, at, self.anchor)
                    if known is not None:
                        some = known[bit_of(hashes)]
                        owner, hashes = owner[some], hashes[some]
                    keep = once(owner, hashes)
                    found = pa.array(hashes[keep].view(np.int64))
                    if known is None:
                        yield pa.RecordBatch.from_arrays([found], ["hash"])
                    else:
                        rows = pa.array(owner[keep] + start)
                        yield pa.RecordBatch.from_arrays([found, *(batch.column(c).take(rows) for c in ROW)], ["hash", *ROW])

        return base.select(*ROW, "text").mapInArrow(run, "hash long" if bits is None else f"hash long, doc_id {kind}, t long, u long")

    def windows(self, flagged: DataFrame, hot: list[int]) -> DataFrame:
        """(h, c, hot, doc_id, t, u): the distinct windows around the anchors of rows (doc_id, t, u, text, anchors); hot: one of its runs is in the list."""
        kind = flagged.schema["doc_id"].dataType.simpleString()
        known = flagged.sparkSession.sparkContext.broadcast(np.sort(np.array(hot, dtype=np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = known.value
            for batch in batches:
                marks = batch.column("anchors")
                for i, text in enumerate(batch.column("text").to_pylist()):
                    _, _, _, words, first, counts = read_words(_raw([text]))
                    _, at = starts_of(first, counts, self.anchor)
                    every = runs(words, at, self.anchor).view(np.int64)
                    shared = np.isin(every, marks[i].values.to_numpy(zero_copy_only=False)) & self.residues[np.arange(len(every)) % PERIOD]
                    places = np.flatnonzero(self.spread(shared))
                    h = runs(words, places, self.words)
                    places, h = (x[once(np.zeros(len(h), np.int64), h)] for x in (places, h))
                    with np.errstate(over="ignore"):
                        c = runs(mix(words ^ _SECOND), places, self.words).view(np.int64).astype(np.int32)
                    common = self.spread(np.isin(every, often))[places] if len(often) else np.zeros(len(places), bool)
                    row = pa.array(np.full(len(places), i))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(common), *(batch.column(c).take(row) for c in ROW)], ["h", "c", "hot", *ROW])

        return flagged.select(*ROW, "text", "anchors").mapInArrow(run, f"h long, c int, hot boolean, doc_id {kind}, t long, u long")

    def spread(self, anchors: np.ndarray) -> np.ndarray:
        """For each window: whether an anchor inside it is marked."""
        sums = np.concatenate([[0], np.cumsum(anchors)])
        return sums[PERIOD:] > sums[:-PERIOD] if len(sums) > PERIOD else np.zeros(0, bool)

    def without(self, rows: DataFrame) -> DataFrame:
        """Rows (given, text, gone: hashes of repeats or null, whole) without the words that repeats cover: their columns, the new text and n_removed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gone, whole, out, removed = batch.column("gone"), batch.column("whole").to_pylist(), [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    drop = np.zeros(0, bool)
                    if whole[i] or gone[i].is_valid:
                        data, starts, ends, words, first, counts = read_words(_raw([text]))
                        _, at = starts_of(first, counts, self.words)
                        hit = np.ones(len(at), bool) if whole[i] else np.isin(runs(words, at, self.words).view(np.int64), gone[i].values.to_numpy(zero_copy_only=False))
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        edge[: len(hit)] += hit
                        edge[self.words : self.words + len(hit)] -= hit
                        drop = np.cumsum(edge)[:-1] > 0
                    removed.append(int(drop.sum()))
                    if removed[-1]:
                        text = b" ".join(data[starts[w] : ends[w]].tobytes() for w in np.flatnonzero(~drop)).decode("utf-8", "surrogatepass")
                    out.append(text)
                yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(out, pa.string()), pa.array(removed, pa.int64())], ["given", "text", "n_removed"])

        schema = f"given {rows.schema['given'].dataType.simpleString()}, text string, n_removed long"
        return rows.select("given", "text", "gone", "whole").mapInArrow(run, schema)


def _in(bits: bytes, df: DataFrame, column: str) -> Column:
    """Whether a 64-bit hash is in the bitmap; few others are, too."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def hit(hashes: pa.Array) -> pa.Array:
        return pa.array(unpacked(sent.value)[bit_of(hashes.to_numpy(zero_copy_only=False))])

    return hit(F.col(column))


def _smaller(least: str) -> Column:
    """Whether the doc_id ``least`` is smaller than the row's."""
    return F.col(least).isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col(least)))


def _same_row(right: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its key renamed, and the condition that a row has it; null doc_ids are equal."""
    keys = right.select(*(F.col(c).alias(f"_{c}") for c in ROW), *columns)
    return keys, (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))


def repeats(base: DataFrame, cover: Cover) -> DataFrame | None:
    """(doc_id, t, u, gone, whole) of rows with repeats: the hashes of the windows that start in a document with a smaller doc_id, or that all do; None if no anchor is shared."""
    shared = written(cover.anchors(base).groupBy("hash").agg(F.count("*").alias("k")).filter("k > 1"))
    n, total = shared.agg(F.count("*"), F.sum("k")).first()
    if not n:
        return None
    held = cover.anchors(base, bitmap(shared.select("hash")))
    marks = written(join_dealt(held, shared, ["hash"], total, ROW).groupBy(*ROW).agg(F.collect_set("hash").alias("anchors")))
    texts = written(marks.groupBy("t", "u").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).filter("k > 1"))
    alike = texts.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    if alike:
        marks = written(join_dealt(marks, texts, ["t", "u"], alike, ["doc_id"], "left").withColumn("whole", F.coalesce(_smaller("least"), F.lit(False))).drop("least"))
    else:
        marks = marks.withColumn("whole", F.lit(False))
    own = marks.filter("not whole")
    keys, same = _same_row(own, ["anchors"])
    near = base.filter(_in(bitmap(own.select("t")), base, "t")).select(*ROW, "text")
    flagged = written(near.join(keys, same).select(*ROW, "text", "anchors"))
    least_k = max(cover.hot, -(-2 * total // BROADCAST_ROWS))  # fewer than BROADCAST_ROWS anchors have more
    found = cover.windows(flagged, [r["hash"] for r in shared.filter(F.col("k") > least_k).select("hash").toLocalIterator()])
    window = Window.partitionBy("h", "c")
    cold = found.filter("not hot").select("h", *ROW, F.min("doc_id").over(window).alias("least")).filter(_smaller("least"))
    hot = found.filter("hot").drop("hot")
    firsts = written(hot.groupBy("h", "c").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).filter("k > 1"))
    many = firsts.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    gone = cold.select("h", *ROW)
    if many:
        gone = gone.unionByName(join_dealt(hot, firsts, ["h", "c"], many, ROW).filter(_smaller("least")).select("h", *ROW))
    gone = gone.groupBy(*ROW).agg(F.collect_set("h").alias("gone")).withColumn("whole", F.lit(False))
    return written(gone.unionByName(marks.filter("whole").select(*ROW, F.lit(None).cast("array<bigint>").alias("gone"), "whole")))


def deduplicate(docs: DataFrame, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """The rows of ``docs``, all columns, without the words that repeats cover; n_words and n_removed are added."""
    cover = Cover(words, hot)
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "text", F.xxhash64(text).alias("t"), F.crc32(text.cast("binary")).alias("u"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("given"))
    gone = repeats(base, cover)
    untouched = lambda df: df.select("given", "text", F.lit(0).cast("long").alias("n_removed"))
    rows = untouched(base)
    if gone is not None:
        maybe = base.withColumn("maybe", _in(bitmap(gone.select("t")), base, "t"))
        keys, same = _same_row(gone, ["gone", "whole"])
        met = maybe.filter("maybe").join(keys, same, "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
        rows = cover.without(met).unionByName(untouched(maybe.filter("not maybe")))
    plain = joined_words(F.coalesce("text", F.lit("")))
    left = F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)
    stay = [(F.col("text") if c == "text" else F.col("given")[c]).alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return rows.select(*stay, (left + F.col("n_removed")).cast("long").alias("n_words"), "n_removed")


def joined_words(text: Column) -> Column:
    """The words of a text, joined by one space."""
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
