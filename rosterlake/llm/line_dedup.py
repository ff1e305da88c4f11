"""Line dedup: one occurrence of each group of exact or fuzzy copies of a line stays.

A line is normalised (ASCII letters to lower case, digits to 0, other ASCII
characters to word breaks).  Equal normalised lines are one line.  Two lines are
linked if the edit similarity of their normalised texts is 0.8 or more and they
are candidates:

* Each line has a SimHash of 128 bits over its pairs of neighbouring characters
  (a break counts as one), so that edits that are scattered over a line change few
  of its features.  A bit isn't set by more than half of the pairs, but by more
  than the line's language and script make likely: the few directions in which
  lines of the corpus differ most are regressed out (``Hash.shaped``), else all
  long lines of one language would be near each other.
* Blocks of ``width`` bits are the keys of lists, in which lines meet (pigeonhole:
  few different bits leave one of the blocks alone).  The width grows with the
  logarithm of the number of lines, and the number of blocks with the width, so
  that a pair with a sixth of its bits different still shares one; lines under
  SHORT characters, where an edit changes more, have half as many again.
* In a list, lines whose lengths allow the similarity are near if at most FIRST of
  the first 64 bits and TOTAL of all differ (SHORT_TOTAL of a short line's).

A list is sorted by length and streamed: a task holds the rows of one window of
lengths, not a list.  A row is paired with the first near row before it, so a
family of copies gives a star; the pairs are verified, and only rows that still
lie in different components are then paired with each other, each pair once, in
the first list in which it meets.  Every candidate is decided by a lower bound
from pairs of characters, an upper bound from equal words, or the edit distance
of what lies between the common ends, that of many pairs at once along the
diagonals of a band (of long lines by Myers' bit vectors); nothing else refuses it.

The directions are those of all lines, by sums of whole numbers that are added up
in Spark; they shape the hash alone, and all lines are hashed, listed and compared.

Of each connected group, the first occurrence (smallest doc_id, then line
number) stays.  Defined cases: null text counts as empty; lines without letters
always stay, as numbers of one shape aren't copies; a document whose lines all
go keeps the empty text (the pipeline drops it); rows equal in both doc_id and
text are one document and get equal results; null doc_ids come last; other
columns stay, whatever their names, but n_lines and n_dropped, which are set.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import NOT_ALNUM, bit_of, bitmap, components, cut, groups_of, join_counted, join_dealt, mix, powers, unpacked, word_hashes, word_spans, written

SIMILARITY = 0.8
#: Bits of a SimHash, in two columns.
BITS = 128
#: Different bits of near lines: of the first 64, of all, and of all where the shorter line has fewer than SHORT characters.
FIRST, TOTAL, SHORT_TOTAL, SHORT = 16, 24, 31, 64
#: The share of equal bits for which the number of blocks is chosen, and what it is multiplied by.
EQUAL, SPARE = 0.835, 1.12
#: Classes of characters, classes of pairs in which lines' directions are sought, and directions at most.
CODES, CLASSES, DIRECTIONS = 64, 128, 8
#: Sums over lines that shape the hash, and the unit that they are kept in.
CELLS, UNIT = 1 + CLASSES + BITS + CLASSES * CLASSES + CLASSES * BITS, 1 << 16
#: The low half of a row's place in the lists: its length.
LENGTH = (1 << 32) - 1
#: Rows of sorted lists that are looked through at once, besides those of the window that is open.
RUN = 1 << 17
#: Rows of a list that are held against so many at once.
TILE, ACROSS = 128, 1024

#: Tables for bytes.translate: normalised bytes, and of those which lie between words and which are letters.
_FOLDED = bytes(48 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else c for c in range(256))
_GAP = bytes(NOT_ALNUM.astype(np.uint8))
_SPACED = bytes(32 if NOT_ALNUM[c] else c for c in range(256))
_LETTER = bytes(c >= 128 or chr(c).isalpha() for c in range(256))
#: Letters, 0, the break (0), and classes for what isn't ASCII.
_CODE = np.zeros(256, dtype=np.int32)
DIGIT = 27
_CODE[97:123], _CODE[48], _CODE[128:] = np.arange(1, 27), DIGIT, 28 + np.arange(128) % 36
_CODED = bytes(_CODE.astype(np.uint8))
_PAIRS = mix(np.arange(1, CODES * CODES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TABLES = [mix(_PAIRS ^ np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) for k in (1, 2)]
#: For each pair, whether it sets each bit (k of the first table, then of the second).
_SETS = np.unpackbits(np.stack(_TABLES, axis=1).astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.float32)
_CLASS = (mix(_PAIRS + np.uint64(5)) % np.uint64(CLASSES)).astype(np.int64)


def folded(texts: list[str | bytes | None]):
    """The normalised bytes of texts, joined by line ends; the texts' first bytes, the line ends, word starts and ends, and first words and word counts of the lines with letters."""
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw).translate(_FOLDED)
    data = np.frombuffer(joined, dtype=np.uint8)
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = np.frombuffer(joined.translate(_GAP), dtype=bool)
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turn[0::2], turn[1::2]
    breaks = np.flatnonzero(data == 10)
    bounds = np.searchsorted(starts, np.concatenate([[0], breaks]))  # words before each line
    counts = np.diff(np.concatenate([bounds, [len(starts)]]))
    first, counts = bounds[counts > 0], counts[counts > 0]
    if len(first):
        letters = np.add.reduceat(np.frombuffer(joined.translate(_LETTER), dtype=np.uint8), starts[first], dtype=np.int32)
        first, counts = first[letters > 0], counts[letters > 0]
    begin = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    return begin, breaks, (data, starts, ends, first, counts)


def read_lines(texts: list[str | bytes | None]):
    """Of the lines with letters: document, line number, hash of the normalised line; and the data, word starts, ends, word hashes, first words and word counts."""
    begin, breaks, (data, starts, ends, first, counts) = folded(texts)
    words = word_hashes(data, starts, ends)
    head = np.searchsorted(breaks, begin)  # lines before each document
    owner = np.searchsorted(begin, starts[first], "right") - 1
    number = np.searchsorted(breaks, starts[first]) - head[owner]
    with np.errstate(over="ignore"):
        up, down = powers(len(words) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)])])
        hashes = mix((sums[first + counts] - sums[first]) * down[first] + counts.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    return owner, number, hashes, (data, starts, ends, words, first, counts)


def character_pairs(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, pair): the neighbouring characters of each line that begins with word ``first``, in order; a run of signs is one break.

    Neighbouring digits are all 0 and give no pair, and of a longer run of one
    character only the first two do: else a number of sixteen digits outvotes the
    words around it, and all lines with such numbers are near each other.
    """
    codes = np.zeros(len(data) + 2, dtype=np.uint16)
    codes[1:-1] = np.frombuffer(data.tobytes().translate(_CODED), dtype=np.uint8)
    pairs = codes[:-1] * np.uint16(CODES) + codes[1:]
    pairs[pairs == DIGIT * (CODES + 1)] = 0
    same = codes[1:] == codes[:-1]
    thrice = np.flatnonzero(same[1:] & same[:-1]) + 1
    pairs[thrice] = 0
    # A pair belongs to the line of its first character, and the line end before a line to that line.
    edges = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(pairs)]])
    place = np.full(len(edges) - 1, -1, dtype=np.int32)
    place[np.searchsorted(edges, starts[first], "right") - 1] = np.arange(len(first))
    line = np.repeat(place, np.diff(edges))
    keep = np.flatnonzero((pairs > 0) & (line >= 0))
    return line[keep], pairs[keep]


def tallied(line: np.ndarray, pair: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that there are, and how often each line has each of them."""
    kinds = np.flatnonzero(np.bincount(pair, minlength=1))
    if not len(kinds):
        return kinds, np.zeros((lines, 0), np.float32)
    at = np.zeros(kinds[-1] + 1, dtype=np.int64)
    at[kinds] = np.arange(len(kinds))
    tally = np.bincount(at.take(pair) + line * np.int64(len(kinds)), minlength=lines * len(kinds))
    return kinds, tally.reshape(lines, len(kinds)).astype(np.float32)


def counted(line: np.ndarray, pair: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line: how many pairs set each bit, and how many lie in each class."""
    kinds, tally = tallied(line, pair, lines)
    told = tally @ np.hstack([_SETS[kinds], np.eye(CLASSES, dtype=np.float32)[_CLASS[kinds]]])
    return told[:, :BITS], told[:, BITS:]


def moments(texts: list[str | bytes | None]) -> np.ndarray:
    """Sums over all lines: how many; pairs by class and by bit; and by two classes, and by class and bit, the products over the line's number of pairs; in UNITs."""
    _, _, (data, starts, _, first, _) = folded(texts)
    if not len(first):
        return np.zeros(CELLS, np.int64)
    ones, classes = (x.astype(np.float64) for x in counted(*character_pairs(data, starts, first), len(first)))
    scaled = classes / np.maximum(classes.sum(axis=1), 1)[:, None]
    sums = np.concatenate([classes.sum(axis=0), ones.sum(axis=0), (scaled.T @ classes).ravel(), (scaled.T @ ones).ravel()])
    return np.concatenate([[len(first)], np.rint(sums * UNIT).astype(np.int64)])


class Hash:
    """SimHashes of lines: bit k is set where more pairs set it than ``likely[:, k]`` makes of the pairs in each class."""

    def __init__(self, likely: np.ndarray | None = None):
        self.likely = np.full((CLASSES, BITS), 0.5, dtype=np.float32) if likely is None else likely.astype(np.float32)

    @classmethod
    def fitted(cls, texts: list[str]) -> Hash:
        """The hash that the lines of these texts shape."""
        return cls.shaped(sum((moments(part) for _, part in groups_of(texts)), np.zeros(CELLS, np.int64)))

    @classmethod
    def shaped(cls, sums: np.ndarray) -> Hash:
        """Regresses out the directions in which lines differ most, by their ``moments``: those of more than 4 times the variance that chance gives."""
        n = int(sums[0])
        # Few lines can't tell directions from chance, nor what is common from one family of copies; there few are near each other anyway.
        if n < 8 * CLASSES:
            return cls()
        parts = np.split(sums[1:] / UNIT, np.cumsum([CLASSES, BITS, CLASSES * CLASSES]))
        classes, ones, within, across = *parts[:2], parts[2].reshape(CLASSES, CLASSES), parts[3].reshape(CLASSES, BITS)
        size = classes.sum()
        share, bit = classes / size, ones / size
        # Of lines less what their length makes likely, each divided by the root of its length.
        within = (within - size * np.outer(share, share)) / n
        across = (across - size * np.outer(share, bit)) / n
        values, vectors = np.linalg.eigh(within)
        noise = np.median(values) * (1 + math.sqrt(CLASSES / n)) ** 2  # what chance gives
        strong = np.flatnonzero(values > 4 * noise)[-DIRECTIONS:]
        v = vectors[:, strong]
        slope = v.T @ across / values[strong][:, None]
        return cls(np.ones((CLASSES, 1)) * bit + (np.eye(CLASSES) - np.outer(np.ones(CLASSES), share)) @ v @ slope)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each line's SimHash in two parts and its length in code points."""
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        kinds, tally = tallied(*character_pairs(data, starts, first), len(first))
        bits = np.packbits(tally @ (_SETS[kinds] - self.likely[_CLASS[kinds]]) > 0, axis=1, bitorder="little")
        own = ends - starts
        if len(more := np.flatnonzero((data & 0xC0) == 0x80)):  # bytes that begin no character
            own = own - np.searchsorted(more, ends) + np.searchsorted(more, starts)
        sums = np.concatenate([[0], np.cumsum(own)])
        length = sums[first + counts] - sums[first] + counts - 1
        a, b = (np.ascontiguousarray(bits[:, low : low + 8]).view("<i8")[:, 0] for low in (0, 8))
        return a, b, length.astype(np.int32)


def summed(base: DataFrame) -> np.ndarray:
    """The ``moments`` of all lines of all documents: whole numbers, so that their order doesn't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, texts in groups_of(batch.column("text").cast(pa.binary()).to_pylist()):
                sums += moments(texts)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["cell", "value"])

    out = np.zeros(CELLS, np.int64)
    # One row for each of CELLS sums.
    for r in base.select("text").mapInArrow(run, "cell int, value long").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def lines(docs: DataFrame, how: Hash) -> DataFrame:
    """(row, doc_id, number, line, a, b, n): every line with letters, its hash, SimHash and length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in groups_of(batch.column("text").cast(pa.binary()).to_pylist()):
                owner, number, hashes, rest = read_lines(texts)
                at = pa.array(owner + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(number.astype(np.int32)), pa.array(hashes.view(np.int64)), *map(pa.array, sent.value.of(*rest))],
                    ["row", "doc_id", "number", "line", "a", "b", "n"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, number int, line long, a long, b long, n int")


def normalised(docs: DataFrame, every: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text): the normalised text of the wanted lines, from one document of each. Bitmaps let through few others, which the join drops."""
    of = every.select("line", "row").join(wanted, "line", "left_semi").groupBy("line").agg(F.min("row").alias("row"))
    context = docs.sparkSession.sparkContext
    lines_, rows_ = context.broadcast(bitmap(wanted.select("line"))), context.broadcast(bitmap(of.select("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, rows = unpacked(lines_.value), unpacked(rows_.value)
        done: set[int] = set()
        for batch in batches:
            some = pa.array(np.flatnonzero(rows[bit_of(batch.column("row").to_numpy())]))
            for _, texts in groups_of(batch.column("text").take(some).cast(pa.binary()).to_pylist()):
                _, _, hashes, (data, starts, ends, _, first, counts) = read_lines(texts)
                ids, found = [], []
                for i in np.flatnonzero(bits[bit_of(hashes)]).tolist():
                    h = int(hashes[i].view(np.int64))
                    if h not in done:
                        done.add(h)
                        ids.append(h)
                        found.append(b" ".join(data[starts[first[i]] : ends[first[i] + counts[i] - 1]].tobytes().translate(_SPACED).split()).decode("utf-8", "replace"))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["line", "text"])

    found = docs.select("row", "text").mapInArrow(run, "line long, text string")
    return found.join(wanted, "line").groupBy("line").agg(F.first("text").alias("text"))


def edit_distance(a: str, b: str, far: int | None = None) -> int:
    """Levenshtein distance in code points, by Myers' bit vectors over what common ends leave; any number above ``far`` if it is above."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    for _ in range(2):  # the common start, then the common end
        n = min(len(x), len(y))
        differ = x[:n] != y[:n]
        at = int(differ.argmax()) if differ.any() else n
        x, y = x[at:][::-1], y[at:][::-1]
    short, long = sorted((x.tolist(), y.tolist()), key=len)
    if not short:
        return len(long)
    where: dict[int, int] = {}
    for i, c in enumerate(short):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(short)) - 1, 1 << (len(short) - 1)
    up, down, distance = full, 0, len(short)
    most = len(long) + (len(a) + len(b) if far is None else far)
    for at, c in enumerate(long):
        if distance + at > most:  # what is left can't bring it down to far
            break
        same = where.get(c, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(level | up)), up & level
        distance += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | (full & ~(vertical | more))) & full, more & vertical
    return distance


#: Words to skip on either side where texts differ, the fewest and most even first.
SKIPS = tuple((k, total - k) for total in range(1, 7) for k in sorted(range(total + 1), key=lambda k: abs(2 * k - total)))


def distance_bound(a: str, b: str, far: int) -> int:
    """An upper bound of the edit distance of texts of words: where words differ, both sides skip to the next equal ones in SKIPS. Stops beyond ``far``."""
    x, y = a.split(" "), b.split(" ")
    n, m = len(x), len(y)
    i = j = cost = 0
    while i < n and j < m and cost <= far:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for k, h in SKIPS:
            if i + k < n and j + h < m and x[i + k] == y[j + h]:
                break
        else:
            k = h = 1
        cost += max(sum(map(len, x[i : i + k])) + k, sum(map(len, y[j : j + h])) + h)
        i, j = i + k, j + h
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)


def distance_floor(a: str, b: str) -> int:
    """A lower bound of the edit distance: an edit takes away at most two pairs of neighbouring characters and adds two."""
    x, y = (Counter(map(str.__add__, t, t[1:])) for t in (a, b))
    common = (x & y).total()
    return -(-(x.total() + y.total() - 2 * common) // 4)


def similar_texts(a: str, b: str) -> bool:
    far = int(max(len(a), len(b)) * (1 - SIMILARITY) + 1e-9)
    return distance_bound(a, b, far) <= far or distance_floor(a, b) <= far and edit_distance(a, b, far) <= far


#: Texts up to this length are compared many pairs at a time, and so many cells of a band at most are filled at once.
LONG, CELLS_AT_ONCE = 4_000, 1 << 16


def similar_pairs(x: list[str], y: list[str]) -> np.ndarray:
    """``similar_texts`` of each pair, for many pairs: the lower bound and the edit distance are those of all of them at once."""
    out = np.zeros(len(x), bool)
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], dtype=np.int64).reshape(-1, 2)
    longest = sizes.max(axis=1, initial=0)
    for i in np.flatnonzero(longest > LONG).tolist():
        out[i] = similar_texts(x[i], y[i])
    far = (longest * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    some = np.flatnonzero((longest <= LONG) & (abs(sizes[:, 0] - sizes[:, 1]) <= far))
    some = some[np.argsort(longest[some], kind="stable")]
    rest = []
    for part in shares(some, 256):
        n, m = sizes[part].T
        near = part[floors(*joined(x, y, part), n, m) <= far[part]]
        close = np.array([distance_bound(x[i], y[i], f) <= f for i, f in zip(near.tolist(), far[near].tolist(), strict=True)], dtype=bool)
        out[near[close]] = True
        rest.append(near[~close])
    for part in shares(np.concatenate([*rest, some[:0]]), 1024):
        points, begin = joined(x, y, part)
        out[part] = within(points, begin[::2], begin[1::2], *sizes[part].T, far[part])
    return out


def shares(rows: np.ndarray, most: int) -> list[np.ndarray]:
    return [rows[k : k + most] for k in range(0, len(rows), most)]


def joined(x: list[str], y: list[str], part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts x, y, x, y ... of the pairs in ``part``, and where each begins."""
    texts = [t for i in part.tolist() for t in (x[i], y[i])]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return points, np.cumsum([0, *map(len, texts[:-1])])


def floors(points: np.ndarray, begin: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A lower bound of each pair's edit distance, as ``distance_floor``; ``points`` are the texts x, y, x, y ... from ``begin`` on. Pairs of characters share 1,024 cells, which only lowers it."""
    owner = np.repeat(np.arange(len(begin)), np.stack([n, m], axis=1).ravel())
    if len(points) < 2:
        return np.zeros(len(n), np.int64)
    mixed = points.astype(np.uint32) * np.uint32(0x9E3779B1)
    cell = ((mixed[:-1] ^ (mixed[1:] >> np.uint32(7)) * np.uint32(0x85EBCA6B)) >> np.uint32(22)).astype(np.int64)
    inside = owner[:-1] == owner[1:]
    tally = np.bincount((owner[:-1] * 1024 + cell)[inside], minlength=len(begin) * 1024).reshape(len(n), 2, 1024)
    return -(-abs(tally[:, 0] - tally[:, 1]).sum(axis=1) // 4)


def within(points: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which pairs of texts (n points from x, m from y) have an edit distance of ``far`` or less: what common ends leave, all pairs together along the diagonals of a band."""
    for back in (False, True):
        # The common start, then the common end.
        k = np.arange(int(np.minimum(n, m).max(initial=0)))[None, :]
        at = [np.minimum((p + c - 1)[:, None] - k if back else p[:, None] + k, len(points) - 1) for p, c in ((x, n), (y, m))]
        differ = (points[at[0]] != points[at[1]]) | (k >= np.minimum(n, m)[:, None])
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), np.minimum(n, m)) if k.size else np.zeros(len(n), np.int64)
        n, m = n - common, m - common
        if not back:
            x, y = x + common, y + common
    out = np.maximum(n, m) <= far
    # Where one text is over, or the longer one alone is near enough, that decides.
    left = np.flatnonzero(~out & (np.minimum(n, m) > 0))
    left = left[np.argsort((n + m)[left], kind="stable")]
    start = 0
    while start < len(left):
        stop = start + 1
        while stop < len(left) and (stop - start) * (int(far[left[start : stop + 1]].max()) + 2) <= CELLS_AT_ONCE:
            stop += 1
        part = left[start:stop]
        out[part] = banded(points, x[part], y[part], n[part], m[part], far[part]) <= far[part]
        start = stop
    return out


def banded(points: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Edit distances up to each pair's limit, of all pairs at once; any number above it where they are above.

    Cell (i, j) of the table lies on diagonal d = i + j; on each, only cells through which a way within the limit can lead count.
    A diagonal's cells are rows, so that one step is a few operations over whole arrays.
    Pairs that have no cell within their limit on two diagonals are left off.
    """
    none, pairs = np.int16(LONG * 2 + 1), np.arange(len(n))
    # What is left of a way through (i, j) costs |n - m - (i - j)| at least.
    least, greatest = int(((n - m - limits) // 2).min()), int(((n - m + limits + 1) // 2).max())
    rows, columns = int(n.max()), int(m.max())
    # Signs that equal nothing stand beyond the ends.
    a = np.where(np.arange(rows)[:, None] < n, points[np.minimum(x + np.arange(rows)[:, None], len(points) - 1)], -1)
    b = np.where(np.arange(columns)[:, None] < m, points[np.minimum(y + np.arange(columns)[:, None], len(points) - 1)], -2)[::-1]
    ends, out = n + m, np.full(len(n), none, dtype=np.int16)
    # Of the two diagonals before: cells by i + 1, so that i - 1 is there.
    before, last = (np.full((rows + 2, len(n)), none, dtype=np.int16) for _ in range(2))
    last[1] = 0
    out[ends == 0] = 0
    spare = np.full_like(last, none)
    for d in range(1, int(ends.max()) + 1):
        low, high = max(0, d - columns, (d + least + 1) // 2), min(rows, d, (d + greatest) // 2)
        now = spare
        inner, outer = max(low, 1), min(high, d - 1)  # cells with a row and a column before them
        step = np.minimum(last[low : high + 1], last[low + 1 : high + 2]) + np.int16(1)
        now[low + 1 : high + 2] = step
        if inner <= outer:
            # b is turned round: column j - 1 = d - i - 1 is its row columns - d + i.
            cost = before[inner : outer + 1] + (a[inner - 1 : outer] != b[columns - d + inner : columns - d + outer + 1])
            np.minimum(now[inner + 1 : outer + 2], cost, out=now[inner + 1 : outer + 2])
        now[low], now[min(high + 2, rows + 1)] = none, none if high < rows else now[rows + 1]
        over = np.flatnonzero(ends == d)
        if len(over):
            at = n[over]
            held = (at >= low) & (at <= high)
            out[pairs[over[held]]] = now[at[held] + 1, over[held]]
        spare, before, last = before, last, now
        if d % 32 == 0:
            cells = slice(max(low - 1, 0), high + 3)
            live = np.flatnonzero((np.minimum(before[cells].min(axis=0), last[cells].min(axis=0)) <= limits) & (ends > d))
            if len(live) < 0.8 * len(pairs):
                if not len(live):
                    break
                a, b, spare, before, last = (np.ascontiguousarray(t[:, live]) for t in (a, b, spare, before, last))
                n, ends, limits, pairs = n[live], ends[live], limits[live], pairs[live]
    return out


def blocks(lines: int) -> tuple[int, int]:
    """Bits of a block and number of blocks for so many lines: lists of some thousand rows, and as many as leave a pair with EQUAL bits one in common."""
    width = min(16, max(8, round(math.log2(max(lines, 1))) - 12))
    return width, math.ceil(SPARE * math.log(0.1) / math.log(1 - EQUAL**width))


def _starts(width: int, number: int) -> list[int]:
    """The first bit of each block: those of all lines, then those of short ones, between the others."""
    step = (BITS - width) / (number - 1)
    return [round(k * step) for k in range(number)] + [min(BITS - width, round((2 * k + 0.5) * step)) for k in range(number // 2)]


def _keys(width: int, number: int) -> Column:
    """The keys of a SimHash (a, b): block number and bits. A short line has half as many blocks more."""
    words = [F.col("a"), F.col("b")]

    def bits(at: int) -> Column:
        word, low = divmod(at, 64)
        out = F.shiftrightunsigned(words[word], low)
        if low + width > 64:
            out = out.bitwiseOR(F.shiftleft(words[word + 1], 64 - low))
        return out.bitwiseAND(F.lit((1 << width) - 1))

    keys = [(F.lit(k << 16) + bits(at)).cast("int") for k, at in enumerate(_starts(width, number))]
    return F.when(F.col("n") < SHORT, F.array(*keys)).otherwise(F.array(*keys[:number]))


class Lists:
    """Rows of lists, sorted by ``place`` (key, then length in the low half), in which near rows are sought a window at a time."""

    names = ("place", "a", "b", "line")

    def __init__(self, more: tuple[str, ...] = ()):
        self.columns = (*self.names, *more)
        self.limits = FIRST, TOTAL, SHORT_TOTAL, SHORT

    def stream(self, batches: Iterator[pa.RecordBatch], look) -> Iterator[pa.RecordBatch]:
        """Calls ``look(rows, state)`` on RUN rows and the window open before them; it returns the state of all and a batch; ``state`` is of the rows carried over."""
        held, state, parts, rows = None, None, [], 0

        def done():
            nonlocal held, state, parts, rows
            table = {c: np.concatenate([x[c] for x in ([held] if held else []) + parts]) for c in self.columns}
            last = int(table["place"][-1])
            closed = int(np.searchsorted(table["place"], last - int((last & LENGTH) * (1 - SIMILARITY) + 1e-9)))
            state, out = look(table, state, len(held["place"]) if held else 0, closed)
            state = {k: v[closed:] for k, v in state.items()}
            held, parts, rows = {c: v[closed:] for c, v in table.items()}, [], 0
            return out

        for batch in batches:
            if batch.num_rows:
                parts.append({c: batch.column(c).to_numpy() for c in self.columns})
                rows += batch.num_rows
                if rows >= RUN:
                    yield from done()
        if rows:
            yield from done()
        if held:
            _, out = look(held, state, len(held["place"]), len(held["place"]))
            yield from out

    def near(self, rows: dict[str, np.ndarray], old: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (i before j) of near rows, j not among the first ``old``, in the order of i: TILE rows against all that their windows reach."""
        place = rows["place"]
        size, n = len(place), place & LENGTH
        reach = np.searchsorted(place, place - n + np.floor(n / SIMILARITY + 1e-9).astype(np.int64), "right")
        a, b = rows["a"].view(np.uint64), rows["b"].view(np.uint64)
        first, total, short_total, short = self.limits
        most = np.where(n < short, short_total, total)
        # Used again and again; few cells are near, so they are first looked through eight at a time.
        differ, ones, few = (np.empty(TILE * ACROSS + 8, kind) for kind in (np.uint64, np.uint8, bool))
        low = 0
        while low < size:
            high = min(low + TILE, size)
            begin = max(low + 1, old)
            for start in range(begin, int(reach[high - 1]), ACROSS):
                stop = min(start + ACROSS, int(reach[high - 1]))
                cells = (high - low) * (stop - start)
                np.bitwise_xor(a[low:high, None], a[None, start:stop], out=differ[:cells].reshape(high - low, -1))
                np.less_equal(np.bitwise_count(differ[:cells], out=ones[:cells]), first, out=few[:cells])
                few[cells : cells + 8] = False
                eights = few[: cells + 7 & ~7].reshape(-1, 8)
                some = np.flatnonzero(eights.view(np.uint64))
                eight, at = np.nonzero(eights[some])
                i, j = np.divmod(some[eight] * 8 + at, stop - start)
                i, j = i + low, j + start
                keep = (i < j) & (j < reach[i])
                i, j = i[keep], j[keep]
                keep = np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j]) <= most[i]
                if keep.any():
                    yield i[keep], j[keep]
            low = high


def near_rows(distinct: DataFrame, width: int, number: int) -> DataFrame:
    """(place, a, b, line, other): the rows of the lists that have a near one; other: the first near row before it, null if none."""
    window = Lists()

    def look(rows, state, old, closed):
        size = len(rows["place"])
        near, other = np.zeros(size, bool), np.full(size, -1)
        has, first = np.zeros(size, bool), np.zeros(size, np.int64)
        if state:
            near[:old], has[:old], first[:old] = state["near"], state["has"], state["first"]
        for i, j in window.near(rows, old):
            near[i] = near[j] = True
            fresh = other[j] < 0
            other[j[fresh][::-1]] = i[fresh][::-1]  # in the order of i, so the first row stays
        found = other >= 0
        first[found], has[found] = rows["line"][other[found]], True
        keep = np.flatnonzero(near[:closed])
        batch = pa.RecordBatch.from_arrays([*(pa.array(rows[c][keep]) for c in window.columns), pa.array(first[keep], mask=~has[keep])], [*window.columns, "other"])
        return {"near": near, "has": has, "first": first}, [batch]

    rows = distinct.select(F.explode(_keys(width, number)).alias("key"), "n", "a", "b", "line")
    rows = rows.select(F.shiftleft(F.col("key").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("place"), "a", "b", "line")
    return rows.repartition(_list()).sortWithinPartitions("place").mapInArrow(lambda b: window.stream(b, look), "place long, a long, b long, line long, other long")


def _list() -> Column:
    return F.shiftright("place", 32)


def met_before(x: np.ndarray, y: np.ndarray, block: np.ndarray, starts: list[int], width: int) -> np.ndarray:
    """Which pairs share a block before ``block``, by the bits (x, y) in which they differ."""
    out, mask = np.zeros(len(x), bool), np.uint64((1 << width) - 1)
    for k, start in enumerate(starts):
        word, low = divmod(start, 64)
        bits = (x, y)[word] >> np.uint64(low)
        if low + width > 64:
            bits = bits | y << np.uint64(64 - low)
        out |= (bits & mask == 0) & (k < block)
    return out


def open_pairs(listed: DataFrame, width: int, number: int) -> DataFrame:
    """(a, b): near rows of one list in different components (place, a, b, line, other, component), each from the first list in which they meet.

    A row and the one that ``near_rows`` named as its other have been judged already.
    """
    window, starts = Lists(("other", "component")), _starts(width, number)

    def look(rows, state, old, closed):
        out = []
        for i, j in window.near(rows, old):
            apart = (rows["component"][i] != rows["component"][j]) & (rows["line"][i] != rows["other"][j])
            i, j = i[apart], j[apart]
            differ = [(rows[c][i] ^ rows[c][j]).view(np.uint64) for c in ("a", "b")]
            once = ~met_before(*differ, rows["place"][i] >> 48, starts, width)
            x, y = rows["line"][i[once]], rows["line"][j[once]]
            out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"]))
        return {}, out

    return listed.repartition(_list()).sortWithinPartitions("place").mapInArrow(lambda b: window.stream(b, look), "a long, b long")


def line_groups(docs: DataFrame, every: DataFrame) -> DataFrame | None:
    """(line, component) of the distinct lines of ``every`` that verified links join to others; None if there are none."""
    distinct = every.groupBy("line").agg(*(F.first(c).alias(c) for c in ("a", "b", "n")))
    shape = blocks(every.count())
    listed = written(near_rows(distinct, *shape))
    if listed.isEmpty():
        return None
    texts = cut(normalised(docs, every, cut(listed.select("line").distinct())))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = similar_pairs(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(close))

    def verified(pairs: DataFrame) -> DataFrame:
        two = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("y")), "b")
        return cut(two.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"))

    first = cut(listed.filter("other is not null").select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b")).distinct())
    tree = components(verified(first)).withColumnRenamed("id", "line")
    by_key = Window.partitionBy(_list())
    named = listed.withColumn("other", F.coalesce("other", "line")).join(tree, "line", "left").withColumn("component", F.coalesce("component", "line"))
    named = named.withColumn("lo", F.min("component").over(by_key)).withColumn("hi", F.max("component").over(by_key)).filter("lo <> hi").drop("lo", "hi")
    more = verified(open_pairs(named, *shape).join(first, ["a", "b"], "left_anti"))
    return tree if more.isEmpty() else merged(cut(tree), more)


def merged(tree: DataFrame, more: DataFrame) -> DataFrame:
    """``tree`` (line, component) with the links ``more`` (a, b): only components that they join are named anew."""
    for c in ("a", "b"):
        named = tree.select(F.col("line").alias(c), F.col("component").alias("at"))
        more = more.join(named, c, "left").withColumn(c, F.coalesce("at", c)).drop("at")
    step = cut(components(more))
    moved = join_counted(tree, step.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left", F.col("line"))
    alone = step.withColumnRenamed("id", "line").join(tree, "line", "left_anti")
    return moved.select("line", F.coalesce("to", "component").alias("component")).unionByName(alone)


def total(counted: DataFrame) -> int:
    """The sum of the counts ``k``."""
    return counted.agg(F.sum("k")).first()[0] or 0


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the text that is left; n_lines and n_dropped are added."""
    # A row's key; rows equal in doc_id and text share it. The columns go along in a struct, so that no name clashes.
    base = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), "doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))
    every = written(lines(base, Hash.shaped(summed(base))))
    tree = line_groups(base, every)
    groups = every.groupBy("line").agg(F.count("*").alias("k")).filter("k > 1")
    if tree is None:
        groups = groups.withColumn("component", F.col("line"))
    else:
        groups = groups.join(cut(tree), "line", "full").select("line", F.coalesce("k", F.lit(1)).alias("k"), F.coalesce("component", "line").alias("component"))
    groups = cut(groups)
    # One row for each line on the right, so its share of a task is small; the many rows on the left needn't be sorted.
    told = written(join_dealt(every.select("row", "doc_id", "number", "line"), groups.hint("shuffle_hash"), ["line"], total(groups), ["row"]).drop("line"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "number")
    kept = cut(told.groupBy("component").agg(F.min(place).alias("kept"), F.count("*").alias("k")))
    told = join_dealt(told.select("row", "number", "component"), kept.hint("shuffle_hash"), ["component"], total(kept), ["row"])
    gone = told.filter((F.col("row") != F.col("kept.row")) | (F.col("number") != F.col("kept.number"))).groupBy("row").agg(F.collect_set("number").alias("drops"))
    out = join_counted(base.select("row", "given"), cut(gone).hint("shuffle_hash"), "row", "left", F.col("row"), salts=1)
    text = F.col("given.text")
    pieces = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("drops"))
    both = F.array(F.struct(pieces.alias("pieces"), numbers.alias("numbers")))  # bound once for all lines
    rest = F.array_join(F.transform(both, lambda s: F.transform(s["numbers"], lambda i: s["pieces"][i]))[0], "\n")
    left = F.when(F.col("drops").isNull(), text).otherwise(rest)
    stay = [(left if c == "text" else F.col("given")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = F.coalesce(text, F.lit(""))
    ends = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))  # dearer pieces are made only where lines go
    return out.select(*stay, (ends + 1).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
