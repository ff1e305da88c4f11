"""N-gram Jaccard join by set-relation skipping: exact links of at least 80 % between shingle sets.

Equal sets are one set.  Shingles are put into one global order, rare ones
first (by a count sketch of fixed size), and a set is indexed by its prefix, a
twentieth of the set longer than it must be: two sets that link share at least
as many prefix shingles as the smaller one has extra ones, and one more.  A set
with fewer shared entries has no link and goes before any set is fetched.  Then
two kinds of work are skipped:

* Index level.  An index list is cut into blocks by set size; a set probes only
  the blocks whose sizes can reach the threshold, skips entries at positions
  from which they can't, and keeps a pair only if the shared part of its
  prefixes, with all that is behind them, can still reach it.
* Answer level.  Sets that meet in lists get a common pivot (the least rank of
  their lists).  A pivot's sets are compared block by block.  In a block one
  set's answers (its shared shingles with every other) are counted, and the
  answers of sets like it are derived from them by what differs.  The first
  block's answers also answer for every set that joins their component; only
  sets outside the group's largest component are compared with the rest.  Pairs
  in lists across pivots are verified one by one, unless they are connected.

Links are kept as trees: sets of one component need not all be paired.

Defined cases: null or empty text, or one without words, is the empty set and
links with nothing; a text of fewer than five words is one shingle; equal rows
are members of one set; a null doc_id is no candidate for component_id; other
columns are dropped.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import bit_of, bitmap, components, cut, groups_of, join_counted, lowered, mix, shingle_hashes, stream_groups, unpacked, word_hashes, word_spans

#: Numerator and denominator of the similarity, in hundreds: intersection * 100 >= 80 * union.
NEED = 80
#: Counters of the sketch that orders shingles: 32 MB for a task; its levels, 4 MB, go to the driver and are broadcast.
SKETCH = 1 << 22
SKETCH_PARTS = 16
#: Steps of the order for each doubling of a count; a counter's level is a byte.
LEVELS = 6
#: Sets and shingles of a block in the comparison of a pivot's sets.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
#: A prefix is longer by one shingle for every EXTRA shingles of the set.
EXTRA = 20
#: Size blocks of an index list: sizes of one block differ by 5 % at most.
STEP = 1.05


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    data = lowered(text)
    return shingle_hashes(word_hashes(data, *word_spans(data)), width)


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        both = mix(hashes).sum() + mix(np.uint64(len(hashes)) ^ np.bitwise_xor.reduce(hashes))
    return int(np.array(both, dtype=np.uint64).view(np.int64))


def prefix_length(n: int, need: int = NEED) -> int:
    return min(n, n - -(-need * n // 100) + 1 + n // EXTRA)


def entries_needed(n: Column, need: int) -> Column:
    """Prefix shingles that a set of size n shares with each set it links with: the smallest of those has n * need / 100."""
    return 1 + F.floor(F.ceil(n * need / 100) / EXTRA)


def overlap_needed(a, b, need: int = NEED):
    """Shared shingles that sets of sizes a and b need to link."""
    return -(-need * (a + b) // (100 + need))


def linked(shared, a, b, need: int = NEED):
    return 100 * shared >= need * (a + b - shared)


def members_and_sketch(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, set) for every row, and how often each counter's shingles occur."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = SKETCH // SKETCH_PARTS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch, start, texts in ((b, at, t) for b in batches for at, t in groups_of(b.column("text").to_pylist(), 1 << 23)):
            batch = batch.slice(start, len(texts))
            sets = [shingles(t, width) for t in texts]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((flat % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc_id", "n", "set", "part", "counts"],
            )
        if counts.any():
            parts = counts.reshape(SKETCH_PARTS, size)
            no_id, none = pa.nulls(SKETCH_PARTS, batch.schema.field("doc_id").type), pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [no_id, none, none, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())],
                ["doc_id", "n", "set", "part", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                now = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
                sums[part] = sums[part] + now if part in sums else now
        levels = [np.minimum(LEVELS * np.log2(1.0 + s), 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    both = cut(docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n long, set long, part int, counts binary"))
    levels = np.zeros((SKETCH_PARTS, size), dtype=np.uint8)
    for row in both.filter("part is not null").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInArrow(add, "part int, levels binary").toLocalIterator():
        levels[row["part"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return both.filter("part is null").select("doc_id", "n", "set"), levels.ravel()


def postings(docs: DataFrame, levels: np.ndarray, width: int, need: int) -> DataFrame:
    """(shingle, set, n, at): each set's prefix in the global order; a task emits a set once."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for batch in batches:
            keys, sets, sizes, places = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                if not len(own) or (sid := set_id(own)) in seen:
                    continue
                seen.add(sid)
                key = (rank[(own % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))
                p = prefix_length(len(own), need)
                first = np.sort(np.partition(key, p - 1)[:p] if p < len(key) else key)
                keys.append(first)
                sets.append(np.full(p, sid, np.int64))
                sizes.append(np.full(p, len(own), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], sets, sizes, places)], ["shingle", "set", "n", "at"])

    return docs.select("text").mapInArrow(read, "shingle long, set long, n int, at int")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of each two sets: the first set's answers are counted, and those of sets like it derived from them.

    The lists hold the sets of each shingle.  The first set's row is the sum of
    its shingles' lists.  Where a set differs from it in fewer shingles than it
    has, its row is that row, plus the lists of the shingles that only it has,
    less the lists of those that only the first has; any other set's row is
    summed from its own lists.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    lists, begin = row[np.argsort(where, kind="stable")], np.cumsum(counts) - counts
    head = where[: sizes[0]]
    in_head = np.zeros(len(values), dtype=bool)
    in_head[head] = True
    base = np.bincount(row[in_head[where]], minlength=m)
    like = sizes[0] < 2 * base
    own = ~(like[row] & in_head[where])
    x, v, sign = [row[own]], [where[own]], [np.ones(int(own.sum()), np.float32)]
    place = np.cumsum(in_head) - 1
    derived = np.flatnonzero(like)
    slab = max(1, (1 << 24) // max(1, len(head)))
    for low in range(0, len(derived), slab):  # bounded memory
        part = derived[low : low + slab]
        at = np.full(m, -1)
        at[part] = np.arange(len(part))
        has = np.zeros((len(part), len(head)), dtype=bool)
        hit = (at[row] >= 0) & in_head[where]
        has[at[row[hit]], place[where[hit]]] = True
        i, j = np.nonzero(~has)
        x.append(part[i])
        v.append(np.flatnonzero(in_head)[j])
        sign.append(np.full(len(i), -1, np.float32))
    x, v, sign = np.concatenate(x), np.concatenate(v), np.concatenate(sign)
    shared = np.where(like[:, None], base[None, :], 0).astype(np.float64).ravel()
    done = np.cumsum(counts[v])
    low = 0
    while low < len(v):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + (1 << 21), "right")))
        long = counts[v[low:high]]
        inside = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        other = lists[np.repeat(begin[v[low:high]], long) + inside]
        shared += np.bincount(np.repeat(x[low:high], long) * m + other, np.repeat(sign[low:high], long), m * m)
        low = high
    return np.rint(shared).astype(np.int64).reshape(m, m)


def block_links(ids: list[int], sets: list[np.ndarray], need: int = NEED) -> list[tuple[int, int]]:
    """Links among a block's sets, as stars: (set, first set of its component in the block)."""
    once = dict(zip(ids, sets, strict=True))
    ids = sorted(once)
    sets = [once[i] for i in ids]
    m, sizes = len(ids), np.array([len(once[i]) for i in ids], dtype=np.int64)
    near = linked(shared_counts(sets), sizes[:, None], sizes[None, :], need)
    np.fill_diagonal(near, False)
    left, out = np.ones(m, bool), []
    for i in range(m):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front:
            new = near[front].any(axis=0) & left
            left &= ~new
            front = np.flatnonzero(new).tolist()
            out += [(ids[j], ids[i]) for j in front]
    return out


def _compare(cells: DataFrame, need: int) -> DataFrame:
    """Links (a, b) within each cell of (pivot, one, two, set, data)."""

    def each(_, rows):
        found = block_links(rows["set"], [np.frombuffer(d, dtype=np.uint64) for d in rows["data"]], need) if len(rows["set"]) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    keys = ["pivot", "one", "two"]
    return cells.select(*keys, "set", "data").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream_groups(keys, each), "a long, b long")


def _size_block(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(STEP))).cast("int")


def _with_partner(index: DataFrame, need: int) -> DataFrame:
    """Entries, each once, that may have a partner in their list: the next larger or smaller set is near enough in size."""
    order = Window.partitionBy("shingle").orderBy("n", "set")
    index = index.withColumn("was", F.lag("set").over(order)).filter("was is null or was <> set").drop("was")
    up, down = F.lead("n").over(order), F.lag("n").over(order)
    above = 100 * F.col("n") >= need * up
    below = 100 * down >= need * F.col("n")
    return index.withColumn("keep", F.coalesce(above, F.lit(False)) | F.coalesce(below, F.lit(False))).filter("keep").drop("keep")


def labels(docs: DataFrame, members: DataFrame, levels: np.ndarray, width: int, need: int) -> DataFrame | None:
    """(set, component) of the sets that link with others; None if there are none."""
    by_shingle = Window.partitionBy("shingle")
    near = cut(_with_partner(postings(docs, levels, width, need), need))
    index = near.withColumn("met", F.count("*").over(Window.partitionBy("set"))).filter(F.col("met") >= entries_needed(F.col("n"), need)).drop("met")
    # Answer level: every set's pivot is the set of least rank in its lists.
    rank = F.struct(F.xxhash64("set").alias("r"), F.col("set").alias("pivot"))
    index = cut(index.withColumn("head", F.min(rank).over(by_shingle)))
    if index.isEmpty():
        return None
    pivots = cut(index.groupBy("set").agg(F.min("head")["pivot"].alias("pivot"), F.first("n").alias("n")))
    # Groups of more than one block; a hot group's sets are dealt over salts where the groups are joined.
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = cut(pivots.groupBy("pivot").agg(blocks.alias("blocks")).filter("blocks > 1"))
    placed = join_counted(pivots, large, "pivot", "left", F.col("set")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "set"), F.col("blocks")).cast("int"))
    # The sets' shingles, read again from one document of each.
    one = members.groupBy("set").agg(F.min("doc_id").alias("doc_id")).join(pivots.select("set"), "set")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(one.select(F.xxhash64("doc_id").alias("k"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = unpacked(shared.value), set()
        for batch in batches:
            hit = np.flatnonzero(wanted[bit_of(batch.column("k").to_numpy())])
            ids, data = [], []
            for text in batch.column("text").take(pa.array(hit)).to_pylist():
                own = shingles(text, width)
                if len(own) and (sid := set_id(own)) not in seen:
                    seen.add(sid)
                    ids.append(sid)
                    data.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["set", "data"])

    data = docs.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(read, "set long, data binary")
    full = cut(placed.join(data, "set"))
    # A pivot's sets against its first block; the first block's rows go to every cell.
    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    found = cut(_compare(full.withColumn("one", F.explode(to)).withColumn("two", F.lit(0)), need))
    if large.isEmpty():
        tree = _stars(found)
    else:
        # Only links of groups of several blocks need their components sought; a single block's are stars already.
        several = full.filter("blocks > 1")
        several_sets = several.select("set")
        inner = found.join(several_sets, found["b"] == several_sets["set"], "left_semi")
        tree = cut(components(inner))
        named = several.select("pivot", "set", "block", "blocks").join(tree.withColumnRenamed("id", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        # Sets outside their group's largest component, against all blocks.
        sizes = named.groupBy("pivot", "component").agg(F.count("*").alias("k"))
        largest = sizes.groupBy("pivot").agg(F.max(F.struct("k", "component"))["component"].alias("largest"), F.ceil((F.sum("k") - F.max("k")) / BLOCK_SETS).cast("int").alias("shares"))
        largest = cut(largest.filter("shares > 0"))
        rest = join_counted(named, largest, "pivot", "inner", F.col("set")).filter("component <> largest").select("pivot", "set", "blocks", "shares")
        rest = rest.withColumn("share", F.pmod(F.xxhash64(F.lit(8), "set"), F.col("shares")).cast("int"))
        left = rest.select("pivot", "set", F.col("share").alias("one"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("two")).join(several.select("set", "data"), "set")
        right = join_counted(several.select("pivot", "set", "block", "data"), largest, "pivot", "inner", F.col("set"))
        right = right.select("pivot", "set", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("one"), F.col("block").alias("two"), "data")
        more = cut(_compare(left.select("pivot", "one", "two", "set", "data").unionByName(right), need))
        if not more.isEmpty():
            tree = components(tree.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        tree = cut(_stars(found.join(several_sets, found["b"] == several_sets["set"], "left_anti")).unionByName(tree.select(F.col("id").alias("set"), "component")))
    more = _across(index.drop("head").join(pivots.select("set", "pivot"), "set"), tree, full, need)
    if more is None:
        return tree
    # The links between components, contracted to them.
    ends = more.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    every = cut(tree.unionByName(ends.join(tree, "set", "left_anti").select("set", F.col("set").alias("component"))))
    own = every.select("set", F.col("component").alias("own"))
    edges = more.join(own.withColumnsRenamed({"set": "a", "own": "x"}), "a").join(own.withColumnsRenamed({"set": "b", "own": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    top = cut(components(edges)).select(F.col("id").alias("component"), F.col("component").alias("top"))
    return join_counted(every, top, "component", "left", F.col("set")).select("set", F.coalesce("top", "component").alias("component"))


def _stars(found: DataFrame) -> DataFrame:
    """(set, component) of links that are stars (set, centre)."""
    return found.select(F.col("a").alias("set"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("set"), F.col("b").alias("component"))).distinct()


def _across(index: DataFrame, tree: DataFrame, full: DataFrame, need: int) -> DataFrame | None:
    """Links (a, b) between sets of several pivots and components that meet in lists of (shingle, set, n, at, pivot); None if there are none."""
    by_shingle = Window.partitionBy("shingle")
    named = index.join(tree, "set", "left").withColumn("component", F.coalesce("component", "set"))
    mixed = named.withColumn("lo", F.min("component").over(by_shingle)).withColumn("hi", F.max("component").over(by_shingle)).withColumn("p", F.min("pivot").over(by_shingle)).withColumn("q", F.max("pivot").over(by_shingle))
    mixed = cut(mixed.filter("lo <> hi and p <> q").select("shingle", "set", "n", "at", "pivot", "component"))
    # A set probes the blocks of sizes from its own to the largest that can link.
    most = F.floor(F.col("n") * 100 / need)
    probe = mixed.select("shingle", F.explode(F.sequence(_size_block(F.col("n")), _size_block(most))).alias("size"), *(F.col(c).alias(f"{c}1") for c in ("set", "n", "at", "pivot", "component")))
    lists = mixed.select("shingle", _size_block(F.col("n")).alias("size"), "set", "n", "at", "pivot", "component")
    # Positions: before and after a shared shingle no more can be shared than the shorter side has.
    reach = F.least("at1", "at") + F.least(F.col("n1") - F.col("at1"), F.col("n") - F.col("at"))
    enough = (reach * (100 + need) >= need * (F.col("n1") + F.col("n"))) & (F.col("n") <= F.floor(F.col("n1") * 100 / need))
    later = (F.col("n1") < F.col("n")) | ((F.col("n1") == F.col("n")) & (F.col("set1") < F.col("set")))
    met = probe.join(lists, (probe["shingle"] == lists["shingle"]) & (probe["size"] == lists["size"]) & later & (F.col("pivot1") != F.col("pivot")) & (F.col("component1") != F.col("component")) & enough)
    # Of the set whose prefix ends first all shared prefix shingles are seen; what is behind it can be shared at most.
    rest = F.greatest(*(F.ceil(F.col(c) * need / 100) - 1 - F.floor(F.col(c) / EXTRA) for c in ("n1", "n")), F.lit(0))
    counted = met.groupBy("set1", "set", "n1", "n").agg(F.count("*").alias("seen"))
    pairs = cut(counted.filter((F.col("seen") + rest) * (100 + need) >= need * (F.col("n1") + F.col("n"))).select(F.col("set1").alias("a"), F.col("set").alias("b")))
    if pairs.isEmpty():
        return None
    asked = full.sparkSession.sparkContext.broadcast(bitmap(pairs.select(F.explode(F.array("a", "b")).alias("set"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = unpacked(asked.value)
        for batch in batches:
            yield batch.filter(pa.array(wanted[bit_of(batch.column("set").to_numpy())]))

    arrays = full.select("set", "data").mapInArrow(pick, "set long, data binary")
    two = pairs.join(arrays.withColumnRenamed("set", "a").withColumnRenamed("data", "x"), "a").join(arrays.withColumnRenamed("set", "b").withColumnRenamed("data", "y"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                keep.append(bool(linked(int((b[at] == a).sum()), len(a), len(b), need)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    more = cut(two.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))
    return None if more.isEmpty() else more


def join(docs: DataFrame, width: int = 5, need: int = NEED) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``; component_id is the smallest doc_id that links reach."""
    members, levels = members_and_sketch(docs, width)
    tree = labels(docs, members, levels, width, need)
    sets = members.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"), F.count("*").alias("k"))
    if tree is None:
        named = sets.filter("k > 1").select("set", F.col("least").alias("component_id"))
    else:
        both = sets.join(tree, "set", "left").filter("k > 1 or component is not null").withColumn("component", F.coalesce("component", "set"))
        least = both.groupBy("component").agg(F.min("least").alias("component_id"))
        named = both.select("set", "component").join(least, "component").select("set", "component_id")
    out = join_counted(members, cut(named), "set", "left", F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
