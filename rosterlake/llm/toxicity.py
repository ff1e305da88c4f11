"""Toxicity: a linear-chain CRF tags toxic spans; forward-backward marginals give scores and offsets.

Documents carry labels, tokens do not: tokens are labelled by contrast.  A word
of a toxic document is toxic if it, or its stem, is far more frequent among the
toxic sample documents than among the clean ones and explains documents that
other such words don't.  The chain is fitted on these
tokens of a hash-ordered sample of labelled documents, bounded in number and in
characters, and a logistic curve over the sum of a document's marginals is fitted
on the same documents.  A whole text is one chain, in the fit as in the score.

Defined cases: null text counts as empty; empty texts get the score of no toxic
token; without labels of both classes every score is the labelled toxic share
(0 without labels); a document with several label rows is toxic if one says so,
and is sampled with its shortest text if it has several;
null labels are unlabelled; rows that repeat a doc_id are scored each; a null
doc_id counts as the empty text in the fold; other columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm import crf
from rosterlake.llm.common import NOT_ALNUM, groups_of, lowered, word_hashes, word_spans

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 1000
#: Characters of the labelled documents that the model is fitted on, half for each class, at most: what the driver holds.
SAMPLE_CHARS = 3_000_000


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


@dataclass
class Model:
    """Feature hashes are sorted; weights have one more entry, for any other feature."""

    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    own: np.ndarray = field(default_factory=lambda: np.zeros(1))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1))  #: by the whole word before
    right: np.ndarray = field(default_factory=lambda: np.zeros(1))  #: by the whole word after
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    level: float = -30.0

    def index(self, features: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(features.shape, dtype=np.int64)
        at = np.searchsorted(self.vocabulary, features)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == features, at, len(self.vocabulary))

    def marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of each word of each document (its words' features)."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        if not sizes.sum():
            return [np.zeros(0) for _ in docs]
        at = self.index(np.concatenate(docs))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        emit = self.bias + self.own[at].sum(axis=1)
        place = np.arange(len(at)) - np.repeat(starts, sizes)
        emit[1:] += np.where(place[1:] > 0, self.left[at[:-1, 0]], 0.0)
        emit[:-1] += np.where(place[1:] > 0, self.right[at[1:, 0]], 0.0)
        return np.split(crf.chain_forward_backward(emit, sizes, self.trans)[0], ends[:-1])

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.level + self.slope * np.log1p(total), -30, 30)))


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the runs of letters and digits (the word, its first 4 and 5 bytes), their starts and ends (bytes)."""
    data = lowered(text)
    starts, ends = word_spans(data, NOT_ALNUM)
    stems = [word_hashes(data, starts, np.minimum(starts + n, ends)) ^ np.uint64(n) for n in (4, 5)]
    return np.stack([word_hashes(data, starts, ends), *stems], axis=1), starts, ends


def telling_features(docs: list[np.ndarray], toxic: np.ndarray, contrast: float = 20.0, cover: int = 2) -> np.ndarray:
    """Features that tell toxic documents: of those ``contrast`` times as frequent there, the fewest that are ``cover`` times in each, greedily.

    One that only comes along with others adds no cover and is left out, as is
    one all of whose words an earlier one has explained.
    """
    in1, in0 = Counter(), Counter()
    for d, t in zip(docs, toxic, strict=True):
        (in1 if t else in0).update(np.unique(d).tolist())
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    least = max(2, n1 // 100)
    where: dict[int, list[int]] = {f: [] for f, k in in1.items() if k >= least and k / n1 > contrast * (in0[f] + 0.5) / n0}
    words: dict[int, set[int]] = {f: set() for f in where}
    for i, d in enumerate(d for d, t in zip(docs, toxic, strict=True) if t):
        found = set()
        for row in d.tolist():
            for f in row:
                if f in where:
                    words[f].add(row[0])
                    found.add(f)
        for f in found:
            where[f].append(i)
    need, chosen, explained = np.full(n1, cover), [], set()
    while where:
        gain, best = max((int((need[d] > 0).sum()), -f) for f, d in where.items())
        if gain < least:
            break
        need[where[-best]] -= 1
        explained |= words[-best]
        chosen.append(-best)
        where = {f: d for f, d in where.items() if not words[f] <= explained}
    return np.array(sorted(chosen), dtype=np.uint64)


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """A model from labelled documents; equal texts count once (toxic if one is)."""
    once: dict[str, int] = {}
    for text, label in zip(texts, toxic, strict=True):
        once[text or ""] = max(label, once.get(text or "", 0))
    texts, toxic = list(once), list(once.values())
    truth = np.array(toxic, dtype=bool)
    n1, n0 = int(truth.sum()), int((~truth).sum())
    if not n1 or not n0:
        share = float(truth.mean()) if len(truth) else 0.0
        return Model(level=float(np.clip(np.log((share + 1e-12) / (1 - share + 1e-12)), -30, 30)))
    docs = [words_of(t)[0] for t in texts]
    bad = telling_features(docs, truth)
    seen = Counter()
    for d in docs:
        seen.update(np.unique(d).tolist())
    model = Model(vocabulary=np.array(sorted(f for f, k in seen.items() if k >= 3), dtype=np.uint64))
    size = len(model.vocabulary) + 1
    # A chain for each whole text, laid end to end.
    sizes = np.array([len(d) for d in docs])
    if not sizes.sum():
        return Model(level=float(np.log(n1 / n0)))
    word = np.concatenate([model.index(d) for d in docs]).astype(np.int32)
    mark = np.concatenate([np.isin(d, bad).any(axis=1) & t for d, t in zip(docs, truth, strict=True)])
    place = np.arange(len(word), dtype=np.int32)
    inner = np.ones(len(word), dtype=bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    inner = place[inner]  # places with a word before them
    features = np.concatenate([*(word[:, i] for i in range(3)), size + word[inner - 1, 0], 2 * size + word[inner, 0], np.full(len(word), 3 * size, np.int32)])
    rows = np.concatenate([place, place, place, inner, inner - 1, place])
    chain = crf.fit_chains(features, rows, 3 * size + 1, mark.astype(np.int64), sizes)
    model.own, model.left, model.right = (chain.weights[i * size : (i + 1) * size] for i in range(3))
    model.bias, model.trans = float(chain.weights[-1]), chain.trans
    total = np.array([m.sum() for m in model.marginals(docs)])
    x, y = np.log1p(total), truth.astype(float)
    level, slope = 0.0, 1.0
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(level + slope * x, -30, 30)))
        g = np.array([(y - p).sum() - 1e-2 * level, ((y - p) * x).sum() - 1e-2 * slope])
        v = p * (1 - p)
        h = np.array([[v.sum() + 1e-2, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        level, slope = level + d[0], slope + d[1]
    model.level, model.slope = float(level), float(slope)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, toxic): labelled documents outside the held-out fold, in hash order, as many of each class as ``sample`` and half of ``chars`` allow."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample))
    size = F.length(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 x sample rows
    rows = rows.filter(size <= chars // 2).groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(size, "text")).alias("text"))
    so_far = F.sum(size).over(Window.partitionBy("toxic").orderBy(order, "doc_id"))  # 2 x sample rows
    return rows.withColumn("so_far", so_far).filter(F.col("so_far") <= chars // 2).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    rows = sorted(training_rows(docs, labels, sample, chars).collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def offsets(text: str, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte offsets as code points."""
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)])
    return list(zip(lead[starts].tolist(), lead[ends].tolist(), strict=True))


def scorer(model: Model, threshold: float = 0.5):
    """A function for mapInArrow: in place of the column text, score, predicted and spans; texts are tagged about 250,000 characters at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, texts in ((b, at, t) for b in batches for at, t in groups_of(b.column("text").to_pylist())):
            batch = batch.slice(start, len(texts))
            found = [words_of(t) for t in texts]
            marginals = model.marginals([f[0] for f in found])
            score = model.score(np.array([m.sum() for m in marginals]))
            spans = []
            for text, (_, starts, ends), m in zip(texts, found, marginals, strict=True):
                hit = m >= threshold
                spans.append(",".join(f"{a}:{b}" for a, b in offsets(text, starts[hit], ends[hit])) if hit.any() else "")
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != "text"]
            more = [("score", pa.array(score)), ("predicted", pa.array((score >= 0.5).astype("int32"))), ("spans", pa.array(spans, pa.string()))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + more], [n for n, _ in kept + more])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end of offending words, code points) for every row."""
    model = train(docs, labels, sample)
    ids = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return ids.mapInArrow(scorer(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, spans string")
