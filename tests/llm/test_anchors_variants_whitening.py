"""Substring dedup, spelling variants and embedding whitening against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import spelling, substring_dedup, whitening

# --- 11: substring dedup ----------------------------------------------------------------------------------------------


def brute_repeats(rows, k):
    """(words, removed, kept) of each (doc_id, text)."""
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), words in zip(rows, split):
        for p in range(len(words) - k + 1):
            w = tuple(words[p : p + k])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for (i, _), words in zip(rows, split):
        drop = [False] * len(words)
        for p in range(len(words) - k + 1):
            m = first.get(tuple(words[p : p + k]))
            if m is not None and (i is None or i > m):
                drop[p : p + k] = [True] * k
        out.append((len(words), sum(drop), " ".join(w for w, d in zip(words, drop) if not d)))
    return out


def held_against(spark, rows, k, hot=256):
    docs = spark.createDataFrame([(n, i, t, 7, "x") for n, (i, t) in enumerate(rows)], "row long, doc_id long, text string, n_words int, gone string")
    got = {r["row"]: r for r in substring_dedup.deduplicate(docs, k, hot).withColumn("joined", substring_dedup.joined_words(F.coalesce("text", F.lit("")))).collect()}
    assert len(got) == len(rows)
    for n, (words, removed, kept) in enumerate(brute_repeats(rows, k)):
        r = got[n]
        assert (r["doc_id"], r["n_words"], r["n_removed"], r["joined"], r["gone"]) == (rows[n][0], words, removed, kept, "x"), n
        if not removed:
            assert r["text"] == rows[n][1]


@pytest.mark.parametrize(("k", "hot"), [(50, 256), (33, 2)])
def test_repeats_match_brute_force(spark, k, hot):
    rnd = random.Random(k)
    word = lambda: rnd.choice(["ab", "é", "C", "dd,", "😀", "xyz", "q"])
    passages = [[word() for _ in range(rnd.choice([k - 1, k, k + 1, 2 * k, 90]))] for _ in range(6)]
    rows = [(None, None), (3, ""), (4, None), (5, " \t\n"), (-2, "a b\tc")]
    for i in rnd.sample(range(100), 60):
        words = []
        for _ in range(rnd.randrange(4)):
            words += [word() for _ in range(rnd.randrange(70))] + (rnd.choice(passages) if rnd.random() < 0.6 else [])
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(words)))
    long = " ".join(str(j % 97) for j in range(20_000))
    rows += [rows[-1], rows[-2], (None, rows[-1][1]), (None, rows[-3][1]), (rows[-1][0], rows[-4][1]), (200, long), (201, long + " more")]
    held_against(spark, rows, k, hot)


def test_window_of_exactly_fifty_words_at_every_offset(spark):
    words = [f"w{j}" for j in range(50)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(i)] + words + [f"b{i}"])) for i in range(35)] + [(100, " ".join(words[:49]))]
    held_against(spark, rows, 50)


def test_a_passage_in_most_documents(spark):
    rnd, passage = random.Random(5), " ".join(f"p{j}" for j in range(70))
    rows = [(i, " ".join(f"u{rnd.random()}" for _ in range(rnd.randrange(40))) + " " + passage) for i in range(600)]
    held_against(spark, rows, 50, hot=100)


def test_no_documents_and_no_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.deduplicate(empty).columns == ["doc_id", "text", "n_words", "n_removed"]
    assert substring_dedup.deduplicate(empty).count() == 0
    held_against(spark, [(1, "one two"), (2, "three")], 50)


def test_cover_has_every_difference():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


# --- 12: spelling variants --------------------------------------------------------------------------------------------


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def brute_variants(words):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o.encode()))
        if words[best] >= 5 * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def test_words_of_the_corpus(spark):
    rnd = random.Random(3)
    vocabulary = ["Überall", "überall", "schließen", "RÉSUMÉ", "rÉsumÉ", "naïveté", "hundred", "hundreds", "abc", "letters×÷ÿ", "sixsix", "fiveX"]
    rows = [(i, " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "1", "Ÿ", "-x"]) for _ in range(rnd.randrange(60)))) for i in range(400)]
    rows += [(None, None), (7, None), (8, ""), (None, "hundreds " * 30), (9, "x" * 50_000)] + [rows[0]] * 3
    slips = next(i for i in range(1000, 9000) if zlib.crc32(f"{i}:hundreds".encode()) % 199 == 0)
    rows.append((slips, "hundreds " * 9))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int")
    got = {r["word"]: r["n"] for r in spelling.corpus_words(docs).collect()}
    assert got == brute_words(rows)
    assert len(set(got) & {"hundreds"[:j] + "hundreds"[j + 1 :] for j in range(8)}) >= 1  # misspelt


@pytest.mark.parametrize("most", [512, 3])
def test_forms_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "LIST", most)
    rnd = random.Random(most)
    words = {}
    for _ in range(120):
        w = "".join(rnd.choice("abé") for _ in range(rnd.choice([6, 6, 7, 7, 8, 9])))
        words[w] = rnd.choice([5, 5, 25, 125, 700, 5000])
        at = rnd.randrange(len(w) + 1)
        words[w[:at] + rnd.choice("abcé") + w[at:]] = rnd.choice([5, 26, 130])
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "aaaaaaaaaa": 3125, "aaaaaaaaaaa": 15625}  # a chain of forms
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert got == brute_variants(words)
    pairs = [(r["a"], r["b"]) for r in spelling.near_pairs(df).collect()]
    assert len({frozenset(p) for p in pairs}) == len(pairs)


def test_no_words(spark):
    assert spelling.variants(spelling.corpus_words(spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string"))).count() == 0


# --- 13: embedding whitening ------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 1) for i, v in vectors], VECTORS)


def brute_whitening(vectors, k=16):
    usable = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000) for i, v in vectors if v and all(e is not None and np.isfinite(e) for e in v)]
    fit = np.unique(np.array([x for _, x in usable]), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = (fit - total // n) - (total % n) / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n - np.outer(centred.mean(0), centred.mean(0)))
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    out = {}
    for i, x in usable:
        z = ((x - total // n) - (total % n) / n) @ vectors_[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300))
        out.setdefault(i, []).append((sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total)), z))
    return n, values, out


@pytest.mark.parametrize(("d", "rows"), [(64, 400), (3, 50), (150, 500), (24, 300)])
def test_whitening_matches_brute_force(spark, d, rows):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((rows, d)) * np.linspace(3, 0.3, d)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(1000, base[3].tolist()), (5, base[4].tolist()), (1001, None), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] * d), (1005, []), (None, base[6].tolist())]
    n, values, want = brute_whitening(vectors)
    got = defaultdict(list)
    for r in whitening.whiten(table(spark, vectors)).collect():
        got[r["vec_id"]].append(r)
    assert set(got) == set(want)
    k = min(16, d)
    sign = np.zeros(k)
    for i, told in want.items():
        assert len(got[i]) == k * len(told)
        if len(told) == 1:
            one = sorted(got[i], key=lambda r: r["component"])
            assert [r["component"] for r in one] == list(range(1, k + 1))
            assert {(r["n"], r["deviation"]) for r in one} == {(n, told[0][0])}
            z = np.array([r["whitened"] for r in one])
            sign = np.where(sign == 0, np.sign(z * told[0][1]), sign)
            np.testing.assert_allclose(z * sign, told[0][1], atol=1e-8)
            np.testing.assert_allclose([r["explained"] for r in one], values[:k] / values.sum(), rtol=1e-10)
            assert max(r["identity_error"] for r in one) < 1e-9


def test_few_passes_of_a_wide_block(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST", 3)  # the subspace is cut down on the way
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 200)) * np.geomspace(30, 1, 200))]
    fit = whitening.whole_numbers(table(spark, vectors)).select("x")
    centre = whitening.Centre(fit)
    values, directions, trace = whitening.components(fit, centre)
    n, want, _ = brute_whitening(vectors)
    np.testing.assert_allclose(values, want[:16], rtol=1e-12)
    np.testing.assert_allclose(directions.T @ directions, np.eye(16), atol=1e-12)
    assert trace == pytest.approx(want.sum(), rel=1e-12)


def test_tables_that_cannot_be_whitened(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.001, 2.0])])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 3
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0])]))


def test_deviation_beyond_a_long_is_null(spark):
    rows = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table(spark, [(1, [2.0**40]), (2, [0.0]), (3, [1.0])])).collect()}
    assert rows[1] is None
