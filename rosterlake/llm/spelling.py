"""Spelling variants: rare words one edit away from a much more frequent one take its form.

Even-partition pigeonhole join.  A word of n code points is cut into two
segments of n // 2 and the rest.  One edit leaves one of the two untouched: of
two words of equal length a segment at the same place, and of a word and one
that is a code point longer the first segment at the start or the second at the
end, shifted by one.  Both segments of each word are indexed by (length, place,
segment); words of the same length and words that are one longer probe the
index.  A candidate that both segments find counts for the first one only; all
candidates are verified by the edit distance.  Index lists longer than LIST are
dealt over parts, and each probe goes to all parts of its list.

Words are counted over all texts.  ``corpus_words`` finds them (runs of ASCII
and Latin-1 letters, A-Z in lower case) and deletes a code point from one run in
199, chosen by the checksum of document and run.  Defined cases: null text has
no words; a null doc_id is the empty string in the checksum; rows that repeat
count as often as they are there; no words give no rows; other columns aren't
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import BROADCAST_ROWS, cut, written

#: Code points and occurrences of a word at least; times that a form is more frequent than the word.
LETTERS, LEAST, FACTOR = 6, 5, 5
#: One run in so many loses a code point.
SLIPS = 199
#: Words of an index list that meet a probe in one task.
LIST = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of at least LETTERS code points and LEAST occurrences, misspelt as told above."""
    lower = F.translate("text", UPPER, LOWER)
    runs = F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{LETTERS},}}"), F.lit(0))  # a shorter run gives no word
    told = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    told = told.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIPS == 0, slip).otherwise(F.col("run"))
    return told.select(word.alias("word")).filter(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _left(word: Column, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def _key(length: Column, place: int, segment: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), F.lit(str(place)), segment)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words (word, n) that differ by one code point inserted, deleted or replaced, once."""
    word, n = F.col("word"), F.length("word")

    def keys(length: Column) -> list[Column]:
        """Of the words of ``length``, the lists in which a word one edit away has an equal segment."""
        return [_key(length, 1, _left(word, _half(length))), _key(length, 2, F.right(word, length - _half(length)))]

    index = words.select("word", "n", F.posexplode(F.array(*keys(n))).alias("place", "key"))
    # Probes of words of equal length, then of those one shorter.
    probes = words.select("word", "n", F.posexplode(F.array(*keys(n), *keys(n - 1))).alias("kind", "key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("k"))
    many = max(LIST, -(-4 * words.count() // BROADCAST_ROWS))  # 2 words.count() rows in all: fewer than BROADCAST_ROWS lists are longer
    long = cut(sizes.filter(F.col("k") > many).select("key", F.ceil(F.col("k") / LIST).cast("int").alias("parts")))
    index = index.join(F.broadcast(long), "key", "left").select(F.col("word").alias("b"), F.col("n").alias("n_b"), "key", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    probes = probes.join(F.broadcast(long), "key", "left").select(F.col("word").alias("a"), F.col("n").alias("n_a"), "kind", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    a, b = F.col("a"), F.col("b")
    equal = F.length("a") == F.length("b")
    half = _half(F.length("b"))
    # A pair of equal length is found by both of its words, and a pair with two equal segments twice.
    first = (~equal | (a < b)) & ((F.col("kind") % 2 == 0) | (_left(a, half) != _left(b, half)))
    return probes.join(index, ["key", "part"]).filter(first & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``words`` (word, n: one row each).

    ``form`` is the near word of largest n (of equals the first in code-point
    order), if that is FACTOR times the word's n or more; ``root`` follows forms
    to the last one.  Each step multiplies n by FACTOR, so a chain of forms has
    no more steps than n has digits to that base; each round doubles the steps.
    """
    words = written(words)
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    fits = -F.col("best.less") >= FACTOR * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    chain = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # Very many words may have one form: it is dealt out as a skewed join by Spark, whose other side has a row for each word.
        step = written(chain.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        chain = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return rows.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
