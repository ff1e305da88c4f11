"""Recall of line dedup's links: ``python -m tests.llm.line_recall SF_DIR``.

Two measures. Edited copies of 1,500 of the table's lines, one kind of edit at a
time, that keep an edit similarity of 0.8: found if both are in one group. And
the lines of documents whose id is divisible by 50, held against all lines by
edit similarity alone.
"""

import random
import sys
from collections import Counter
from multiprocessing import Pool

from pyspark.sql import SparkSession

from rosterlake.llm import line_dedup
from tests.llm.test_operators import plain_key

LINES: list[str] = []


def similar_to(asked: str) -> list[tuple[str, str]]:
    n = len(asked)
    return [(asked, x) for x in LINES if x != asked and abs(len(x) - n) <= int(max(len(x), n) * 0.2 + 1e-9) and line_dedup.similar_texts(asked, x)]


def edited(kind: str, line: str, rnd: random.Random) -> str:
    words = line.split(" ")
    at = rnd.randrange(len(words))
    if kind == "word dropped":
        del words[at]
    elif kind == "word replaced":
        words[at] = rnd.choice(LINES).split(" ")[0]
    else:
        every = {"every third word": 3, "every second word": 2}.get(kind)
        for k in range(0, len(words), every) if every else [at]:
            j = rnd.randrange(len(words[k]))
            words[k] = words[k][:j] + rnd.choice("abcdefghijklmnop") + words[k][j + 1 :]
    return " ".join(words)


def groups(spark, texts):
    base = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("xxhash64(doc_id, coalesce(text, '')) as row", "doc_id", "text")
    tree = line_dedup.line_groups(base, line_dedup.cut(line_dedup.lines(base, line_dedup.Hash.shaped(line_dedup.summed(base)))))
    group = {} if tree is None else {r["line"]: r["component"] for r in tree.collect()}

    def of(key: str) -> int:
        place = int(line_dedup.read_lines([key])[2].view("int64")[0])
        return group.get(place, place)

    return of


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    LINES.extend(sorted({k for r in rows for x in (r["text"] or "").split("\n") if (k := plain_key(x)) is not None}))
    rnd = random.Random(1)
    chosen = rnd.sample([x for x in LINES if x.count(" ") >= 4], 1500)
    for kind in ("one character", "word replaced", "word dropped", "every third word", "every second word"):
        pairs = [(x, y) for x in chosen if (y := edited(kind, x, rnd)) != x and line_dedup.similar_texts(x, y)]
        of = groups(spark, LINES + [y for _, y in pairs])
        near, found = Counter(), Counter()
        for x, y in pairs:
            words = x.count(" ") + 1
            size = next(f"{low}+" for low in (50, 20, 10, 5) if words >= low)
            for s in (size, "all"):
                near[s] += 1
                found[s] += of(x) == of(y)
        print({"edit": kind} | {s: f"{found[s]} of {near[s]}" for s in ("5+", "10+", "20+", "50+", "all")}, flush=True)
    asked = sorted({k for r in rows if r["doc_id"] % 50 == 0 for x in (r["text"] or "").split("\n") if (k := plain_key(x)) is not None})
    with Pool(8) as pool:
        pairs = {tuple(sorted(p)) for found in pool.imap_unordered(similar_to, asked, 4) for p in found}
    of = groups(spark, [r["text"] for r in rows])
    hit = [of(a) == of(b) for a, b in pairs]
    print({"lines": len(LINES), "asked": len(asked), "pairs": len(hit), "found": sum(hit)})


if __name__ == "__main__":
    main(sys.argv[1])
