"""Secret scans with a trigram inverted index (DataFrame functions only).

Each rule's regex is parsed once on the driver into a Boolean query over the
trigrams that any match must contain (case folded).  The postings hold, for
the trigrams of the rules, the documents that contain them; intersecting them
clause by clause gives each rule's candidate documents, and only those are
verified with the regex.  A rule without mandatory trigrams scans all texts.

Defined cases: null text counts as empty; rows with the same doc_id are scanned
each on its own (their postings are shared, which only adds candidates); a null
doc_id is a key like any other; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import cut, join_counted


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regex that Python parses too; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, in the order in which ties are listed.
# For hex, runs of 24 or more are the greedy runs that pass the length test.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Public token formats that the method adds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

Clauses = frozenset[frozenset[str]]  #: an OR of ANDs of trigrams
ALWAYS: Clauses = frozenset([frozenset()])
MOST_STRINGS = 64


def _either(*queries: Clauses) -> Clauses:
    every = frozenset().union(*queries)
    return frozenset(c for c in every if not any(o < c for o in every))


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _either(frozenset(x | y for x, y in product(a, b)))


def _grams(strings: set[str]) -> Clauses:
    return _either(*(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings))


def _walk(items) -> tuple[set[str] | None, Clauses]:
    """The exact strings that a sequence can be (None: too many), and its trigram query."""
    run, query, exact = {""}, ALWAYS, True
    for op, arg in items:
        strings, sub = _node(str(op), arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, run, exact = _both(query, _grams(run)), {""}, False
        if strings is not None and len(strings) <= MOST_STRINGS:
            run = strings
        else:
            query = _both(query, sub)
    return (run if exact else None), _both(query, _grams(run))


def _node(op: str, arg) -> tuple[set[str] | None, Clauses]:
    if op == "LITERAL":
        return {chr(arg).lower()}, ALWAYS
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
        return {chr(c).lower() for _, c in arg}, ALWAYS
    if op == "SUBPATTERN":
        return _walk(arg[-1])
    if op == "BRANCH":
        parts = [_walk(x) for x in arg[1]]
        strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        return strings, _either(*(q for _, q in parts))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, sub = arg
        strings, query = _walk(sub)
        if most == 1 and least == 0 and strings is not None:
            return strings | {""}, ALWAYS
        if least == most == 1:
            return strings, query
        if least == most and strings is not None and len(strings) == 1 and most <= 64:
            return {next(iter(strings)) * most}, ALWAYS
        return None, query if least else ALWAYS
    return None, ALWAYS


def trigram_query(pattern: str) -> Clauses:
    """Trigrams (case folded) that every match has: an OR of ANDs; an empty AND means none is mandatory."""
    return _walk(regex_parser.parse(pattern))[1]


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the indexed rules whose trigram query the document meets."""
    clauses = [(r.kind, n, t, len(c)) for r in rules for n, c in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for t in c]
    asked = docs.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, need int")
    vocabulary = sorted({t for _, _, t, _ in clauses})
    found = F.transform(
        F.array(F.lower(F.coalesce("text", F.lit("")))),
        lambda text: F.array(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in vocabulary)),
    )
    postings = docs.select("doc_id", F.explode(F.array_distinct(F.array_compact(found[0]))).alias("trigram"))
    met = (
        postings.join(F.broadcast(asked), "trigram")  # a few rows for each rule
        .groupBy("doc_id", "kind", "clause").agg(F.count_distinct("trigram").alias("got"), F.first("need").alias("need"))
        .filter("got >= need")
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


#: Matches that are walked in one go, so that a text of many matches takes time in proportion to them.
STRETCH = 256
_KIND = "array<struct<start:int,place:int,end:int>>"


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, end>> of the rule's matches: gaps and matches alternate, so their lengths give the offsets.

    A stretch of matches is walked by itself, then the stretches are moved to where they start.
    """
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    empty = F.array().cast(_KIND)

    def step(state, pair):
        start = state["at"] + F.length(pair["gaps"])
        end = start + F.length(pair["found"])
        part = pair["found"] if rule.group == 0 else F.regexp_extract(pair["found"], rule.pattern, rule.group)
        one = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(state["out"], F.when(F.length(part) >= rule.least, one).otherwise(empty)).alias("out"))

    def join(state, stretch):
        moved = F.transform(stretch["out"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["place"].alias("place"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + stretch["at"]).alias("at"), F.array_append(state["out"], moved).alias("out"))

    # Bound once, not for every stretch.
    pairs = F.array(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gaps"), found.alias("found")))
    stretches = F.transform(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STRETCH).cast("int")), lambda k: F.slice(p, k * STRETCH + 1, F.lit(STRETCH))))[0]
    walked = F.transform(stretches, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
    joined = F.aggregate(walked, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_KIND}>").alias("out")), join, lambda s: F.flatten(s["out"]))
    return F.when(F.rlike(text, F.lit(rule.pattern)), joined).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, found: array of (start, place, end), place = the rule's index; code points, end exclusive."""
    text = F.coalesce("text", F.lit(""))
    indexed = {r.kind for r in rules if frozenset() not in trigram_query(r.pattern)}
    out = docs.select("doc_id", "text")
    if indexed:
        some = cut(candidates(docs, tuple(r for r in rules if r.kind in indexed)))
        out = join_counted(out, some, "doc_id", "left", F.col("text"))
    else:
        out = out.withColumn("rules", F.lit(None).cast("array<string>"))
    parts = []
    for place, rule in enumerate(rules):
        spans = _spans(text, rule, place)
        if rule.kind in indexed:
            spans = F.when(F.array_contains("rules", rule.kind), spans).otherwise(F.array().cast("array<struct<start:int,place:int,end:int>>"))
        parts.append(spans)
    return out.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base_sha256, spans."""
    names = F.array(*(F.lit(r.kind) for r in rules))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["place"]], s["start"], s["end"])), ",")

    def count(place):
        return F.size(F.filter("found", lambda s: s["place"] == place)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    ours = F.filter("found", lambda s: s["place"] < base)
    return scanned.select("doc_id", *counts, F.sha2(listed(ours), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
