"""URL filters: host and path rules, and link-graph trust for what no rule decides (DataFrame functions only).

Trust starts at trusted hosts and follows links (personalised PageRank);
distrust starts at blocked hosts and follows links backwards, since a host that
links to blocked ones is suspect.  A host whose distrust, against the mean seed,
passes the threshold and its trust is blocked.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule fits it; null html has no links; repeated rows are judged each; a
null page_id stays null; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import cut, join_counted, join_sized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  #: allow or block
    host: str
    path: str


# The rules of the query.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)
#: Hosts with one of these labels are blocked seeds.
BLOCKED_LABELS = r"(^|[.-])(casino|pills|bets|adult|porn|spam)([.-]|$)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; ties: the later text. Rules are a parameter of some hundred entries at most."""
    listed = F.array(*(F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules))
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, summed before they are shuffled."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.filter("html is not null").select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    dst = host_of(F.concat(F.lit("x:"), F.regexp_replace("link", r"^(?i)https?:", "")))
    return found.select("src", dst.alias("dst")).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, seed: str, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, every: int = 4) -> DataFrame:
    """(host, score): personalised PageRank from the column ``seed`` (its sum is the mass) along edges (src, dst, n).

    A host without links out keeps its mass to itself (it leaks).  Lineage is
    cut every ``every`` rounds; rounds end when no score moved by ``tolerance``.
    A host with many links has them dealt over salts, or scores are broadcast while the hosts are few.
    """
    shares = cut(edges.join(edges.groupBy("src").agg(F.sum("n").alias("total")), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    now = hosts.select("host", F.col(seed).alias("score"))
    if shares.isEmpty():
        return now
    known = hosts.count()
    for k in range(1, rounds + 1):
        moved = join_sized(shares, now.withColumnRenamed("host", "src"), "src", "inner", F.col("dst"), known).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = hosts.join(moved, F.col("host") == F.col("dst"), "left").select("host", ((1 - damping) * F.col(seed) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if k % every == 0:
            new = cut(new)
            was = now.withColumnRenamed("score", "was")
            if (new.join(was, "host").agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0) < tolerance:
                return new
        now = new
    return now


def host_verdicts(pages: DataFrame, rules: Sequence[UrlRule], blocked_labels: str, threshold: float, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(host, method): allow or block, for every host that is a page's or a link's.

    Trusted seeds: hosts most of whose pages a rule allows.  Blocked seeds:
    hosts most of whose pages a rule blocks, or with a blocked label.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(host.alias("host"), rule_of(host, path, rules)["verdict"].alias("v"))
    own = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("v") == "allow").alias("a"), F.count_if(F.col("v") == "block").alias("b"))
    edges = cut(host_edges(pages))
    every = own.unionByName(edges.select(F.col("dst").alias("host"), F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"))).groupBy("host").agg(*(F.sum(c).alias(c) for c in "nab"))
    bad = ((F.col("n") > 0) & (2 * F.col("b") > F.col("n"))) | F.rlike("host", F.lit(blocked_labels))
    good = (F.col("n") > 0) & (2 * F.col("a") > F.col("n")) & ~bad
    hosts = cut(every.select("host", bad.cast("double").alias("bad"), good.cast("double").alias("good")))
    trust = propagate(hosts, edges, "good", damping, rounds)
    distrust = propagate(hosts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), "bad", damping, rounds)
    both = trust.join(distrust.withColumnRenamed("score", "distrust"), "host")
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("score"))
    return cut(both.select("host", F.when(blocked, "block").otherwise("allow").alias("method")))


def judge(pages: DataFrame, rules: Sequence[UrlRule] = RULES, blocked_labels: str = BLOCKED_LABELS, threshold: float = 0.1, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, method (the link graph's view of the host)."""
    methods = host_verdicts(pages, rules, blocked_labels, threshold, damping, rounds)
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = join_counted(base, methods, "host", "left", F.struct("page_id", "path"))
    fit = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumn("_fit", fit).select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", "method", F.lit("allow")).alias("verdict"), F.coalesce("method", F.lit("allow")).alias("method"))
