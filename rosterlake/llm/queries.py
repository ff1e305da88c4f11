"""The queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import ann, chat, decontam, html_extract, jaccard, line_dedup, mixing, secrets, spelling, substring_dedup, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, as counts, digest and spans."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the contract's conversation -7, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(more)))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that every source has the same weight, in random order."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


@query
def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


#: Poisson replication of ``docs`` (doc_id, source, other columns), as op9 and the pipeline's last stage do it.
POISSON_SQL = """
rated AS (
  SELECT source, count(*) AS n, (SELECT count(*) FROM docs) / (SELECT count(*) FROM (SELECT DISTINCT source FROM docs)) / count(*) AS rate
  FROM docs GROUP BY source),
drawing AS (SELECT source, rate, greatest(ceil(rate / 8.0), 1)::INT AS draws FROM rated),
terms AS (
  SELECT source, draws, k, sum(exp(-rate / draws) * pow(rate / draws, k) / CASE WHEN k = 0 THEN 1 ELSE gamma(k + 1) END) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM drawing, (SELECT unnest(range(0, 49)) AS k)),
listed AS (SELECT source, draws, list(cdf ORDER BY k) AS cdf FROM terms GROUP BY source, draws),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0)))) AS copies
  FROM docs d JOIN listed l ON d.source IS NOT DISTINCT FROM l.source),
mixed AS (SELECT *, unnest(range(0, copies::BIGINT))::INT AS copy FROM drawn WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy, md5('17:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key FROM mixed"""

ORACLE["op9_source_mixing"] = "WITH docs AS (SELECT doc_id, text, lang, source, n_chars FROM documents)," + POISSON_SQL



def _ranks(name: str, seed: str, shares: str, rounds: int = 20) -> str:
    """CTEs <name>1 to <name>20: personalised PageRank from the column ``seed`` of hosts along ``shares``, a CTE for each round."""
    step = "{n}{k} AS (SELECT h.host, 0.15 * any_value(h.{seed}) + 0.85 * coalesce(sum(p.score * s.share), 0) AS score FROM hosts h LEFT JOIN {shares} s ON s.dst = h.host LEFT JOIN {n}{j} p ON p.host = s.src GROUP BY h.host)"
    return ",\n".join([f"{name}0 AS (SELECT host, {seed} AS score FROM hosts)", *(step.format(n=name, k=k, j=k - 1, seed=seed, shares=shares) for k in range(1, rounds + 1))])


ORACLE["op8_url_filter"] = (
    r"""
WITH base AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS html FROM pages),
parts AS (
  SELECT page_id, html, translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path
  FROM base),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
numbered AS (SELECT *, row_number() OVER () AS row FROM parts),
fits AS (
  SELECT row, page_id, host, path, max_by(verdict, length(rhost || rpath)) AS v, max_by(rhost || rpath, length(rhost || rpath)) AS rule
  FROM numbered LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) AS link FROM parts),
named AS (SELECT src, translate(regexp_extract('x:' || regexp_replace(link, '(?i)^https?:', ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM links),
edges AS (SELECT src, dst, count(*) AS n FROM named WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
own AS (
  SELECT host, sum(n) AS n, sum(a) AS a, sum(b) AS b FROM (
    SELECT host, 1 AS n, (v = 'allow' AND v IS NOT NULL)::INT AS a, (v = 'block' AND v IS NOT NULL)::INT AS b FROM fits UNION ALL SELECT dst, 0, 0, 0 FROM edges) GROUP BY host),
judged AS (SELECT host, n, a, (n > 0 AND 2 * b > n) OR regexp_matches(host, '(^|[.-])(casino|pills|bets|adult|porn|spam)([.-]|$)') AS bad FROM own),
hosts AS (SELECT host, bad::INT::DOUBLE AS bad, (n > 0 AND 2 * a > n AND NOT bad)::INT::DOUBLE AS good FROM judged),
onward AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges),
backward AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM edges),
"""
    + _ranks("trust", "good", "onward")
    + ",\n"
    + _ranks("distrust", "bad", "backward")
    + """,
methods AS (SELECT host, CASE WHEN d.score >= 0.1 AND d.score > t.score THEN 'block' ELSE 'allow' END AS method FROM trust20 t JOIN distrust20 d USING (host))
SELECT page_id, host, path, rule, coalesce(v, method) AS verdict, method FROM fits JOIN methods USING (host)"""
)


ORACLE["op10_nearest_vectors"] = """
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, embedding AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS s
  FROM usable q JOIN usable c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, s AS score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY s DESC, vec_id) AS rn FROM pairs) WHERE rn <= 20"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the CRF's marginals, with the offending offsets."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text by the CRF over its leaf blocks."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@query
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it covers the threshold by tiles."""
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle-set size and near-duplicate component."""
    return jaccard.join(_table(spark, sf_dir, "documents"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, dropped lines and digest of the text that is left."""
    kept = line_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, removed words and digest of the words that are left."""
    kept = substring_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = substring_dedup.joined_words(F.coalesce("text", F.lit("")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its form and root."""
    return spelling.variants(spelling.corpus_words(_table(spark, sf_dir, "documents")))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's first 16 whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


ORACLE["op11_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s FROM w),
h AS (SELECT doc_id, i, md5(s) AS h FROM n WHERE i <= n - 49),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, h.i + o AS i FROM h JOIN f USING (h), range(50) t(o) WHERE doc_id > first),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
all_ AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(all_.n, 0) AS n_words, coalesce(all_.n, 0) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN all_ USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: The checksum is a fold over bytes with the 256 entries of its table, made from its polynomial; near words are those that share a text with one code point left out.
ORACLE["op12_spelling_variants"] = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents),
each_ AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda r, b: xor(r >> 8, crc[(xor(r, b) & 255) + 1])), 4294967295) AS h FROM each_, t),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word UNION
  SELECT a.word, b.word, b.n FROM words a JOIN less b ON b.v = a.word UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON b.v = a.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(c.root, c.step) FROM chain c WHERE c.word = forms.word) AS root, n, n_near, form_n FROM forms"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's result over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
