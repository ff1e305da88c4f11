"""Registry queries of the search, the builders, the history and the upserts, with their DuckDB twins, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import text
from rosterlake.operators import changes, filters, history, linkage, quality, ranking, spatial, temporal, upsert
from rosterlake.plans import interpret, projection
from rosterlake.plans import search as searching
from rosterlake.plans.catalog import query, table
from rosterlake.sources import datasets

# --- joins ------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_brand, o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) AS pairs FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def crosswalk_counts(spark, sf_dir):
    """A many-to-many crosswalk fans keys out, so distinct keys are counted per place and kind."""
    wide = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_brand")
    wide = wide.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return wide.groupBy("p_brand", "o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("pairs"))


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (
SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_custkey = c_custkey AND s_nationkey = c_nationkey)""")
def source_conflict(spark, sf_dir):
    """Records that another source knows, but only at places that aren't the record's."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    near = o.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("o_custkey", "s_nationkey").distinct()
    near = near.join(c.select("c_custkey", "c_nationkey"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).select("o_custkey")
    return quality.conflict(c, o, {"c_custkey": "o_custkey"}, near).select("c_custkey")


@query(r"""
WITH t AS (SELECT c_custkey AS npi, 'N' || c_nationkey AS st, 'L-' || (c_custkey * 7) || CASE WHEN c_custkey % 3 = 0 THEN '/' || c_custkey ELSE '' END AS no, 'Fam' || (c_custkey % 40) || CASE WHEN c_custkey % 5 = 0 THEN ' Jr' ELSE '' END AS last FROM customer),
r AS (SELECT o_orderkey AS id, 'N' || (o_orderkey % 25) AS st, CASE WHEN o_orderkey % 2 = 0 THEN '000' || (o_custkey * 7) ELSE 'X' || o_custkey END AS no, CASE WHEN o_orderkey % 4 > 0 THEN 'Fam' || (o_custkey % 40) END AS last, 'Ann,Fam' || (o_custkey % 40) || ' B' AS full_name FROM orders),
tk AS (SELECT npi, st, last, nullif(ltrim(regexp_replace(no, '[^0-9]', '', 'g'), '0'), '') AS a, nullif(ltrim(regexp_extract(no, '([0-9]+)[^0-9]*$', 1), '0'), '') AS b FROM t),
rk AS (SELECT *, nullif(ltrim(regexp_replace(no, '[^0-9]', '', 'g'), '0'), '') AS a, nullif(ltrim(regexp_extract(no, '([0-9]+)[^0-9]*$', 1), '0'), '') AS b FROM r)
SELECT DISTINCT npi, id FROM tk JOIN rk ON tk.st = rk.st AND (tk.a = rk.a OR tk.b = rk.b)
WHERE CASE WHEN rk.last IS NOT NULL THEN tk.last = rk.last OR split_part(tk.last, ' ', 1) = split_part(rk.last, ' ', 1) ELSE contains(' ' || replace(full_name, ',', ' ') || ' ', ' ' || tk.last || ' ') END""")
def license_match(spark, sf_dir):
    """Licences by all digits or the last run of them, for the same person."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    npi = F.col("c_custkey")
    listed = c.select(npi.alias("npi"), F.concat(F.lit("N"), "c_nationkey").alias("license_state"), F.concat(F.lit("L-"), npi * 7, F.when(npi % 3 == 0, F.concat(F.lit("/"), npi)).otherwise("")).alias("license_no"))
    people = c.select(npi.alias("npi"), F.concat(F.lit("Fam"), npi % 40, F.when(npi % 5 == 0, " Jr").otherwise("")).alias("last_name"))
    key, family = F.col("o_orderkey"), F.concat(F.lit("Fam"), F.col("o_custkey") % 40)
    number = F.when(key % 2 == 0, F.concat(F.lit("000"), F.col("o_custkey") * 7)).otherwise(F.concat(F.lit("X"), "o_custkey"))
    published = o.select(key.alias("id"), F.concat(F.lit("N"), key % 25).alias("state"), number.alias("license_number"), F.when(key % 4 > 0, family).alias("last_name"), F.concat(F.lit("Ann,"), family, F.lit(" B")).alias("full_name"))
    return linkage.license_matches(listed, people, published)


# --- groups and quality -----------------------------------------------------------------------------------------------


def _orgs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    blank = F.lit(None).cast("string")
    return c.select(
        F.lpad(k.cast("string"), 10, "0").alias("npi"), F.when(k % 11 > 0, F.concat(F.lit("NAME "), F.floor(k / 4) % 90)).alias("name_key"), F.when(k % 17 > 0, F.lpad((k % 7).cast("string"), 5, "0")).alias("zip5"),
        F.when(k % 5 == 0, "").otherwise((F.floor(k / 9) % 3).cast("string")).alias("number"), F.when(k % 13 > 0, "MAIN ST").alias("street"), F.concat(F.lit("T"), k % 3).alias("taxonomy"),
        F.when(k % 19 == 0, F.array(F.concat(F.lit("C"), F.floor(k / 60)))).otherwise(F.array().cast("array<string>")).alias("ccns"), F.when(k % 23 == 0, F.array(F.concat(F.lit("P"), F.floor(k / 120)))).otherwise(F.array().cast("array<string>")).alias("pac_ids"),
        F.when(k % 29 == 0, F.concat(F.lit("NAME "), F.floor(k / 30) % 90)).otherwise(blank).alias("parent_key"), F.when(k % 31 == 0, F.concat(F.lit("TIN"), F.floor(k / 90))).otherwise(blank).alias("parent_tin"), "c_acctbal", "c_mktsegment",
    )


@query("""
WITH RECURSIVE o AS (SELECT lpad(k::VARCHAR, 10, '0') AS npi, CASE WHEN k % 11 > 0 THEN 'NAME ' || ((k // 4) % 90) END AS name_key, CASE WHEN k % 17 > 0 THEN lpad((k % 7)::VARCHAR, 5, '0') END AS zip5, CASE WHEN k % 5 = 0 THEN '' ELSE ((k // 9) % 3)::VARCHAR END AS number,
CASE WHEN k % 13 > 0 THEN 'MAIN ST' END AS street, 'T' || (k % 3) AS taxonomy, CASE WHEN k % 19 = 0 THEN 'C' || (k // 60) END AS ccn, CASE WHEN k % 23 = 0 THEN 'P' || (k // 120) END AS pac, CASE WHEN k % 29 = 0 THEN 'NAME ' || ((k // 30) % 90) END AS parent_key, CASE WHEN k % 31 = 0 THEN 'TIN' || (k // 90) END AS parent_tin
FROM (SELECT c_custkey AS k FROM customer)),
lone AS (SELECT name_key, zip5, street FROM o WHERE name_key IS NOT NULL AND street IS NOT NULL AND zip5 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT CASE WHEN number <> '' THEN number END) = 1 AND bool_or(number = '')),
pk AS (SELECT DISTINCT zip5, parent_key AS key FROM o WHERE zip5 IS NOT NULL AND parent_key IS NOT NULL),
parent AS (SELECT npi, zip5, number, street, taxonomy, parent_key AS key FROM o WHERE zip5 IS NOT NULL AND parent_key IS NOT NULL
UNION ALL SELECT o.npi, o.zip5, number, street, taxonomy, name_key FROM o JOIN pk ON pk.zip5 = o.zip5 AND pk.key = o.name_key WHERE o.name_key IS DISTINCT FROM o.parent_key),
e AS (
SELECT a.npi AS a, b.npi AS b, 1 AS tie FROM o a JOIN o b ON a.npi <> b.npi AND a.name_key = b.name_key AND a.zip5 = b.zip5 AND a.street = b.street AND a.number = b.number
UNION SELECT a.npi, b.npi, 1 FROM lone l JOIN o a ON a.name_key = l.name_key AND a.zip5 = l.zip5 AND a.street = l.street JOIN o b ON b.name_key = l.name_key AND b.zip5 = l.zip5 AND b.street = l.street AND a.npi <> b.npi
UNION SELECT a.npi, b.npi, 2 FROM o a JOIN o b ON a.npi <> b.npi AND a.zip5 = b.zip5 AND a.ccn = b.ccn
UNION SELECT a.npi, b.npi, 4 FROM o a JOIN o b ON a.npi <> b.npi AND a.zip5 = b.zip5 AND a.pac = b.pac AND ((a.street = b.street AND a.number = b.number) OR a.taxonomy <> b.taxonomy)
UNION SELECT a.npi, b.npi, 8 FROM parent a JOIN parent b ON a.npi <> b.npi AND a.zip5 = b.zip5 AND a.key = b.key AND ((a.street = b.street AND a.number = b.number) OR a.taxonomy <> b.taxonomy)
UNION SELECT a.npi, b.npi, 8 FROM o a JOIN o b ON a.npi <> b.npi AND a.zip5 = b.zip5 AND a.parent_tin = b.parent_tin AND ((a.street = b.street AND a.number = b.number) OR a.taxonomy <> b.taxonomy)),
reach AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.seen),
g AS (SELECT id, min(seen) AS grp FROM reach GROUP BY id), t AS (SELECT a, bit_or(tie) AS ties FROM e GROUP BY a)
SELECT id AS npi, first_value(id) OVER w AS main_npi, count(*) OVER (PARTITION BY grp) AS members, first_value(id) OVER w = id AS is_main, ties::INTEGER AS ties
FROM g JOIN t ON t.a = id JOIN customer ON c_custkey = id::BIGINT WINDOW w AS (PARTITION BY grp ORDER BY (c_mktsegment = 'BUILDING')::INT DESC, c_acctbal DESC, id)""")
def organisation_groups(spark, sf_dir):
    """Organisations tied by name and address, facility, enrollment and parent, with their main number."""
    return linkage.organisation_groups(_orgs(spark, sf_dir), (F.col("c_mktsegment") == "BUILDING").cast("int"), "c_acctbal")


@query("""
WITH r AS (SELECT c_custkey, ((c_custkey * 7919) % 131072)::INTEGER AS r FROM customer)
SELECT c_custkey, r AS reasons, CASE WHEN (r & 6) = 6 OR (r & 66048) <> 0 OR ((r & 12288) <> 0 AND (r & 4) <> 0) THEN 3 WHEN ((r & 4) <> 0 AND (r & 32769) <> 0) OR (r & 29176) <> 0 THEN 2 ELSE 1 END::INTEGER AS label FROM r""")
def quality_classes(spark, sf_dir):
    """The label of seventeen reasons."""
    reasons = ((F.col("c_custkey") * 7919) % 131072).cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", reasons.alias("reasons"), quality.classify(reasons).alias("label"))


@query("""
SELECT c_custkey, (CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 1 ELSE 0 END | CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 8 ELSE 0 END | CASE WHEN c_acctbal > 9000 THEN 4096 ELSE 0 END)::INTEGER AS activity
FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'))""")
def practice_signs(spark, sf_dir):
    """Signs of practice of several sources as bits, one shuffle for all."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return quality.signs({"billing": [o.filter("o_orderstatus = 'F'")], "enrollment": [o.filter("o_orderpriority = '1-URGENT'")], "equipment": [table(spark, sf_dir, "customer").filter("c_acctbal > 9000")]}, "c_custkey")


@query("""
WITH q AS (SELECT c_custkey AS npi, c_nationkey AS main_npi, c_acctbal > 9900 AS is_main, (c_custkey % 3 + 1) AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS activity,
  CASE WHEN c_custkey % 11 > 0 THEN DATE '2018-01-01' + (c_custkey % 1700)::INTEGER END AS issued, CASE WHEN c_custkey % 7 > 0 THEN DATE '2018-01-01' + (c_custkey * 3 % 1700)::INTEGER END AS updated FROM customer),
a AS (SELECT main_npi, coalesce(max(CASE WHEN is_main THEN npi END), min(npi)) AS other_npi FROM q WHERE label = 1 AND activity <> 0 GROUP BY 1)
SELECT npi, other_npi FROM q JOIN a USING (main_npi) WHERE activity = 0 AND other_npi <> npi AND greatest(coalesce(issued, DATE '1900-01-01'), coalesce(updated, DATE '1900-01-01')) < DATE '2022-06-01' - INTERVAL 2 YEAR""")
def other_current(spark, sf_dir):
    """Members without signs, neither issued nor updated for two years, whose organisation has a current number."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    labels = c.select(k.alias("npi"), (k % 3 + 1).alias("label"), F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).alias("activity"))
    day = lambda n: F.date_add(F.lit("2018-01-01").cast("date"), (n % 1700).cast("int"))
    ages = c.select(k.alias("npi"), F.when(k % 11 > 0, day(k)).alias("enumeration_date"), F.when(k % 7 > 0, day(k * 3)).alias("last_update_date"))
    return quality.other_current(labels, c.select(k.alias("npi"), F.col("c_nationkey").alias("main_npi"), (F.col("c_acctbal") > 9900).alias("is_main")), ages, F.lit("2022-06-01").cast("date"))


@query("""
WITH l AS (SELECT o_custkey % 400 AS addr_key, o_custkey AS npi, CASE WHEN o_orderkey % 31 = 0 THEN '1 Main St Suite 4' ELSE '1 Main St' END AS a FROM orders),
s AS (SELECT addr_key, bool_or(regexp_matches(upper(a), '\\b(STE|SUITE|FL|FLR|FLOOR|BLDG|BUILDING|RM|ROOM)\\b')) AS suite, count(DISTINCT npi) AS providers, bool_or(npi % 2 = 0) AS org FROM l GROUP BY 1),
x AS (SELECT s.*, CASE WHEN addr_key % 3 = 0 THEN 'Residential' WHEN addr_key % 3 = 1 THEN 'Commercial' END AS occ, CASE WHEN addr_key % 9 = 0 THEN 'Nursing Home' END AS prim, suite OR addr_key % 5 = 0 OR providers >= 5 OR (org AND providers >= 3) AS business FROM s)
SELECT addr_key, CASE WHEN (occ = 'Residential' AND prim IS NOT NULL) OR business THEN 'commercial' WHEN occ = 'Residential' THEN 'residential' WHEN occ IS NULL THEN 'unknown' ELSE 'commercial' END AS building_type, suite, providers, org, business FROM x""")
def address_types(spark, sf_dir):
    """What kind of building a practice address is."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_custkey") % 400
    at = o.select(key.alias("addr_key"), F.col("o_custkey").alias("npi"), F.lit("1 Main St").alias("address1"), F.when(F.col("o_orderkey") % 31 == 0, "Suite 4").alias("address2"))
    who = o.select(F.col("o_custkey").alias("npi"), F.when(F.col("o_custkey") % 2 == 0, 2).otherwise(1).alias("entity_type")).distinct()
    keys = o.select(key.alias("addr_key")).distinct()
    k = F.col("addr_key")
    buildings = keys.select("addr_key", F.when(k % 3 == 0, "Residential").when(k % 3 == 1, "Commercial").alias("occ_cls"), F.when(k % 9 == 0, "Nursing Home").alias("prim_occ"))
    return quality.address_types(at, who, buildings, keys.filter(k % 5 == 0).withColumn("source", F.lit("place")))


# --- history ----------------------------------------------------------------------------------------------------------

_HISTORY_SQL = """
WITH x AS (SELECT o_custkey AS k, CASE WHEN o_orderdate < '1997-07-01' THEN 1996 ELSE 1997 END AS y, CASE WHEN o_orderstatus = 'P' THEN 'deactivated' ELSE 'active' END AS status, o_orderpriority AS place, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 END AS extra, o_orderdate AS d, o_orderkey AS o FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY d DESC, o DESC) AS rn FROM x) WHERE rn = 1),
a AS (SELECT * FROM l WHERE y = 1996), b AS (SELECT * FROM l WHERE y = 1997),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS old, b.k IS NOT NULL AS new, a.status AS os, b.status AS ns, a.place AS op, b.place AS np, a.extra AS oe, CASE WHEN b.extra IS NULL AND a.status = 'active' AND b.status = 'active' THEN a.extra ELSE b.extra END AS ne FROM a FULL JOIN b ON a.k = b.k),
c AS (SELECT *, CASE WHEN NOT old THEN 'new' WHEN NOT new THEN CASE WHEN os = 'active' THEN 'gone' END WHEN os IS DISTINCT FROM ns OR op IS DISTINCT FROM np OR oe IS DISTINCT FROM ne THEN 'changed' END AS change FROM j),
r AS (SELECT k, CASE WHEN change IS NULL THEN os WHEN change = 'gone' THEN 'gone' ELSE ns END AS status, CASE WHEN change IS NULL THEN op WHEN change = 'gone' THEN NULL ELSE np END AS place, CASE WHEN change IS NULL THEN oe WHEN change = 'gone' THEN NULL ELSE ne END AS extra,
CASE WHEN change IS NULL THEN DATE '1996-12-31' ELSE DATE '1997-12-31' END AS from_period, change, os AS was_status,
coalesce(change = 'changed' AND os = 'active' AND ns = 'active' AND op IS DISTINCT FROM np, false) AS moved, coalesce(change = 'changed' AND os = 'active' AND ns = 'active' AND oe IS DISTINCT FROM ne, false) AS special_changed,
coalesce(os = 'active' AND change IS NOT NULL AND coalesce(ns, '') <> 'active', false) AS deactivated, coalesce(old AND os <> 'active' AND change IS NOT NULL AND ns = 'active', false) AS reactivated FROM c)
"""


def _applied(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderdate") < "1997-07-01", 1996).otherwise(1997).alias("y"), F.when(F.col("o_orderstatus") == "P", history.DEACTIVATED).otherwise(history.ACTIVE).alias("status"), F.col("o_orderpriority").alias("place"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 3).alias("extra"), "o_orderdate", "o_orderkey")
    last = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    before, after = (history.last_listed(rows.filter(F.col("y") == y), "k", last) for y in (1996, 1997))
    now = before.withColumn("from_period", F.lit("1996-12-31").cast("date"))
    return history.apply_period(now, after, "k", ["place", "extra"], F.lit("1997-12-31").cast("date"), carried=["extra"], places=["place"], special="extra")


@query(_HISTORY_SQL + "SELECT * FROM r")
def history_apply(spark, sf_dir):
    """A file applied to the open versions: new, changed, gone and reactivated keys, the last of repeated rows, carried values."""
    return _applied(spark, sf_dir)


@query(_HISTORY_SQL + """SELECT count(*) FILTER (change IS NOT NULL) AS versions, count(*) FILTER (change = 'new') AS new, count(*) FILTER (moved) AS moved, count(*) FILTER (special_changed) AS special_changed, count(*) FILTER (deactivated) AS deactivated,
count(*) FILTER (change = 'gone') AS gone, count(*) FILTER (reactivated) AS reactivated, count(*) FILTER (status = 'active') AS active FROM r""")
def history_summary(spark, sf_dir):
    """What a file changed, in counts."""
    return history.period_summary(_applied(spark, sf_dir))


@query("""
WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS e FROM orders WHERE o_orderstatus <> 'P'),
t AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS t FROM orders WHERE o_orderstatus = 'P'),
h AS (SELECT p.*, (SELECT min(t) FROM t WHERE k = o_custkey AND t > s AND (e IS NULL OR t <= e + 31)) AS terminated FROM p)
SELECT o_orderkey, o_custkey, o_totalprice, s, CASE WHEN terminated IS NOT NULL THEN least(coalesce(e, terminated - 1), terminated - 1) ELSE e END AS e, terminated FROM h""")
def cut_at_termination(spark, sf_dir):
    """Periods ended by the first termination inside or soon after them."""
    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders")
    p = o.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_totalprice", day.alias("s"), F.when(F.col("o_orderkey") % 4 > 0, F.date_add(day, (F.col("o_orderkey") % 90).cast("int"))).alias("e"))
    return temporal.cut_at_termination(p, o.filter("o_orderstatus = 'P'").select("o_custkey", day.alias("t")), "o_custkey", "s", "e", "t")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS known FROM events""")
def carry_forward(spark, sf_dir):
    """The last known value where it is missing."""
    e = table(spark, sf_dir, "events").withColumn("known", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return temporal.carry_forward(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], "known").select("event_id", "user_id", "known")


# --- upserts ----------------------------------------------------------------------------------------------------------


def _halves(spark, sf_dir):
    """The rows before a day, and from it on."""
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderdate") < "1997-07-01"), o.filter(F.col("o_orderdate") >= "1997-07-01")


@query("""
WITH x AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 4 END AS bits FROM orders) SELECT o_custkey, bit_or(bits)::INTEGER AS bits FROM x GROUP BY 1""")
def or_bits_upsert(spark, sf_dir):
    """Bits of a change ORed to those of the table."""
    bits = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(4)
    old, new = (df.groupBy("o_custkey").agg(F.bit_or(bits).alias("bits")) for df in _halves(spark, sf_dir))
    return upsert.or_bits(old, new, ["o_custkey"], "bits")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def add_counts_upsert(spark, sf_dir):
    """Counters with a batch's counts added."""
    old, new = (df.groupBy("o_custkey").agg(F.count("*").alias("n")) for df in _halves(spark, sf_dir))
    return upsert.add_counts(old, new, ["o_custkey"], "n")


@query("""
WITH a AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate < '1997-07-01' GROUP BY 1), b AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate >= '1997-07-01' GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""")
def insert_ignore(spark, sf_dir):
    """Rows whose key is new are added, the first of those that repeat one."""
    old, new = _halves(spark, sf_dir)
    return upsert.insert_ignore(old.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")), new.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")])


@query("""
WITH keys AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12), a AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate < '1997-07-01'), b AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate >= '1997-07-01')
SELECT * FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM keys) UNION ALL SELECT * FROM b WHERE o_custkey IN (SELECT o_custkey FROM keys)""")
def replace_keys(spark, sf_dir):
    """All rows of the changed keys replaced."""
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12").select("o_custkey")
    old, new = (df.select("o_custkey", "o_orderkey") for df in _halves(spark, sf_dir))
    return upsert.replace_keys(old, new, keys, ["o_custkey"])


# --- text -------------------------------------------------------------------------------------------------------------


@query(r"""
WITH x AS (SELECT c_custkey, lpad((1000000000 + c_custkey * 7)::VARCHAR, 10, '0') AS npi FROM customer), d AS (SELECT c_custkey, npi, [CAST(substr('80840' || npi, i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END FOR i IN range(1, 16)] AS v FROM x)
SELECT c_custkey, npi, list_sum([CASE WHEN q > 9 THEN q - 9 ELSE q END FOR q IN v]) % 10 = 0 AS sound FROM d""")
def check_digits(spark, sf_dir):
    """Registry numbers whose check digit holds."""
    npi = F.lpad((F.lit(1000000000) + F.col("c_custkey") * 7).cast("string"), 10, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", npi.alias("npi"), text.check_digit_ok(npi).alias("sound"))


@query("""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a FROM part), v AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS b FROM part), x AS (SELECT a, b, upper(a) AS s, upper(b) AS t FROM w CROSS JOIN v)
SELECT a, b, least(len([i FOR i IN range(1, least(length(s), length(t)) + 1) IF s[i] <> t[i]]) + 2 * abs(length(s) - length(t)) + 2 * len([c FOR c IN list_distinct(string_split(s, '')) IF NOT contains(t, c)]), 20)::INTEGER AS distance FROM x""")
def name_distances(spark, sf_dir):
    """How far names are from each other."""
    w = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w"))
    a, b = w.select(F.col("w")[0].alias("a")).distinct(), w.select(F.col("w")[1].alias("b")).distinct()
    return a.crossJoin(b).select("a", "b", text.name_distance(F.col("a"), F.col("b")).alias("distance"))


@query("""
WITH x AS (SELECT p_partkey, string_split(upper(p_name), ' ') AS a, string_split(upper(p_type || ' clinic ' || split_part(p_name, ' ', 1)), ' ') AS b FROM part),
w AS (SELECT p_partkey, list_filter(list_distinct(a), lambda x: length(x) > 1 AND x <> 'NEW') AS a, list_filter(list_distinct(b), lambda x: length(x) > 1 AND x NOT IN ('CLINIC', 'NEW')) AS b FROM x)
SELECT p_partkey, len(list_intersect(a, b)) >= 1 AND 2 * len(list_intersect(a, b)) >= least(len(a), len(b)) AS same FROM w""")
def same_business(spark, sf_dir):
    """Whether two names are the same business by their distinctive words."""
    other = F.concat_ws(" ", "p_type", F.lit("clinic"), F.split("p_name", " ")[0])
    return table(spark, sf_dir, "part").select("p_partkey", text.shared_word_match(F.col("p_name"), other).alias("same"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lpad((p_partkey % 9999)::VARCHAR, 5, '0') || lpad((p_size)::VARCHAR, 4, '0') ELSE left(lpad((p_partkey * 1001)::VARCHAR, 11, '0'), 9) END AS ndc FROM part""")
def ndc_keys(spark, sf_dir):
    """Drug codes as labeler and product (scalar NDC keys)."""
    k = F.col("p_partkey")
    code = F.when(k % 2 == 0, F.concat_ws("-", (k % 9999).cast("string"), F.col("p_size").cast("string"), F.lit("01"))).otherwise(F.lpad((k * 1001).cast("string"), 11, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", text.ndc_key(code).alias("ndc"))


@query("""
SELECT c_custkey, regexp_matches(a, '(^|[^A-Z])(P[ .]*O[ .]*BOX|POST OFFICE BOX)([^A-Z]|$)') AS box, regexp_matches(s, 'INACTIVE|EXPIRED|DECEASED') AS inactive, regexp_matches(s, '^(ACTIVE|CURRENT)') AS in_force
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'P.O. BOX 7' WHEN 1 THEN 'PO BOX 7' WHEN 2 THEN '7 BOXWOOD ST' ELSE '' END AS a, CASE c_custkey % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'EXPIRED 2020' WHEN 2 THEN 'INACTIVE' WHEN 3 THEN 'CURRENT' ELSE '' END AS s FROM customer)""")
def status_patterns(spark, sf_dir):
    """Post-office boxes and statuses by pattern."""
    k = F.col("c_custkey")
    a = F.when(k % 4 == 0, "p.o. box 7").when(k % 4 == 1, "PO Box 7").when(k % 4 == 2, "7 Boxwood St")
    s = F.when(k % 5 == 0, "Active").when(k % 5 == 1, "expired 2020").when(k % 5 == 2, "Inactive").when(k % 5 == 3, "Current")
    return table(spark, sf_dir, "customer").select("c_custkey", filters.is_po_box(a).alias("box"), filters.is_inactive(s).alias("inactive"), filters.is_in_force(s).alias("in_force"))


@query("""
SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name || ' ' || n_name), 'supplier') AND contains(lower(s_name || ' ' || n_name), 'nation_1') AND s_acctbal BETWEEN 100 AND 9000""")
def directory_words(spark, sf_dir):
    """A directory's rows by all words asked and bounds."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return filters.directory(s, "Supplier NATION_1", "s_suppkey", "s_name", ("s_name", "n_name"), least={"s_acctbal": 100}, most={"s_acctbal": 9000}).select("s_suppkey", "s_name", "n_name")


# --- projection and search --------------------------------------------------------------------------------------------


def _raw(spark, sf_dir):
    """A wide registry record made of each customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    day = lambda n: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")), "MM/dd/yyyy")
    plain = {
        "NPI": F.lpad(k.cast("string"), 10, "0"), "Entity_Type_Code": F.when(k % 9 == 0, "2").when(k % 50 == 1, "").otherwise("1"), "Provider_Last_Name_Legal_Name": F.concat(F.lit(" Fam"), k % 97), "Provider_First_Name": F.concat(F.lit("Given"), k % 13),
        "Provider_Middle_Name": F.lit(""), "Provider_Organization_Name_Legal_Business_Name": F.when(k % 9 == 0, F.col("c_name")), "Provider_Credential_Text": F.when(k % 4 == 2, "M.D."), "Provider_Gender_Code": F.when(k % 2 == 0, "F").otherwise("M"),
        "Provider_Enumeration_Date": day(k % 900), "Last_Update_Date": day(k % 1500), "NPI_Deactivation_Date": F.when(k % 21 == 0, day(k % 300)), "NPI_Reactivation_Date": F.when(k % 42 == 0, day(k % 300 + 5)),
    }
    for i in range(1, projection.TAXONOMY_SLOTS + 1):
        plain[f"Healthcare_Provider_Taxonomy_Code_{i}"] = F.when(F.lit(i) <= k % 4, F.concat(F.lit(f"T{i}"), k % 5)).otherwise("")
        plain[f"Provider_License_Number_{i}"] = F.when(F.lit(i) <= k % 3, F.concat(F.lit("L"), k))
        plain[f"Provider_License_Number_State_Code_{i}"] = F.when(k % 2 == 0, "NULL").otherwise("NY")
        plain[f"Healthcare_Provider_Primary_Taxonomy_Switch_{i}"] = F.when(F.lit(i) == k % 3, "Y").otherwise("N")
    return c.select(*(v.alias(n) for n, v in plain.items()))


_RAW_SQL = """
WITH r AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 10, '0') AS npi, CASE WHEN c_custkey % 9 = 0 THEN 2 WHEN c_custkey % 50 = 1 THEN NULL ELSE 1 END AS entity, DATE '2020-01-01' + (c_custkey % 300)::INTEGER AS off, c_name, c_nationkey, c_mktsegment FROM customer),
p AS (SELECT *, 'Fam' || (k % 97) AS last_name, 'Given' || (k % 13) AS first_name, CASE WHEN k % 9 = 0 THEN c_name END AS org_name FROM r WHERE entity IS NOT NULL AND NOT (k % 21 = 0 AND k % 42 <> 0)),
t AS (SELECT k, npi, i::INTEGER AS slot, 'T' || i || (k % 5) AS taxonomy_code, i = k % 3 AS is_primary, CASE WHEN i <= k % 3 THEN 'L' || k END AS license_no, CASE WHEN k % 2 = 0 THEN NULL ELSE 'NY' END AS license_state FROM p, (SELECT unnest(range(1, 16)) AS i) WHERE i <= k % 4),
f AS (SELECT npi, entity AS entity_type, last_name, first_name, NULL::VARCHAR AS middle_name, org_name, CASE WHEN entity = 1 THEN last_name || ', ' || first_name ELSE org_name END AS sort_name, CASE WHEN k % 4 = 2 THEN 'M.D.' END AS credential, CASE WHEN k % 4 = 2 THEN 'MD' END AS credential_key,
CASE WHEN entity = 1 THEN CASE WHEN k % 2 = 0 THEN 'F' ELSE 'M' END END AS gender, coalesce(CASE WHEN k % 3 > 0 AND k % 3 <= k % 4 THEN 'T' || (k % 3) || (k % 5) END, CASE WHEN k % 4 > 0 THEN 'T1' || (k % 5) END) AS primary_taxonomy_code,
DATE '2020-01-01' + (k % 900)::INTEGER AS enumeration_date, DATE '2020-01-01' + (k % 1500)::INTEGER AS last_update_date, k, c_nationkey, c_mktsegment FROM p)
"""


@query(_RAW_SQL + "SELECT npi, entity_type, last_name, first_name, middle_name, org_name, sort_name, credential, credential_key, gender, primary_taxonomy_code, enumeration_date, last_update_date FROM f")
def projected_providers(spark, sf_dir):
    """The wide record as the provider table."""
    return projection.providers(_raw(spark, sf_dir)).drop("last_phonetic", "first_phonetic")


@query(_RAW_SQL + "SELECT npi, slot, taxonomy_code, is_primary, license_no, license_state FROM t")
def projected_taxonomies(spark, sf_dir):
    """Fifteen slots as rows."""
    return projection.taxonomies(_raw(spark, sf_dir))


def _tables(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    npi = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    k = F.col("c_custkey")
    location = c.select(npi.alias("npi"), F.concat(F.lit("S"), "c_nationkey").alias("state"), F.col("c_mktsegment").alias("city"), F.lpad((k % 50).cast("string"), 5, "0").alias("zip5"), (k % 700).cast("string").alias("addr_key"))
    ordered = o.select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("npi"), "o_orderstatus", "o_orderkey")
    keys = location.select("addr_key").distinct()
    a = F.col("addr_key").cast("int")
    return searching.Tables(
        projection.providers(raw), projection.taxonomies(raw), location, exclusion=ordered.filter("o_orderkey % 40 = 0"), enrollment=ordered.filter("o_orderstatus = 'F'"),
        order_referring=c.select(npi.alias("npi"), (k % 2 == 0).alias("part_b")), clinician=c.select(npi.alias("npi"), (1960 + k % 60).alias("graduation_year"), (k % 5 > 0).alias("accepts_assignment"), (k % 7 == 0).alias("telehealth")),
        address_type=keys.select("addr_key", F.when(a % 3 == 0, "residential").otherwise("commercial").alias("building_type")), address_point=keys.select("addr_key", (a % 90).cast("double").alias("lat"), (a % 170).cast("double").alias("lon")),
    )


_FOUND_SQL = _RAW_SQL + """,
o AS (SELECT lpad(o_custkey::VARCHAR, 10, '0') AS npi, o_orderstatus, o_orderkey FROM orders),
m AS (SELECT f.* FROM f WHERE entity_type = 1 AND starts_with(lower(last_name), 'fam') AND enumeration_date >= DATE '2022-06-01' - 800 AND EXISTS (SELECT 1 FROM t WHERE t.npi = f.npi AND taxonomy_code IN ('T10', 'T11', 'T22'))
AND (k % 700) % 3 <> 0 AND (k % 700) % 90 BETWEEN 5 AND 80 AND (k % 700) % 170 BETWEEN 10 AND 160 AND 'S' || c_nationkey IN ('S3', 'S4', 'S5', 'S6', 'S7') AND k % 2 = 0 AND k % 5 > 0 AND 1960 + k % 60 <= 2022 - 10
AND NOT EXISTS (SELECT 1 FROM o WHERE o.npi = f.npi AND o_orderkey % 40 = 0) AND EXISTS (SELECT 1 FROM o WHERE o.npi = f.npi AND o_orderstatus = 'F'))
"""


def _filter():
    return searching.SearchFilter(
        taxonomy_codes=["T10", "T11", "T22"], state=[f"S{n}" for n in (3, 4, 5, 6, 7)], bbox=(10.0, 5.0, 160.0, 80.0), address_type="commercial", last_name="Fam", entity_type=1, order_refer="part_b", accepts_assignment=True,
        medicare_active=True, min_years=10, excluded=False, new_within_days=800,
    )


@query(_FOUND_SQL + "SELECT npi, sort_name, enumeration_date FROM m")
def search_all(spark, sf_dir):
    """Every provider that meets a filter of a dozen conditions, for five states."""
    return searching.search_all(_tables(spark, sf_dir), _filter(), "2022-06-01").select("npi", "sort_name", "enumeration_date")


@query(_RAW_SQL + """
, s AS (SELECT npi, sort_name, last_update_date, count(*) OVER () AS total FROM f WHERE entity_type = 1 AND gender = 'F' AND credential_key LIKE 'MD%' AND EXISTS (SELECT 1 FROM t WHERE t.npi = f.npi AND taxonomy_code = 'T10'))
SELECT npi, sort_name, last_update_date, total FROM s ORDER BY last_update_date DESC, npi DESC LIMIT 20 OFFSET 20""")
def search_page(spark, sf_dir):
    """The second page of a search by newest update."""
    f = searching.SearchFilter(taxonomy_codes=["T10"], gender="F", entity_type=1, credential="M.D.", sort="-updated", page=2, page_size=20)
    return searching.search(_tables(spark, sf_dir), f, "2022-06-01").select("npi", "sort_name", "last_update_date", "total")


# --- datasets ---------------------------------------------------------------------------------------------------------


def _payments(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    blank = F.lit(None).cast("string")
    slots = {f"{c}{n}": blank for n in range(3, 6) for c in datasets.SLOT_COLUMNS.values()}
    second = {"product2": F.when(F.col("l_tax") > 0.05, F.col("p_type")), "product_kind2": F.lit("Device"), "product_category2": blank, "ndc2": blank, "device_id2": blank}
    return i.select(
        F.col("l_suppkey").cast("string").alias("npi"), (F.col("l_partkey") % 30).cast("string").alias("company_id"), F.concat(F.lit("Payer "), F.col("l_partkey") % 30).alias("payer"), F.col("l_extendedprice").alias("amount"), F.nullif(F.col("l_returnflag"), F.lit("A")).alias("nature"),
        F.col("p_name").alias("product"), F.when(F.col("p_size") > 25, "Drug").otherwise("Device").alias("product_kind"), F.col("p_brand").alias("product_category"), F.when(F.col("p_size") > 40, F.col("p_partkey").cast("string")).alias("ndc"), blank.alias("device_id"),
        *(v.alias(n) for n, v in {**second, **slots}.items()),
    )


_PAYMENTS_SQL = """
WITH r AS (SELECT l_suppkey::VARCHAR AS npi, (l_partkey % 30)::VARCHAR AS company_id, 'Payer ' || (l_partkey % 30) AS payer, l_extendedprice AS amount, nullif(l_returnflag, 'A') AS nature, p_name, CASE WHEN p_size > 25 THEN 'Drug' ELSE 'Device' END AS kind, p_brand, CASE WHEN p_size > 40 THEN p_partkey::VARCHAR END AS ndc, CASE WHEN l_tax > 0.05 THEN p_type END AS p2
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
x AS (SELECT npi, company_id, nature, amount, p_name AS name, kind, p_brand AS category, ndc FROM r WHERE trim(p_name) <> '' UNION ALL SELECT npi, company_id, nature, amount, p2, 'Device', NULL, NULL FROM r WHERE trim(p2) <> ''),
s AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM x),
g AS (SELECT s_suppkey::VARCHAR AS npi, 'N' || s_nationkey AS specialty FROM supplier)
"""


def _paid(spark, sf_dir):
    registry = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("npi"), F.concat(F.lit("N"), "s_nationkey").alias("specialty"))
    return datasets.open_payments({"main": _payments(spark, sf_dir), "provider": registry})


@query(_PAYMENTS_SQL + "SELECT npi, round(sum(coalesce(amount, 0)), 2) AS total_amount, count(*) AS records, count(DISTINCT payer) AS payers FROM r GROUP BY 1")
def payments_summary(spark, sf_dir):
    """A recipient's payments of a year."""
    return _paid(spark, sf_dir)["open_payments_summary"]


@query(_PAYMENTS_SQL + """SELECT npi, company_id, payer, amount, records, CAST(rn AS INTEGER) AS payer_rank FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY amount DESC, payer, company_id) AS rn FROM (
SELECT npi, company_id, max(payer) AS payer, round(sum(coalesce(amount, 0)), 2) AS amount, count(*) AS records FROM r WHERE payer IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 3""")
def payments_payers(spark, sf_dir):
    """The three payers of most money."""
    return _paid(spark, sf_dir)["open_payments_payer"]


@query(_PAYMENTS_SQL + """,
t AS (SELECT slug, round(sum(coalesce(amount, 0)), 2) AS amount, count(*) AS records, count(DISTINCT company_id) AS companies, count(DISTINCT npi) AS providers FROM s GROUP BY 1),
u AS (SELECT slug, what, v, sum(amount) AS m, count(*) AS n FROM (SELECT slug, amount, unnest(['name', 'kind', 'category', 'ndc']) AS what, unnest([name, kind, category, ndc]) AS v FROM s) WHERE trim(coalesce(v, '')) <> '' GROUP BY ALL),
w AS (SELECT slug, what, v FROM (SELECT *, row_number() OVER (PARTITION BY slug, what ORDER BY m DESC, n DESC, v) AS rn FROM u) WHERE rn = 1)
SELECT t.slug, amount, records, companies, providers, coalesce(max(v) FILTER (what = 'name'), t.slug) AS name, max(v) FILTER (what = 'kind') AS kind, max(v) FILTER (what = 'category') AS category, max(v) FILTER (what = 'ndc') AS ndc, NULL::VARCHAR AS device_id FROM t LEFT JOIN w ON w.slug = t.slug GROUP BY t.slug, amount, records, companies, providers""")
def payments_products(spark, sf_dir):
    """Products with their sums and most used values."""
    return _paid(spark, sf_dir)["op_product"]


@query(_PAYMENTS_SQL + """SELECT slug, specialty, providers, amount, CAST(rn AS INTEGER) AS specialty_rank FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY amount DESC, specialty) AS rn FROM (
SELECT slug, specialty, count(*) AS providers, round(sum(amount), 2) AS amount FROM (SELECT slug, npi, round(sum(coalesce(amount, 0)), 2) AS amount FROM s GROUP BY 1, 2) JOIN g USING (npi) GROUP BY 1, 2)) WHERE rn <= 10""")
def payments_specialties(spark, sf_dir):
    """The specialties of a product's recipients."""
    return _paid(spark, sf_dir)["op_product_specialty"]


@query(_PAYMENTS_SQL + """SELECT company_id, slug, product, kind, category, amount, records, CAST(rn AS INTEGER) AS product_rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY amount DESC, slug) AS rn FROM (
SELECT company_id, slug, upper(max(name)) AS product, max(kind) AS kind, max(category) AS category, round(sum(coalesce(amount, 0)), 2) AS amount, count(*) AS records FROM s GROUP BY 1, 2)) WHERE rn <= 25""")
def payments_company_products(spark, sf_dir):
    """A company's products of most money."""
    return _paid(spark, sf_dir)["op_company_product"]


@query("""
WITH r AS (SELECT o_custkey::VARCHAR AS npi, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 20)::VARCHAR END AS company_id, 'Co ' || (o_orderkey % 20) AS company, CASE o_orderstatus WHEN 'O' THEN 'General' WHEN 'F' THEN 'Research' ELSE 'Ownership interest' END AS kind, o_totalprice AS amount, 1 AS records FROM orders),
p AS (SELECT npi, coalesce(company_id, '') AS company_id, max(company) AS company, round(sum(amount), 2) AS total_amount, round(sum(CASE WHEN kind = 'General' THEN amount ELSE 0 END), 2) AS general_amount, round(sum(CASE WHEN kind = 'Research' THEN amount ELSE 0 END), 2) AS research_amount, 0.0::DOUBLE AS associated_research_amount, round(sum(CASE WHEN kind LIKE 'Ownership%' THEN amount ELSE 0 END), 2) AS ownership_amount, sum(records)::BIGINT AS records FROM r GROUP BY 1, 2)
SELECT npi, nullif(company_id, '') AS company_id, company, total_amount, general_amount, research_amount, associated_research_amount, ownership_amount, records, CAST(rn AS INTEGER) AS company_rank FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY total_amount DESC, company, company_id) AS rn FROM p) WHERE rn <= 5""")
def payments_by_company(spark, sf_dir):
    """Sums by kind of payment for a recipient's five largest companies."""
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "O", "General").when(F.col("o_orderstatus") == "F", "Research").otherwise("Ownership interest")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("npi"), F.when(k % 6 > 0, (k % 20).cast("string")).alias("company_id"), F.concat(F.lit("Co "), k % 20).alias("company"), kind.alias("payment_type"), F.col("o_totalprice").alias("amount"), F.lit(1).alias("records"))
    return datasets.payments_companies({"main": r, "provider": r.select("npi", F.lit("s").alias("specialty")).distinct()})["open_payments_company"]


@query("""
WITH d AS (SELECT (l_suppkey % 40)::VARCHAR AS ccn, CASE WHEN l_partkey % 2 = 0 THEN 'fire' ELSE 'health' END AS kind, CAST(l_shipdate AS DATE) AS survey_date, 'F' AS prefix, (l_partkey % 60)::VARCHAR AS tag, chr(65 + (l_orderkey % 12)::INTEGER) AS sev, l_linenumber AS cycle, l_returnflag = 'R' AS complaint FROM lineitem)
SELECT ccn, kind, cycle::INTEGER AS cycle, sev AS scope_severity, count(*) AS deficiencies, count(*) FILTER (complaint) AS complaint FROM d GROUP BY ALL""")
def inspection_counts(spark, sf_dir):
    """Deficiencies of facilities by cycle and severity."""
    return datasets.inspections({"deficiencies": _deficiencies(spark, sf_dir), "penalties": _penalties(spark)})["nh_deficiency_count"]


@query("""
WITH d AS (SELECT (l_suppkey % 40)::VARCHAR AS ccn, CASE WHEN l_partkey % 2 = 0 THEN 'fire' ELSE 'health' END AS kind, CAST(l_shipdate AS DATE) AS survey_date, 'F' AS prefix, (l_partkey % 60)::VARCHAR AS tag, chr(65 + (l_orderkey % 12)::INTEGER) AS sev, l_linenumber AS cycle, l_returnflag = 'R' AS complaint FROM lineitem),
c AS (SELECT ccn, kind, survey_date, prefix, tag, min(cycle) AS cycle, max(sev) AS scope_severity, NULL::VARCHAR AS corrected, NULL::DATE AS correction_date, bool_or(complaint) AS complaint, false AS infection_control FROM d GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY scope_severity DESC, survey_date DESC, kind, prefix, tag) AS a, row_number() OVER (PARTITION BY ccn ORDER BY survey_date DESC, scope_severity DESC, kind, prefix, tag) AS b FROM c)
SELECT ccn, kind, survey_date, prefix, tag, cycle, scope_severity, corrected, correction_date, complaint, infection_control FROM r WHERE a <= 10 OR b <= 10""")
def inspection_citations(spark, sf_dir):
    """The ten most serious and the ten newest citations."""
    return datasets.inspections({"deficiencies": _deficiencies(spark, sf_dir), "penalties": _penalties(spark)})["nh_citation"]


def _deficiencies(spark, sf_dir):
    i, none = table(spark, sf_dir, "lineitem"), F.lit(None)
    return i.select(
        (F.col("l_suppkey") % 40).cast("string").alias("ccn"), F.when(F.col("l_partkey") % 2 == 0, "fire").otherwise("health").alias("kind"), F.col("l_shipdate").cast("date").alias("survey_date"), F.lit("F").alias("prefix"), (F.col("l_partkey") % 60).cast("string").alias("tag"),
        F.char(65 + F.col("l_orderkey") % 12).alias("scope_severity"), F.col("l_linenumber").alias("cycle"), (F.col("l_returnflag") == "R").alias("complaint"), none.cast("boolean").alias("infection_control"), none.cast("string").alias("corrected"), none.cast("date").alias("correction_date"),
        none.cast("string").alias("category"), none.cast("string").alias("description"),
    )


def _penalties(spark):
    return spark.createDataFrame([], "ccn string, penalty_date date, penalty_type string, fine_amount double, denial_start date, denial_days long")


@query("""
WITH r AS (SELECT o_custkey::VARCHAR AS npi, o_orderpriority AS hcpcs, o_orderstatus AS place, o_totalprice AS services, (o_orderkey % 100)::DOUBLE AS b, o_orderkey FROM orders)
SELECT npi, hcpcs, place AS place_of_service, services, b AS beneficiaries, CAST(rn AS INTEGER) AS service_rank FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY services DESC, b DESC, hcpcs, place) AS rn FROM r) WHERE rn <= 5""")
def top_services(spark, sf_dir):
    """The five services given most often."""
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("npi"), F.col("o_orderpriority").alias("hcpcs"), F.col("o_orderstatus").alias("place_of_service"), F.col("o_totalprice").alias("services"), (F.col("o_orderkey") % 100).cast("double").alias("beneficiaries"))
    return datasets.top_services({"main": r})["medicare_top_service"]


@query("""
WITH r AS (SELECT l_suppkey::VARCHAR AS npi, p_name AS brand, p_type AS generic, l_linenumber AS claims, l_quantity AS fills, l_extendedprice AS drug_cost, l_orderkey % 50 AS beneficiaries FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT brand, npi, sum(claims)::BIGINT AS claims, sum(fills) AS fills, round(sum(drug_cost), 2) AS drug_cost, sum(beneficiaries)::BIGINT AS beneficiaries FROM r WHERE upper(brand) <> upper(generic) GROUP BY 1, 2)
SELECT b.brand, count(*) AS prescribers, sum(claims)::BIGINT AS claims, round(sum(drug_cost), 2) AS drug_cost, sum(beneficiaries)::BIGINT AS beneficiaries, (SELECT max(generic) FROM r WHERE r.brand = b.brand) AS generic FROM b GROUP BY b.brand""")
def part_d_brands(spark, sf_dir):
    """Claims by brand."""
    i = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    r = i.select(F.col("l_suppkey").cast("string").alias("npi"), F.col("p_name").alias("brand"), F.col("p_type").alias("generic"), F.col("l_linenumber").alias("claims"), F.col("l_quantity").alias("fills"), F.col("l_extendedprice").alias("drug_cost"), (F.col("l_orderkey") % 50).alias("beneficiaries"))
    return datasets.part_d_brands({"main": r})["part_d_brand"]


@query("""
WITH t AS (SELECT o_custkey AS npi, 3 AS parts, count(*)::DOUBLE AS billed, max(o_totalprice) AS prescribed FROM orders WHERE o_orderdate < '1997-07-01' GROUP BY 1), n AS (SELECT o_custkey AS npi, count(*)::DOUBLE AS v FROM orders WHERE o_orderdate >= '1997-07-01' GROUP BY 1)
SELECT 2020 AS data_year, coalesce(t.npi, n.npi) AS npi, (CASE WHEN n.npi IS NOT NULL THEN coalesce(parts, 0) | 1 ELSE coalesce(parts, 0) & ~1 END)::INTEGER AS parts, v AS billed, prescribed FROM t FULL JOIN n ON t.npi = n.npi""")
def activity_year(spark, sf_dir):
    """A year's part replaced: bits and values set for keys that came in, cleared for those that are gone."""
    old, new = _halves(spark, sf_dir)
    now = old.groupBy(F.col("o_custkey").alias("npi")).agg(F.count("*").cast("double").alias("billed"), F.max("o_totalprice").alias("prescribed")).select(F.lit(2020).alias("data_year"), "npi", F.lit(3).alias("parts"), "billed", "prescribed")
    return datasets.activity_year(now, new.groupBy(F.col("o_custkey").alias("npi")).agg(F.count("*").cast("double").alias("value")), 1, 2020, "billed")


# --- places, changes, pages, free text --------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT vec_id AS point, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings),
s AS (SELECT s_suppkey AS polygon, (s_suppkey % 13) * 1.0 - 7 AS cx, (s_suppkey % 11) * 1.0 - 6 AS cy, 1.0 + s_suppkey % 3 AS h FROM supplier),
g AS (SELECT polygon, [{'x': cx - h, 'y': cy - h}, {'x': cx + h, 'y': cy - h / 2}, {'x': cx, 'y': cy + h}] AS r FROM s),
e AS (SELECT polygon, r[i].x AS ax, r[i].y AS ay, r[i % 3 + 1].x AS bx, r[i % 3 + 1].y AS b_y FROM g, (SELECT unnest([1, 2, 3]) AS i)),
a AS (SELECT polygon, abs(sum(ax * b_y - bx * ay)) / 2 AS area FROM e GROUP BY 1),
c AS (SELECT point, x, y, polygon FROM p JOIN e ON (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT point, round(x, 6) AS x, round(y, 6) AS y, polygon, round(area, 6) AS area FROM (SELECT c.*, area, row_number() OVER (PARTITION BY point ORDER BY area, c.polygon) AS rn FROM c JOIN a ON a.polygon = c.polygon) WHERE rn = 1""")
def smallest_polygon(spark, sf_dir):
    """The smallest polygon that contains each point."""
    e = F.col("embedding")
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), (e[0].cast("double") * 10).alias("x"), (e[1].cast("double") * 10).alias("y"))
    k = F.col("s_suppkey")
    x, y, h = (k % 13).cast("double") - 7, (k % 11).cast("double") - 6, 1.0 + (k % 3)
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rings = table(spark, sf_dir, "supplier").select(k.alias("polygon"), F.array(corner(x - h, y - h), corner(x + h, y - h / 2), corner(x, y + h)).alias("ring"))
    found = spatial.smallest_containing(points, rings, 2.0)
    return found.select("point", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "polygon", F.round("area", 6).alias("area"))


_CHANGES_SQL = """
WITH y AS (SELECT o_custkey AS k, CASE WHEN o_orderdate < '1997-07-01' THEN 1996 ELSE 1997 END AS y, max(o_orderpriority) AS p, max(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, a.p AS ap, b.p AS bp, a.s AS s1, b.s AS s2, a.n AS an, b.n AS bn FROM (SELECT * FROM y WHERE y = 1996) a FULL JOIN (SELECT * FROM y WHERE y = 1997) b ON a.k = b.k),
c AS (SELECT k, 'moved' AS kind, ap AS was, bp AS "is", 1 AS place FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND ap IS DISTINCT FROM bp
UNION ALL SELECT k, 'size', concat_ws(', ', s1, an), concat_ws(', ', s2, bn), 2 FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND (s1 IS DISTINCT FROM s2 OR an IS DISTINCT FROM bn)
UNION ALL SELECT k, 'added', NULL, NULL, 3 FROM j WHERE ak IS NULL UNION ALL SELECT k, 'removed', NULL, NULL, 4 FROM j WHERE bk IS NULL)
"""


def _changes(spark, sf_dir):
    old, new = (df.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("p"), F.max("o_orderstatus").alias("s"), F.count("*").alias("n")) for df in _halves(spark, sf_dir))
    return changes.change_log(old, new, ["k"], {"moved": ["p"], "size": ["s", "n"]})


@query(_CHANGES_SQL + 'SELECT k, kind, was, "is" FROM c')
def change_log(spark, sf_dir):
    """What kinds of change each key went through."""
    return _changes(spark, sf_dir)


@query(_CHANGES_SQL + """SELECT k, string_agg(CASE kind WHEN 'moved' THEN 'moved from ' || was || ' to ' || "is" WHEN 'size' THEN 'was ' || was || ', now ' || "is" WHEN 'added' THEN 'is new' ELSE 'is gone' END, '; ' ORDER BY place) AS text FROM c GROUP BY 1""")
def change_texts(spark, sf_dir):
    """A key's changes as text."""
    return changes.described(_changes(spark, sf_dir), ["k"], {"moved": "moved from {was} to {is}", "size": "was {was}, now {is}", "added": "is new", "removed": "is gone"})


@query("SELECT c_mktsegment, c_custkey, c_name FROM customer WHERE (c_mktsegment, c_custkey) > ('BUILDING', 100) ORDER BY c_mktsegment, c_custkey LIMIT 40")
def keyset_page(spark, sf_dir):
    """The page behind a row, without an offset."""
    return ranking.next_page(table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_custkey"), "c_name"), ["c_mktsegment", "c_custkey"], ("BUILDING", 100), 40)


@query("""
WITH d AS (SELECT vec_id, round(sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)), 9) AS d FROM embeddings) SELECT vec_id, d, (SELECT count(*) FROM d) > 25 AS more FROM d ORDER BY d, vec_id LIMIT 25""")
def nearest_places(spark, sf_dir):
    """The nearest places, and whether there are more."""
    e = F.col("embedding")
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(F.pow(e[0].cast("double"), 2) + F.pow(e[1].cast("double"), 2)), 9).alias("d"))
    return ranking.nearest(d, "d", "vec_id", 25)


#: What is typed for each part, by a form in turn; the twin states what each form asks for.
_ASKED = """CASE p_partkey % 9
  WHEN 0 THEN noun || 's within 25 miles of ' || zip WHEN 1 THEN noun || ' in Nation ' || nation || ' County, ' || code WHEN 2 THEN 'find ' || noun || 's near ' || zip || '-0042'
  WHEN 3 THEN noun || ' John Smith in Town ' || nation WHEN 4 THEN '123-456-' || lpad(CAST(p_partkey % 10000 AS VARCHAR(9)), 4, '0') WHEN 5 THEN 'Dr. Jordan ' || p_type
  WHEN 6 THEN 'bayside dental group ' || lower(code) WHEN 7 THEN noun || ', ' || region ELSE 'doctors in nation ' || nation || ' parish' END"""


@query(f"""
WITH q AS (
  SELECT p_partkey, p_type, split_part(p_name, ' ', 2) AS noun, lpad((p_partkey % 99999)::VARCHAR, 5, '0') AS zip, n_nationkey AS nation, left(r_name, 2) AS code, r_name AS region, lpad(n_nationkey::VARCHAR, 5, '0') AS fips, p_partkey % 9 AS form
  FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey)
SELECT p_partkey AS id, CASE form WHEN 4 THEN 'number' WHEN 5 THEN 'names' ELSE 'list' END AS kind, CASE WHEN form = 4 THEN '123456' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') END AS npi, CASE WHEN form IN (0, 1, 2, 3, 7) THEN noun END AS specialty,
CASE WHEN form IN (1, 3, 6, 7, 8) THEN code END AS state, CASE WHEN form IN (1, 8) THEN fips END AS county, CASE WHEN form = 3 THEN 'Town ' || nation END AS city, CASE WHEN form IN (0, 2) THEN zip END AS zip5, CASE form WHEN 0 THEN 25 WHEN 2 THEN 10 END AS radius,
CASE WHEN form = 6 THEN 'bayside dental group' END AS org_name, CASE WHEN form = 3 THEN 'john' END AS first_name, CASE WHEN form = 3 THEN 'smith' END AS last_name, CASE form WHEN 3 THEN 'john smith' WHEN 5 THEN 'Jordan ' || p_type WHEN 6 THEN 'bayside dental group' END AS name FROM q""")
def free_text(spark, sf_dir):
    """Free-text queries as numbers, specialties, places, distances and names."""
    p = table(spark, sf_dir, "part")
    world = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = F.col("n_nationkey")
    world = world.select(nation.alias("nation"), F.left("r_name", F.lit(2)).alias("code"), F.col("r_name").alias("region"), F.lpad(nation.cast("string"), 5, "0").alias("fips"))
    noun = p.select(F.split("p_name", " ")[1].alias("name")).distinct().withColumn("value", F.col("name"))
    named = lambda first, last="": F.concat(F.lit(first), nation_, F.lit(last))
    nation_ = F.col("nation")
    counties = world.select(named("Nation ", " County").alias("name"), F.col("code").alias("state"), "fips", nation_.alias("population"))
    cities = world.select(named("TOWN ").alias("city"), F.col("code").alias("state"), nation_.alias("zips"))
    known = interpret.vocabulary(noun, counties, cities, world.select("code", F.col("region").alias("name")).distinct())
    asked = p.withColumn("nation_", F.col("p_partkey") % 25).join(world, F.col("nation_") == F.col("nation")).withColumn("noun", F.split("p_name", " ")[1]).withColumn("zip", F.lpad((F.col("p_partkey") % 99999).cast("string"), 5, "0"))
    return interpret.interpret(asked.select(F.col("p_partkey").alias("id"), F.expr(_ASKED).alias("text")), known).drop("near_me", "notes")
