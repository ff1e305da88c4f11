"""Registry queries of directories, companies and prescribing, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import directories
from rosterlake.plans.catalog import query, table


@query("""
WITH r AS (SELECT upper(chr((65 + s_suppkey % 3)::INTEGER)) || s_suppkey AS ccn, s_suppkey AS k, CASE WHEN s_suppkey % 11 > 0 THEN s_name END AS name, 'X' || s_nationkey AS state, lpad((s_suppkey % 40)::VARCHAR, 5, '0') AS zip5, s_suppkey % 4 > 0 AS active FROM supplier WHERE s_suppkey % 7 > 0),
l AS (SELECT CASE WHEN s_suppkey % 6 = 0 THEN 'hospital' ELSE 'hospice' END AS type, chr((65 + s_suppkey % 3)::INTEGER) || s_suppkey AS ccn, 'Listed ' || s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'L' || s_nationkey END AS state, s_acctbal AS rating FROM supplier WHERE s_suppkey % 2 = 0),
b AS (SELECT DISTINCT chr((65 + l_suppkey % 3)::INTEGER) || l_suppkey AS ccn, l_partkey AS npi, CASE l_returnflag WHEN 'A' THEN 'fqhc' WHEN 'N' THEN 'rhc' ELSE 'asc' END AS kind FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 > 0),
n AS (SELECT ccn, count(DISTINCT npi) AS billing_npis FROM b GROUP BY 1), k AS (SELECT ccn, arg_min(kind, (-n, kind)) AS linked FROM (SELECT ccn, kind, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT ccn, max(d) AS changed FROM (SELECT chr((65 + o_custkey % 3)::INTEGER) || o_custkey AS ccn, o_orderdate::DATE AS d FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT chr((65 + o_orderkey % 3)::INTEGER) || o_orderkey, o_orderdate::DATE FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1),
p AS (SELECT chr((65 + o_custkey % 3)::INTEGER) || o_custkey AS ccn, count(*) AS penalties, round(sum(o_totalprice), 2) AS fines, max(o_orderdate::DATE) AS last_penalty FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
m AS (SELECT coalesce(r.ccn, l.ccn) AS ccn, l.type AS lt, coalesce(l.name, r.name) AS name, coalesce(l.state, r.state) AS state, r.zip5, l.rating, l.type IS NOT NULL OR coalesce(r.active, false) AS active, CASE WHEN l.type IS NULL THEN CASE WHEN r.active THEN '00' ELSE '07' END END AS termination_code FROM r FULL JOIN l ON l.ccn = r.ccn)
SELECT m.ccn, coalesce(lt, linked, CASE WHEN starts_with(m.ccn, 'A') THEN 'clinic' ELSE 'other' END) AS type, name, state, m.zip5, rating, active, termination_code, coalesce(billing_npis, 0) AS billing_npis, CASE WHEN m.zip5 < '00030' THEN 30 + m.zip5::INTEGER * 0.5::DOUBLE END AS lat,
changed AS ownership_changed, coalesce(penalties, 0) AS penalties, fines, last_penalty FROM m LEFT JOIN n USING (ccn) LEFT JOIN k USING (ccn) LEFT JOIN c USING (ccn) LEFT JOIN p USING (ccn) WHERE name IS NOT NULL""")
def facility_directory(spark, sf_dir):
    """Facilities merged from the register, the listings, their billing numbers, changes of owner and penalties."""
    s, o, item = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("s_suppkey")
    ccn = lambda c: F.concat(F.lower(F.char((65 + c % 3).cast("int"))), c, F.lit(" "))
    none = lambda n, kind="string": F.lit(None).cast(kind).alias(n)
    zip5 = F.lpad((k % 40).cast("string"), 5, "0").alias("zip5")
    registered = s.filter("s_suppkey % 7 > 0").select(ccn(k).alias("ccn"), F.when(k % 11 > 0, F.col("s_name")).alias("name"), none("address"), none("city"), F.concat(F.lit("X"), "s_nationkey").alias("state"), zip5, (k % 4 > 0).alias("active"), F.when(k % 4 > 0, "00").otherwise("07").alias("termination_code"), none("termination_date", "date"))
    listed = s.filter("s_suppkey % 2 = 0").select(F.when(k % 6 == 0, "hospital").otherwise("hospice").alias("type"), ccn(k).alias("ccn"), F.concat(F.lit("Listed "), "s_name").alias("name"), none("address"), none("city"), F.when(k % 4 == 0, F.concat(F.lit("L"), "s_nationkey")).alias("state"), none("zip5"), none("phone"), none("kind"), none("ownership"), none("beds", "int"), F.col("s_acctbal").alias("rating"))
    kind = F.when(F.col("l_returnflag") == "A", "fqhc").when(F.col("l_returnflag") == "N", "rhc").otherwise("asc").alias("kind")
    billing = item.filter("l_linenumber = 1").select(ccn(F.col("l_suppkey")).alias("ccn"), F.col("l_partkey").alias("npi"), kind)
    providers = table(spark, sf_dir, "part").filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("npi"))
    centroids = spark.range(30).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("zip5"), (30 + F.col("id") * 0.5).alias("lat"), F.lit(-90.0).alias("lon"))
    day = F.col("o_orderdate").cast("date")
    changes = o.filter("o_orderpriority = '1-URGENT'").select(ccn(F.col("o_custkey")).alias("buyer_ccn"), ccn(F.col("o_orderkey")).alias("seller_ccn"), day.alias("effective_date"))
    penalties = o.filter("o_orderstatus = 'P'").select(ccn(F.col("o_custkey")).alias("ccn"), F.col("o_totalprice").alias("fine_amount"), day.alias("penalty_date"))
    out = directories.facility_directory(registered, listed, billing, providers, centroids, changes, penalties, ["hospital", "hospice"], F.when(F.startswith("ccn", F.lit("A")), "clinic").otherwise("other"))
    return out.select("ccn", "type", "name", "state", "zip5", "rating", "active", "termination_code", "billing_npis", "lat", "ownership_changed", "penalties", "fines", "last_penalty")


@query("""
WITH a AS (SELECT p_partkey AS npi FROM part WHERE p_partkey % 4 > 0), m AS (SELECT DISTINCT 'G' || l_suppkey AS pac_id, l_partkey AS npi FROM lineitem WHERE l_returnflag IN ('A', 'N')),
c AS (SELECT pac_id, count(*) AS clinicians FROM m WHERE npi IN (FROM a) GROUP BY 1), cc AS (SELECT 'G' || l_suppkey AS pac_id, CASE WHEN l_suppkey % 3 > 0 THEN 'Care ' || l_suppkey END AS n, max(l_linenumber > 5) AS acc FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_suppkey),
re AS (SELECT DISTINCT 'G' || l_suppkey AS pac_id, CASE WHEN l_suppkey % 5 > 0 THEN 'Re ' || l_suppkey END AS n, 'S' || l_suppkey % 9 AS s FROM lineitem WHERE l_returnflag = 'A'),
e AS (SELECT 'G' || p_size AS pac_id, count(*) AS k FROM part WHERE p_partkey % 4 > 0 GROUP BY 1), sc AS (SELECT 'G' || s_suppkey AS pac_id, round(s_acctbal, 2) AS v FROM supplier WHERE s_suppkey % 2 = 0)
SELECT c.pac_id, coalesce(cc.n, re.n, 'Group ' || c.pac_id) AS name, s AS state, clinicians, coalesce(k, 0) AS organization_npis, acc AS accepts_assignment, v AS mips_score, CASE WHEN v IS NOT NULL THEN 2022 END AS mips_year
FROM c LEFT JOIN cc USING (pac_id) LEFT JOIN re USING (pac_id) LEFT JOIN e USING (pac_id) LEFT JOIN sc USING (pac_id)""")
def group_directory(spark, sf_dir):
    """Groups with their clinicians, organisations and scores."""
    item, p, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    k = F.col("l_suppkey")
    pac, npi = F.concat(F.lit("G"), k), F.col("l_partkey").alias("npi")
    reassigned = item.filter("l_returnflag = 'A'").select(pac.alias("group_pac_id"), npi, F.when(k % 5 > 0, F.concat(F.lit("Re "), k)).alias("group_name"), F.concat(F.lit("S"), k % 9).alias("group_state"))
    members = item.filter("l_returnflag = 'N'").select(pac.alias("org_pac_id"), npi, F.when(k % 3 > 0, F.concat(F.lit("Care "), k)).alias("group_name"), F.lit(None).cast("string").alias("state"), (F.col("l_linenumber") > 5).alias("accepts_assignment"))
    enrolled = p.select(F.concat(F.lit("G"), "p_size").alias("pac_id"), F.col("p_partkey").alias("npi"), F.col("p_name").alias("org_name"))
    scores = s.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("G"), "s_suppkey").alias("org_pac_id"), F.explode(F.array(F.lit("group"), F.lit("individual"))).alias("source"), F.lit(2022).alias("program_year"), F.col("s_acctbal").alias("final_score"))
    return directories.group_directory(reassigned, members, enrolled, scores, p.filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("npi")))


@query("""
WITH c AS (SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Global ' ELSE '_x ' END || p_type AS name, p_retailprice AS amount FROM part),
w AS (SELECT id, upper(list_filter(regexp_extract_all(name, '[A-Za-z]+'), lambda x: length(x) >= 4 AND upper(x) <> 'GLOBAL')[1]) AS word FROM c),
t AS (SELECT id, name, amount, unnest(list_distinct(list_transform(regexp_extract_all(name, '[A-Za-z0-9_]+'), lambda x: upper(x)))) AS word FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY amount DESC, name, id) AS pos, count(*) OVER (PARTITION BY word) AS n FROM t)
SELECT company_id, similar_id, similar_name, rank FROM (
  SELECT w.id AS company_id, r.id AS similar_id, name AS similar_name, row_number() OVER (PARTITION BY w.id ORDER BY pos)::INTEGER AS rank FROM w JOIN r USING (word) WHERE pos <= 6 AND w.id <> r.id) WHERE rank <= 5""")
def similar_companies(spark, sf_dir):
    """The five companies of most money that share a company's distinctive word."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 3 == 0, " Global ").otherwise("_x "), "p_type")
    return directories.similar_companies(table(spark, sf_dir, "part").select(k.alias("company_id"), name.alias("name"), F.col("p_retailprice").alias("amount")), 5)


@query("""
WITH pr AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS slug FROM part), b AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS brand FROM part),
m AS (SELECT DISTINCT slug, brand FROM pr JOIN b ON brand = slug OR starts_with(brand, slug || ' ')),
d AS (SELECT CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS brand, l_suppkey AS npi, sum(l_quantity)::BIGINT AS claims, sum(l_extendedprice) AS cost FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
t AS (SELECT brand, sum(claims)::BIGINT AS claims, sum(cost) AS cost FROM d GROUP BY 1), a AS (SELECT s_suppkey AS npi FROM supplier WHERE s_suppkey % 5 > 0),
paid AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS slug, l_suppkey AS npi FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND l_quantity > 45),
o AS (SELECT slug, npi, sum(claims)::BIGINT AS claims, round(sum(cost), 2) AS cost FROM d JOIN m USING (brand) GROUP BY 1, 2), both_ AS (SELECT slug, count(*) AS n, sum(o.claims)::BIGINT AS c, round(sum(o.cost), 2) AS x FROM paid JOIN a USING (npi) JOIN o USING (slug, npi) GROUP BY 1)
SELECT slug, string_agg(brand, ' | ' ORDER BY claims DESC, brand) AS brands, (SELECT count(DISTINCT npi) FROM d JOIN m USING (brand) WHERE m.slug = x.slug) AS prescribers, sum(claims)::BIGINT AS claims, round(sum(cost), 2) AS drug_cost,
(SELECT count(*) FROM paid JOIN a USING (npi) WHERE paid.slug = x.slug) AS paid_providers, coalesce(any_value(both_.n), 0) AS paid_prescribers, coalesce(any_value(both_.c), 0) AS paid_claims, any_value(both_.x) AS paid_drug_cost
FROM m x JOIN t USING (brand) LEFT JOIN both_ USING (slug) GROUP BY slug""")
def prescribing_overlap(spark, sf_dir):
    """Products with the brands that are prescribed of them, and how many prescribers are paid."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    first = F.split("p_name", " ")[0]
    brand = F.when(F.col("p_size") % 3 == 0, first).otherwise(F.col("p_name")).alias("brand")
    products = p.select(first.alias("slug")).distinct().select("slug", F.col("slug").alias("name"), F.lit("Drug").alias("kind"), F.lit(None).cast("string").alias("ndc_key"))
    drugs = table(spark, sf_dir, "lineitem").join(p.select("p_partkey", brand, first.alias("slug")), F.col("p_partkey") == F.col("l_partkey"))
    prescribed = drugs.groupBy("brand", F.col("l_suppkey").alias("npi")).agg(F.sum("l_quantity").cast("long").alias("claims"), F.sum("l_extendedprice").alias("drug_cost"), F.count("*").alias("beneficiaries"))
    totals = prescribed.groupBy("brand").agg(F.sum("claims").alias("claims"), F.sum("drug_cost").alias("drug_cost"))
    matched = directories.product_brands(products, spark.createDataFrame([], "ndc_key string, brand_name string"), p.select(brand))
    paid = drugs.filter("l_returnflag = 'A' and l_quantity > 45").groupBy("slug", F.col("l_suppkey").alias("npi")).agg(F.sum("l_extendedprice").alias("amount"), F.count("*").alias("records"))
    return directories.prescribing_overlap(paid, matched, prescribed, totals, s.filter("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("npi")))
