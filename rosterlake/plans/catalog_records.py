"""Registry queries of record quality, organisations and their participants, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import text
from rosterlake.operators import linkage, quality
from rosterlake.plans.catalog import query, table

# --- organisations ----------------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT p_partkey AS npi, upper(replace(p_name, ' ', '')) AS key, left(p_name, 1) AS f, p_size < 4 AS h FROM part),
g AS (SELECT key, any_value(f) AS f, count(*) AS n, count(*) FILTER (h) AS hs FROM o GROUP BY key),
r AS (SELECT *, n BETWEEN 2 AND 50 AND CASE f WHEN 'b' THEN hs = 1 WHEN 'h' THEN hs > 0 WHEN 'l' THEN hs > 0 ELSE false END AS family FROM g),
u AS (SELECT s_suppkey AS group_id, upper(p_name) || '.' AS name, upper(replace(p_name, ' ', '')) AS key FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT group_id, name, npi, n AS candidates, family AS hospital, CASE WHEN family THEN CASE r.f WHEN 'b' THEN 'parent' WHEN 'h' THEN 'ccn' ELSE 'parent_tin' END END AS grouped_by, CASE WHEN family THEN CASE r.f WHEN 'b' THEN key WHEN 'h' THEN '330001' END END AS grouped_value
FROM u JOIN r USING (key) JOIN o USING (key) WHERE n <= 5 OR family""")
def participant_match(spark, sf_dir):
    """Participants with the organisations of their name: a few, or a hospital and its own numbers."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    named = s.join(p, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("group_id"), F.concat(F.upper("p_name"), F.lit(".")).alias("name"))
    first, hospital = F.left("p_name", F.lit(1)), F.col("p_size") < 4
    orgs = p.select(
        F.col("p_partkey").alias("npi"), F.col("p_name").alias("org_name"), hospital.alias("hospital"), F.when(first == "h", F.array(F.lit("330001"))).alias("ccns"),
        F.when((first == "b") & ~hospital, text.letters_key(F.col("p_name"))).alias("parent_key"), F.when(first == "l", F.lit("9")).alias("parent_tin"),
    )
    return linkage.participant_matches(named, orgs)


@query(r"""
WITH p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS npi, p_name, p_brand FROM part WHERE p_partkey % 10 > 0),
a AS (SELECT *, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN (k % 9) || '' ELSE (k % 4) || '' || (k % 3) END AS number, CASE k % 3 WHEN 0 THEN 'OLD MILL' WHEN 1 THEN 'VAN WYCK EXPY' ELSE 'E 2ND ST' END AS street FROM p),
f AS (SELECT l_partkey AS k, list_sort(list_distinct(list(CASE l_suppkey % 4 WHEN 0 THEN '33' || '0' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN '33' || '1' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') WHEN 2 THEN '33A' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') ELSE '330' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') END))) AS ccns,
  max(l_returnflag = 'A') AS hospital FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT npi, nullif(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), '') AS name_key, CASE WHEN k % 6 > 0 THEN lpad((k % 700)::VARCHAR, 5, '0') END AS zip5, number, street, coalesce(array_to_string(ccns, ' '), '') AS ccns, coalesce(hospital, false) OR k % 8 = 0 AS hospital, CASE WHEN k % 5 = 0 THEN upper(p_brand[1:5]) || regexp_extract(p_brand, '[0-9]+') END AS parent_key
FROM a LEFT JOIN f USING (k)""")
def organisation_records(spark, sf_dir):
    """Organisations as their grouping takes them: name and street keys, facilities of units, parents (B12, H10, scalar CCN keys)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    npi = k.cast("string").alias("npi")
    providers = p.select(npi, F.when(k % 10 > 0, 2).otherwise(1).alias("entity_type"), F.col("p_name").alias("org_name"), F.when(k % 8 == 0, "282N00000X").otherwise("207R00000X").alias("primary_taxonomy_code"), F.lit("2024-01-01").cast("date").alias("last_update_date"))
    line = F.when(k % 3 == 0, "Old Mill, Suites 1-3").when(k % 3 == 1, F.concat(k % 9, F.lit(" Van Wyck Express Way #4"))).otherwise(F.concat(k % 4, F.lit("-"), k % 3, F.lit(" East Second Street Floor 3")))
    locations = p.select(npi, F.lit(True).alias("is_primary"), line.alias("address1"), F.when(k % 6 > 0, F.lpad((k % 700).cast("string"), 5, "0")).otherwise("17").alias("zip5"))
    s = F.col("l_suppkey")
    letter = F.when(s % 4 == 0, "S").when(s % 4 == 1, "m").when(s % 4 == 2, "A").otherwise("0")
    facilities = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_partkey").cast("string").alias("npi"), F.concat(F.lit(" 33"), letter, F.lpad((s % 1000).cast("string"), 3, "0")).alias("ccn"), F.when(F.col("l_returnflag") == "A", "Hospital").otherwise("Hospice").alias("kind"))
    enrollments = p.filter("p_size > 40").select(npi, F.col("p_brand").alias("pac_id"))
    profiles = p.filter("p_partkey % 5 = 0").select(npi, F.col("p_brand").alias("parent_name"), F.lit("12-3456789").alias("parent_tin"))
    out = linkage.organisation_input(providers, locations, facilities, enrollments, profiles)
    return out.select("npi", "name_key", "zip5", "number", "street", F.array_join("ccns", " ").alias("ccns"), "hospital", "parent_key")


# --- record quality ---------------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, c_acctbal > 9900 AS is_main, CASE WHEN c_custkey % 13 > 0 THEN DATE '2008-01-01' + (c_custkey * 5 % 6000)::INTEGER END AS u, lpad((c_custkey % 50)::VARCHAR, 5, '0') AS z FROM customer),
act AS (SELECT k, bit_or(b) AS activity FROM (SELECT o_custkey AS k, 1 AS b FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, 128 FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT k, 2048 FROM c WHERE k % 6 = 0) GROUP BY k),
lic AS (SELECT o_custkey AS k, CASE o_orderstatus WHEN 'P' THEN 'Expired' WHEN 'F' THEN 'Active' ELSE 'Deceased' END AS s, o_orderdate::DATE + 9000 AS e FROM orders WHERE o_orderkey % 7 = 0),
y AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate) AS y FROM orders), newest AS (SELECT max(y) AS y FROM y),
listed AS (SELECT k, (k + (k % 3) * 9) % 50 AS lz, CASE WHEN k % 4 > 0 THEN n END AS ls, CASE WHEN k % 5 > 0 THEN m END AS lm FROM c WHERE k % 2 = 0),
spec AS (SELECT * FROM (VALUES (0, 'A'), (1, 'B'), (2, 'A'), (2, 'B'), (4, 'C')) v(s, cat)), codes AS (SELECT * FROM (VALUES ('BUILDING', 'A'), ('FURNITURE', 'B')) v(code, cat)),
r AS (
  SELECT k, 1 AS b FROM c WHERE u < DATE '2024-06-01' - INTERVAL 5 YEAR UNION ALL SELECT k, 2 FROM c WHERE u < DATE '2024-06-01' - INTERVAL 10 YEAR UNION ALL SELECT k, 4 FROM c WHERE k NOT IN (SELECT k FROM act)
  UNION ALL SELECT c.k, 16384 FROM c JOIN act USING (k) WHERE activity = 2048 AND u < DATE '2024-06-01' - INTERVAL 10 YEAR UNION ALL SELECT k, 8 FROM c WHERE k % 4 <> 1 UNION ALL SELECT k, 16 FROM c WHERE k % 5 = 0
  UNION ALL SELECT k, 32 FROM c WHERE k % 9 = 0 AND k % 3 = 0 UNION ALL SELECT k, 2048 FROM c WHERE (k % 700) % 3 = 0
  UNION ALL SELECT k, 256 FROM lic WHERE (e < DATE '2024-06-01' OR s IN ('Expired', 'Deceased')) AND k NOT IN (SELECT k FROM act WHERE activity & 128 <> 0) UNION ALL SELECT k, 512 FROM lic WHERE s = 'Deceased'
  UNION ALL SELECT k, 32768 FROM y WHERE y < (SELECT y FROM newest) AND k NOT IN (SELECT y.k FROM y JOIN newest ON y.y = newest.y)
  UNION ALL SELECT l.k, 64 FROM listed l JOIN c USING (k) WHERE lz <= 45 AND NOT (lz = k % 50 OR coalesce(ls = n AND lm = m, false) OR (k % 50 <= 45 AND 2 * 3958.8 * asin(sin(abs(radians((lz - k % 50) * 0.2)) / 2)) < 25))
  UNION ALL SELECT k, 128 FROM c WHERE k % 5 IN (SELECT s FROM spec) AND NOT EXISTS (SELECT 1 FROM spec JOIN codes USING (cat) WHERE s = k % 5 AND code = m)),
t AS (SELECT c.k AS npi, n AS main, is_main, u, coalesce(any_value(activity), 0) AS activity, coalesce(bit_or(b), 0) AS r FROM c LEFT JOIN r USING (k) LEFT JOIN act USING (k) GROUP BY ALL),
l AS (SELECT *, CASE WHEN (r & 6) = 6 OR (r & 66048) <> 0 OR ((r & 12288) <> 0 AND (r & 4) <> 0) THEN 3 WHEN ((r & 4) <> 0 AND (r & 32769) <> 0) OR (r & 29176) <> 0 THEN 2 ELSE 1 END AS l FROM t),
a AS (SELECT main, coalesce(max(CASE WHEN is_main THEN npi END), min(npi)) AS other FROM l WHERE l = 1 AND activity <> 0 GROUP BY 1),
x AS (SELECT l.*, CASE WHEN activity = 0 AND other <> npi AND coalesce(u < DATE '2022-06-01', true) THEN other END AS other_npi FROM l LEFT JOIN a USING (main))
SELECT npi, (CASE WHEN other_npi IS NOT NULL THEN 3 ELSE l END)::INTEGER AS label, (r + CASE WHEN other_npi IS NOT NULL THEN 65536 ELSE 0 END)::INTEGER AS reasons, activity::INTEGER AS activity, other_npi FROM x""")
def record_quality(spark, sf_dir):
    """Every record's reasons from the tables, its signs of practice and its label."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    npi, as_of = k.alias("npi"), F.lit("2024-06-01").cast("date")
    zip5 = lambda z: F.lpad(z.cast("string"), 5, "0")
    updated = F.when(k % 13 > 0, F.date_add(F.lit("2008-01-01").cast("date"), (k * 5 % 6000).cast("int")))
    providers = c.select(npi, updated.alias("last_update_date"), updated.alias("enumeration_date"), F.when(k % 9 > 0, "1").alias("phone"))
    locations = c.select(npi, F.lit(True).alias("is_primary"), (k % 700).alias("addr_key"), zip5(k % 50).alias("zip5"), nation.cast("string").alias("state"), F.col("c_mktsegment").alias("city"), F.when(k % 5 == 0, "P.O. Box 7").otherwise("7 Boxwood St").alias("address1"), F.when(k % 3 > 0, "2").alias("phone"))
    by = F.col("o_custkey").alias("npi")
    activity = quality.signs({"billing": [o.filter("o_orderkey % 3 = 0").select(by)], "current_license": [o.filter("o_orderkey % 11 = 0").select(by)], "map_listing": [c.filter("c_custkey % 6 = 0").select(npi)]}, "npi")
    points = c.filter("c_custkey % 4 < 2").select(npi, (k % 700).alias("addr_key"), F.when(k % 4 == 0, "zip").otherwise("address").alias("source"))
    kinds = c.select((k % 700).alias("addr_key")).distinct().withColumn("building_type", F.when(F.col("addr_key") % 3 == 0, "residential").otherwise("commercial"))
    licenses = o.filter("o_orderkey % 7 = 0").select(by, F.lit("license").alias("kind"), F.when(F.col("o_orderstatus") == "P", "Expired").when(F.col("o_orderstatus") == "F", "Active").otherwise("Deceased").alias("status"), F.date_add(F.col("o_orderdate").cast("date"), 9000).alias("expiration_date"))
    years = o.select(by, F.year("o_orderdate").alias("data_year")).distinct()
    newest = years.join(F.broadcast(years.agg(F.max("data_year").alias("data_year"))), "data_year").select("npi", "data_year")  # one row
    listed = c.filter("c_custkey % 2 = 0").select(npi, zip5((k + (k % 3) * 9) % 50).alias("zip5"), F.when(k % 4 > 0, nation.cast("string")).alias("state"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("city"))
    centroids = spark.range(46).select(zip5(F.col("id")).alias("zip5"), (30 + F.col("id") * 0.2).alias("lat"), F.lit(-90.0).alias("lon"))
    clinicians = c.select(npi, F.concat(F.lit("SP"), k % 5).alias("primary_specialty"))
    specialty = spark.createDataFrame([("SP0", "A"), ("SP1", "B"), ("SP2", "A"), ("SP2", "B"), ("SP4", "C")], "specialty string, category string")
    codes = spark.createDataFrame([("BUILDING", "A"), ("FURNITURE", "B")], "code string, category string")
    reasons = [
        quality.own_reasons(providers, locations, activity, points, kinds, as_of), quality.license_reasons(licenses, activity, as_of), quality.stopped_billing(years, newest), quality.address_reasons(listed, locations, centroids),
        quality.specialty_reasons(clinicians, c.select(npi, F.col("c_mktsegment").alias("taxonomy_code")), codes, specialty),
    ]
    groups = c.select(npi, nation.alias("main_npi"), (F.col("c_acctbal") > 9900).alias("is_main"))
    return quality.labelled(reasons, activity, groups, providers, as_of)
