"""Registry queries of the builders that follow changes, the histories by area, full text, sets and plain specialties, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rosterlake.operators import area_counts, bitsets, fulltext, specialties
from rosterlake.plans.catalog import query, table
from rosterlake.plans.session import checkpoint_dir
from rosterlake.streaming import area_state
from rosterlake.streaming.change_queue import ChangeQueue

# --- change queue and counts ------------------------------------------------------------------------------------------

#: Where customers practise before and after two batches of changes: the first moves one in four, the second one in six, some of them again.
_STATES_SQL = """
before AS (SELECT 'N' || c_custkey AS npi, 'S' || c_nationkey AS state, lpad((c_custkey % 40)::VARCHAR, 5, '0') AS zip5, c_mktsegment AS code FROM customer),
after AS (SELECT 'N' || c_custkey AS npi, 'S' || CASE WHEN c_custkey % 6 = 0 THEN (c_nationkey + 2) % 25 WHEN c_custkey % 4 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS state, lpad(CASE WHEN c_custkey % 6 = 0 THEN (c_custkey + 7) % 40 ELSE c_custkey % 40 END::VARCHAR, 5, '0') AS zip5, c_mktsegment AS code FROM customer WHERE c_custkey % 18 <> 0),
crossing AS (SELECT lpad(z::VARCHAR, 5, '0') AS zip5, 'C' || f AS county FROM range(40) t(z), (SELECT unnest([0, 1]) AS g), LATERAL (SELECT (z + g * 3) % 9 AS f) WHERE g = 0 OR z % 5 = 0),
kinds(code, category, subcategory) AS (VALUES ('BUILDING', 'Goods', 'Houses'), ('FURNITURE', 'Goods', 'Rooms'), ('FURNITURE', 'Rooms', 'Tables'), ('MACHINERY', 'Engines', 'Engines'))"""


def _practices(spark, sf_dir):
    """The three states of (npi, state, zip5) and the other tables of the counts."""
    c = table(spark, sf_dir, "customer")
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    zip5 = lambda z: F.lpad(z.cast("string"), 5, "0").alias("zip5")
    npi = F.concat(F.lit("N"), k).alias("npi")
    before = c.select(npi, F.concat(F.lit("S"), nation).alias("state"), zip5(k % 40))
    first = c.select(npi, F.concat(F.lit("S"), F.when(k % 4 == 0, (nation + 1) % 25).otherwise(nation)).alias("state"), zip5(k % 40))
    second = c.filter("c_custkey % 18 <> 0").select(npi, F.concat(F.lit("S"), F.when(k % 6 == 0, (nation + 2) % 25).when(k % 4 == 0, (nation + 1) % 25).otherwise(nation)).alias("state"), zip5(F.when(k % 6 == 0, (k + 7) % 40).otherwise(k % 40)))
    codes = c.select(npi, F.col("c_mktsegment").alias("taxonomy_code"))
    z = F.col("id")
    crossing = spark.range(40).select(zip5(z), F.explode(F.array_distinct(F.when(z % 5 == 0, F.array(z % 9, (z + 3) % 9)).otherwise(F.array(z % 9)))).alias("f")).select("zip5", F.concat(F.lit("C"), "f").alias("county_fips"))
    kinds = spark.createDataFrame([("BUILDING", "Goods", "Houses"), ("FURNITURE", "Goods", "Rooms"), ("FURNITURE", "Rooms", "Tables"), ("MACHINERY", "Engines", "Engines")], "code string, category string, subcategory string")
    return (before, first, second), codes, crossing, kinds


_CELLS_SQL = """
spots AS (SELECT npi, 'us' AS area_type, 'US' AS area_id, code FROM after UNION ALL SELECT npi, 'state', state, code FROM after UNION ALL SELECT npi, 'county', county, code FROM after JOIN crossing USING (zip5)),
cells AS (
  SELECT area_type, area_id, '' AS category, '' AS subcategory, npi FROM spots UNION SELECT area_type, area_id, category, '', npi FROM spots JOIN kinds USING (code) UNION SELECT area_type, area_id, category, subcategory, npi FROM spots JOIN kinds USING (code))"""


@query(f"""
WITH {_STATES_SQL}, {_CELLS_SQL},
counts AS (SELECT area_type, area_id, category, subcategory, count(DISTINCT npi) AS providers FROM cells GROUP BY ALL)
SELECT consumer, counts.* FROM counts, (VALUES ('often'), ('seldom')) c(consumer)""")
def queued_area_counts(spark, sf_dir):
    """Provider counts by area and specialty kept by two consumers of one change queue, at different offsets."""
    (before, first, second), codes, crossing, kinds = _practices(spark, sf_dir)
    root = f"{checkpoint_dir(spark)}/queue-{uuid.uuid4().hex}"
    queue = ChangeQueue(spark, root, "npi", "state string, zip5 string")

    def cells(locations):
        return area_counts.contributions(locations, codes, crossing, kinds)

    area_counts.counted(cells(before)).write.parquet(f"{root}/often/0")
    spark.read.parquet(f"{root}/often/0").write.parquet(f"{root}/seldom/0")  # both consumers begin with the same counts

    def follow(consumer, now):
        """The consumer's counts after what it takes: its old and new cells of the changed keys only."""
        taken = queue.take(consumer)
        _, built = queue.offset(consumer)
        counts = spark.read.parquet(built or f"{root}/{consumer}/0")
        place = f"{root}/{consumer}/{taken.upto}"
        area_counts.moved(counts, cells(taken.old), cells(now.join(taken.keys, "npi", "left_semi"))).write.mode("overwrite").parquet(place)
        queue.commit(taken, place)
        return spark.read.parquet(place)

    def changed(was, now):
        rows = was.withColumn("d", F.lit(1)).unionByName(now.withColumn("d", F.lit(-1)))
        return rows.groupBy("npi", "state", "zip5").agg(F.sum("d").alias("d")).filter("d <> 0").select("npi")

    queue.append(changed(before, first), before)
    follow("often", first)
    queue.append(changed(first, second), first)
    out = [follow(c, second).withColumn("consumer", F.lit(c)) for c in ("often", "seldom")]
    queue.trim(["often", "seldom"])
    return out[0].unionByName(out[1])


@query("""
SELECT o_orderpriority, year(o_orderdate) AS year, count(DISTINCT o_custkey) AS members FROM orders WHERE NOT (o_orderdate < '1998-01-01' AND o_orderkey % 5 = 0) GROUP BY ALL""")
def moved_distinct_counts(spark, sf_dir):
    """Distinct counts kept by signed rows: a member counts while a row holds it."""
    keys, member = ["o_orderpriority", "year"], "o_custkey"
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    early = F.col("o_orderdate") < "1998-01-01"
    supports = area_counts.support(o.filter(early), keys, member)
    counts = supports.groupBy(*keys).agg(F.count("*").alias("members"))
    # First a fifth of the early rows goes and half of the later ones come, then the other half.
    batches = [
        o.filter(early & (F.col("o_orderkey") % 5 == 0)).withColumn("d", F.lit(-1)).unionByName(o.filter(~early & (F.col("o_orderkey") % 2 == 0)).withColumn("d", F.lit(1))),
        o.filter(~early & (F.col("o_orderkey") % 2 == 1)).withColumn("d", F.lit(1)),
    ]
    for batch in batches:
        supports, delta = area_counts.apply_rows(supports, batch, keys, member)
        counts = area_counts.add_deltas(counts, delta, keys)
    return counts


# --- histories by area ------------------------------------------------------------------------------------------------

_EVENTS_SQL = f"""
{_STATES_SQL},
days AS (SELECT 'N' || c_custkey AS npi, CASE WHEN c_custkey % 7 > 0 THEN DATE '2023-01-15' + (c_custkey % 400)::INTEGER END AS day FROM customer),
old AS (SELECT DISTINCT npi, 'state' AS area_type, state AS area_id FROM before UNION SELECT npi, 'county', county FROM before JOIN crossing USING (zip5)),
new AS (SELECT DISTINCT npi, 'state' AS area_type, state AS area_id FROM after UNION SELECT npi, 'county', county FROM after JOIN crossing USING (zip5)),
raw AS (
  SELECT *, 'moved_out' AS kind FROM (SELECT * FROM old EXCEPT SELECT * FROM new) WHERE npi IN (SELECT npi FROM after)
  UNION ALL SELECT *, 'moved_in' FROM (SELECT * FROM new EXCEPT SELECT * FROM old) WHERE npi IN (SELECT npi FROM before)
  UNION ALL SELECT *, 'deactivated' FROM old WHERE npi NOT IN (SELECT npi FROM after)),
events AS (SELECT area_type, area_id, CASE WHEN day IS NULL THEN DATE '2024-02-01' ELSE greatest(date_trunc('month', day)::DATE, DATE '2023-07-01') END AS month, kind, npi FROM raw JOIN days USING (npi))"""


def _area_events(spark, sf_dir):
    (before, _, after), _, crossing, _ = _practices(spark, sf_dir)
    k = F.col("c_custkey")
    day = F.when(k % 7 > 0, F.date_add(F.lit("2023-01-15").cast("date"), (k % 400).cast("int")))
    days = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), k).alias("npi"), day.alias("last_update_date"), day.alias("deactivation_date"))
    listed = after.select("npi").distinct()
    open_from, as_of = F.lit("2023-07-01").cast("date"), F.lit("2024-02-10").cast("date")
    return area_counts.area_events(area_counts.areas(before, crossing), area_counts.areas(after, crossing), days.join(listed, "npi"), days.join(listed, "npi", "left_anti"), open_from, as_of)


@query(f"WITH {_EVENTS_SQL} SELECT area_type, area_id, month, kind, count(*) AS members FROM events GROUP BY ALL")
def area_month_events(spark, sf_dir):
    """Moves and deactivations by area and month, those of frozen months counted in the first open one."""
    return area_counts.monthly(_area_events(spark, sf_dir))


@query(f"""
WITH {_EVENTS_SQL}, most AS (SELECT area_type, area_id, month, kind FROM (SELECT area_type, area_id, month, kind, count(*) AS n FROM events GROUP BY ALL) ORDER BY n DESC, area_type, area_id, month, kind LIMIT 1)
SELECT npi FROM events JOIN most USING (area_type, area_id, month, kind)""")
def members_behind_count(spark, sf_dir):
    """The members behind the largest monthly count."""
    events = _area_events(spark, sf_dir)
    top = area_counts.monthly(events).orderBy(F.desc("members"), "area_type", "area_id", "month", "kind").limit(1)
    return events.join(F.broadcast(top.drop("members")), ["area_type", "area_id", "month", "kind"]).select("npi")  # one row


@query("""
WITH v AS (SELECT DISTINCT o_custkey AS npi, date_trunc('month', o_orderdate)::DATE AS period FROM orders),
p AS (SELECT DISTINCT period, CASE WHEN month(period) IN (3, 4, 9, 10, 11) THEN 'Missing' ELSE 'Completed' END AS status FROM v),
w AS (SELECT npi, period, lag(period) OVER (PARTITION BY npi ORDER BY period) AS was FROM v),
f AS (SELECT *, coalesce((SELECT max(period) FROM p WHERE status = 'Completed' AND p.period >= w.was AND p.period < w.period), was) AS file FROM w)
SELECT npi, period, coalesce((SELECT string_agg(strftime(p.period, '%Y-%m'), ' ' ORDER BY p.period) FROM p WHERE status = 'Missing' AND p.period > f.file AND p.period < f.period), '') AS missing FROM f""")
def missing_months(spark, sf_dir):
    """The months without a file that each change may date from."""
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("npi"), F.trunc("o_orderdate", "month").alias("period")).distinct()
    periods = v.select("period").distinct().withColumn("status", F.when(F.month("period").isin(3, 4, 9, 10, 11), "Missing").otherwise("Completed"))
    told = area_counts.months_without_file(v, periods, "npi", "period")
    return told.select("npi", "period", F.array_join(F.transform("missing", lambda m: F.date_format(m, "yyyy-MM")), " ").alias("missing"))


@query("""
WITH o AS (SELECT 'N' || o_custkey AS npi, date_trunc('month', o_orderdate)::DATE AS m, o_orderstatus, o_orderpriority, o_orderkey FROM orders),
v AS (SELECT npi, m, arg_max(o_orderstatus, o_orderkey) <> 'P' AS active, list_distinct(list(left(o_orderpriority, 1))) AS areas FROM o GROUP BY ALL),
n AS (SELECT *, CASE WHEN active THEN areas ELSE [] END AS now FROM v),
w AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY npi ORDER BY m), []) AS was FROM n),
d AS (SELECT m, unnest(list_filter(now, lambda a: NOT list_contains(was, a))) AS area, 1 AS delta FROM w UNION ALL SELECT m, unnest(list_filter(was, lambda a: NOT list_contains(now, a))), -1 FROM w)
SELECT area, greatest(m, DATE '1996-06-01') AS month, sum(delta)::BIGINT AS delta, count(*) AS changes FROM d GROUP BY ALL""")
def area_state_stream(spark, sf_dir):
    """Versions streamed in three files become signed counts by area and month, by keyed state."""
    root = f"{checkpoint_dir(spark)}/areas-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").withColumn("m", F.trunc("o_orderdate", "month"))
    v = o.groupBy(F.concat(F.lit("N"), "o_custkey").alias("npi"), F.col("m").alias("from_period")).agg((F.max_by("o_orderstatus", "o_orderkey") != "P").alias("active"), F.array_sort(F.collect_set(F.left("o_orderpriority", F.lit(1)))).alias("areas"))
    for n, (low, high) in enumerate((("1900-01-01", "1996-01-01"), ("1996-01-01", "1998-01-01"), ("1998-01-01", "2100-01-01"))):
        v.filter((F.col("from_period") >= low) & (F.col("from_period") < high)).write.parquet(f"{root}/versions/part={n}")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", area_state.PROVIDER)
    try:
        for n in range(3):  # a file at a time: each run goes on from the checkpoint of the one before
            stream = spark.readStream.schema(v.schema).parquet(f"{root}/versions/part={{{','.join(map(str, range(n + 1)))}}}")
            deltas = area_state.area_delta_stream(stream, "1996-06-01")
            deltas.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/deltas").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if was is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(area_state.OUTPUT).parquet(f"{root}/deltas").groupBy("area", "month").agg(F.sum("delta").alias("delta"), F.count("*").alias("changes"))


# --- full text, sets, plain specialties -------------------------------------------------------------------------------

_PLAIN = "' ' || trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"""
WITH t AS (SELECT doc_id, replace({_PLAIN}, ' ', '  ') AS t FROM documents)
SELECT doc_id, (len(regexp_extract_all(t, ' of ')) + len(regexp_extract_all(t, ' an[a-z0-9]* ')) + len(regexp_extract_all(replace(t, '  ', ' '), ' and the'))
  - len(regexp_extract_all(replace(t, '  ', ' '), ' and the[a-z0-9]')))::BIGINT AS score
FROM t WHERE contains(t, ' of ') AND regexp_matches(t, ' an[a-z0-9]* ') AND contains(t, ' and  the ') AND NOT contains(t, ' st ')""")
def full_text(spark, sf_dir):
    """Documents with a word, a prefix and a phrase, and without another word, by a positional index (scalar full text)."""
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    fulltext.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return fulltext.search(fulltext.read_index(spark, path), "doc_id", words=["of"], prefixes=["an"], phrases=["and the"], without=["st"])


@query("""
WITH s AS (SELECT DISTINCT l_returnflag AS name, l_suppkey * 40000 + l_partkey AS id FROM lineitem)
SELECT (SELECT count(DISTINCT id) FROM s) AS any_flag, (SELECT count(*) FROM (SELECT id FROM s GROUP BY id HAVING count(*) = 3)) AS all_flags,
(SELECT count(*) FROM s WHERE name = 'A') AS flag_a, (SELECT count(*) FROM (SELECT id FROM s WHERE name = 'A' INTERSECT SELECT id FROM s WHERE name = 'R')) AS a_and_r""")
def facility_sets(spark, sf_dir):
    """Sizes of a union and of intersections of sets of ids, as bitmaps."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), (F.col("l_suppkey") * 40000 + F.col("l_partkey")).alias("id"))
    sets = bitsets.bitmaps(s, "name", "id")
    a, ar = sets.filter("name = 'A'"), sets.filter("name in ('A', 'R')")
    parts = [("any_flag", bitsets.union(sets)), ("all_flags", bitsets.intersection(sets, "name", 3)), ("flag_a", a), ("a_and_r", bitsets.intersection(ar, "name", 2))]
    rows = [bitsets.count(df).select(F.lit(n).alias("what"), "members") for n, df in parts]
    told = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return told.agg(*(F.max(F.when(F.col("what") == n, F.col("members"))).alias(n) for n, _ in parts))


_RULES = [("economy", "Goods", "Cheap", 2), ("STANDARD", "Goods", "Plain", 1), ("STANDARD", "Trade", "Plain", 2), ("PROMO", "Trade", "Offers", 1), ("PROMO", "Goods", "Cheap", 2), ("LARGE", "Sizes", "Large", 1)]


@query(f"""
WITH rules(code, category, subcategory, rank) AS (VALUES {', '.join(map(str, _RULES))}),
m AS (SELECT DISTINCT l_suppkey, p_type AS code FROM lineitem JOIN part ON p_partkey = l_partkey),
p AS (SELECT DISTINCT l_suppkey, coalesce(category, 'Other') AS category, CASE WHEN category IS NULL THEN 'Other' ELSE subcategory END AS subcategory FROM m LEFT JOIN rules ON upper(rules.code) = upper(m.code))
SELECT 'all' AS level, NULL AS category, NULL AS subcategory, count(DISTINCT l_suppkey) AS members FROM p UNION ALL SELECT 'category', category, NULL, count(DISTINCT l_suppkey) FROM p GROUP BY category
UNION ALL SELECT 'subcategory', category, subcategory, count(DISTINCT l_suppkey) FROM p GROUP BY category, subcategory""")
def specialty_breakdown(spark, sf_dir):
    """Members by plain name, category and in all, each once at each level (A25, UDF plain specialty placement)."""
    rules = spark.createDataFrame(_RULES, "code string, category string, subcategory string, rank int")
    m = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", F.col("p_type").alias("code")).distinct()
    return specialties.breakdown(m, rules, "l_suppkey")


@query(f"""
WITH rules(code, category, subcategory, rank) AS (VALUES {', '.join(map(str, _RULES))}), b AS (SELECT upper(code) AS code, arg_min(category, rank) AS category, arg_min(subcategory, rank) AS subcategory FROM rules GROUP BY 1)
SELECT coalesce(category, 'Other') AS category, coalesce(subcategory, 'Other') AS subcategory, count(*) AS members FROM part LEFT JOIN b ON code = upper(p_type) GROUP BY 1, 2""")
def specialties_shown(spark, sf_dir):
    """Members under the main plain name of their code (UDF plain specialty placement)."""
    rules = spark.createDataFrame(_RULES, "code string, category string, subcategory string, rank int")
    return specialties.shown(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("code")), rules, "p_partkey")
