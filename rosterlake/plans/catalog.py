"""Every registry query with its DuckDB twin, keyed by a stable name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import geo, text
from rosterlake.operators import aggregate, filters, linkage, quality, ranking, reshape, temporal, upsert
from rosterlake.operators.ranking import top_n

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH paid AS (
  SELECT l_suppkey, l_partkey, round(sum(coalesce(l_extendedprice, 0)), 2) AS amount, count(*) AS payments
  FROM lineitem WHERE l_suppkey IN (
    SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
  GROUP BY ALL)
SELECT l_suppkey, l_partkey, amount, payments, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY amount DESC, l_partkey) AS rn FROM paid)
WHERE rn <= 3""")
def top_parts_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 payers per recipient: filter suppliers by region, sum, rank."""
    asia = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region").filter(F.col("r_name") == "ASIA"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    )
    suppliers = table(spark, sf_dir, "supplier").join(asia, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    paid = (
        table(spark, sf_dir, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.round(F.sum(F.coalesce("l_extendedprice", F.lit(0.0))), 2).alias("amount"), F.count("*").alias("payments"))
    )
    return top_n(paid, ["l_suppkey"], [F.desc("amount"), F.asc("l_partkey")], 3, "rank")


# --- filters (F*, J02-J04, J35) ---------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')")
def semi_filter(spark, sf_dir):
    """Customers at a place of a region: two-hop semi join."""
    europe = table(spark, sf_dir, "region").filter("r_name = 'EUROPE'")
    nations = filters.having(table(spark, sf_dir, "nation"), europe, {"n_regionkey": "r_regionkey"})
    return filters.having(table(spark, sf_dir, "customer"), nations, {"c_nationkey": "n_nationkey"}).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_filter(spark, sf_dir):
    """Customers without a pending order; customers without any order stay (F17, F24 notStale, J03)."""
    return filters.lacking(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"}, F.col("o_orderstatus") == "P").select("c_custkey", "c_name")


@query("""
SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity >= 49)
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.0999 AND l_tax > 0.0799)""")
def tri_state_flags(spark, sf_dir):
    """Wanted and unwanted flags together, unset ones ignored."""
    items, out = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    for wanted, where in ((True, "l_returnflag = 'R' and l_quantity >= 49"), (False, "l_discount > 0.0999 and l_tax > 0.0799"), (None, "false")):
        out = filters.flag(out, items, {"s_suppkey": "l_suppkey"}, wanted, F.expr(where))
    return out.select("s_suppkey", "s_name")


@query("""
SELECT c_custkey, c_name FROM customer WHERE starts_with(lower(strip_accents(c_name)), 'customer#00000010') AND c_acctbal BETWEEN 0 AND 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def prefix_and_range(spark, sf_dir):
    """Folded prefix, range and list predicates."""
    c = table(spark, sf_dir, "customer")
    return c.filter(F.startswith(text.fold(F.col("c_name")), F.lit("customer#00000010")) & F.col("c_acctbal").between(0, 9000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - 90""")
def new_within_days(spark, sf_dir):
    """Rows of the 90 days before the data date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    last = o.agg(F.max("day").alias("last"))
    return o.join(F.broadcast(last)).filter(F.col("day") >= F.date_sub("last", 90)).select("o_orderkey", "day")  # one row


@query("""
WITH w AS (SELECT p_partkey, p_name, list_filter(string_split(trim(regexp_replace(replace(lower(strip_accents(p_name)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM part)
SELECT p_partkey, p_name FROM w WHERE len(list_filter(t, lambda x: starts_with(x, 'r'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'w'))) > 0""")
def words_all_prefix(spark, sf_dir):
    """Every asked word begins some word of the name."""
    asked = ["r", "w"]
    words = text.tokens(F.col("p_name"))
    return table(spark, sf_dir, "part").filter(F.forall(F.array(*map(F.lit, asked)), lambda q: F.exists(words, lambda w: F.startswith(w, q)))).select("p_partkey", "p_name")


@query("""
WITH pts AS (SELECT vec_id, embedding[1]::DOUBLE * 90 AS lat, embedding[2]::DOUBLE * 180 AS lon FROM embeddings),
d AS (SELECT vec_id, 2 * 3958.8 * asin(sqrt(least(pow(sin(radians(lat - 5) / 2), 2) + cos(radians(5)) * cos(radians(lat)) * pow(sin(radians(lon - 10) / 2), 2), 1))) AS miles FROM pts)
SELECT vec_id, round(miles, 3) AS miles FROM d WHERE miles <= 900""")
def radius_search(spark, sf_dir):
    """Box first, then great-circle distance."""
    p = points(spark, sf_dir)
    near = p.filter(geo.within(F.col("lat"), F.col("lon"), (5.0, 10.0), 900.0))
    return near.select("vec_id", F.round(geo.haversine(F.lit(5.0), F.lit(10.0), F.col("lat"), F.col("lon")), 3).alias("miles"))


def points(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", (e[0].cast("double") * 90).alias("lat"), (e[1].cast("double") * 180).alias("lon"))


@query("""
SELECT vec_id, CAST(floor((embedding[1]::DOUBLE * 90 + 90) * 10) * 3600 + floor((embedding[2]::DOUBLE * 180 + 180) * 10) AS BIGINT) AS cell FROM embeddings""")
def grid_cell(spark, sf_dir):
    """0.1 degree grid cells."""
    return points(spark, sf_dir).select("vec_id", geo.cell(F.col("lat"), F.col("lon")).alias("cell"))


@query("""
WITH pts AS (SELECT vec_id, embedding[1]::DOUBLE * 90 AS lat, embedding[2]::DOUBLE * 180 AS lon FROM embeddings)
SELECT a.vec_id, count(*) AS near FROM pts a JOIN pts b ON a.vec_id <> b.vec_id AND abs(floor(a.lat / 5) - floor(b.lat / 5)) <= 1 AND abs(floor(a.lon / 5) - floor(b.lon / 5)) <= 1
WHERE sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 5 GROUP BY a.vec_id""")
def near_points_by_cell(spark, sf_dir):
    """Points within a distance: nine neighbour cells as an equi join, then the exact test."""
    p = points(spark, sf_dir)
    a = p.select(F.col("vec_id"), F.col("lat").alias("y"), F.col("lon").alias("x"), F.explode(linkage.nearby_cells(F.col("lat"), F.col("lon"), 5.0)).alias("cell"))
    b = p.select(F.col("vec_id").alias("other"), "lat", "lon", F.struct(F.floor(F.col("lat") / 5.0).alias("r"), F.floor(F.col("lon") / 5.0).alias("c")).alias("cell"))
    met = a.join(b, "cell").filter((F.col("vec_id") != F.col("other")) & (F.sqrt(F.pow(F.col("lat") - F.col("y"), 2) + F.pow(F.col("lon") - F.col("x"), 2)) <= 5))
    return met.groupBy("vec_id").agg(F.count("*").alias("near"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("""
SELECT c_custkey, c_name, coalesce(n_orders, 0)::BIGINT AS n_orders, coalesce(total, 0) AS total, coalesce(n_orders, 0) > 0 AS active FROM customer LEFT JOIN (
SELECT o_custkey, count(*) AS n_orders, round(sum(coalesce(o_totalprice, 0)), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def summary_flags(spark, sf_dir):
    """Enrichment by pre-aggregated left joins."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), aggregate.money("o_totalprice").alias("total"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("total", F.lit(0.0)).alias("total"), (F.coalesce("n_orders", F.lit(0)) > 0).alias("active"))


@query("""
SELECT p.p_partkey, coalesce(a.v, b.v, c.v) AS price, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 END AS matched_by FROM part p
LEFT JOIN (SELECT p_brand, p_size, round(max(p_retailprice), 2) AS v FROM part WHERE p_size > 40 GROUP BY ALL) a ON a.p_brand = p.p_brand AND a.p_size = p.p_size
LEFT JOIN (SELECT p_type, round(max(p_retailprice), 2) AS v FROM part WHERE p_size < 10 GROUP BY ALL) b ON b.p_type = p.p_type
LEFT JOIN (SELECT p_brand, round(max(p_retailprice), 2) AS v FROM part WHERE p_brand < 'Brand#3' GROUP BY ALL) c ON c.p_brand = p.p_brand""")
def best_source_fallback(spark, sf_dir):
    """The first of several sources that knows the key."""
    p = table(spark, sf_dir, "part")
    v = F.round(F.max("p_retailprice"), 2).alias("price")
    lookups = [
        (p.filter("p_size > 40").groupBy("p_brand", "p_size").agg(v), {"p_brand": "p_brand", "p_size": "p_size"}),
        (p.filter("p_size < 10").groupBy("p_type").agg(v), {"p_type": "p_type"}),
        (p.filter("p_brand < 'Brand#3'").groupBy("p_brand").agg(v), {"p_brand": "p_brand"}),
    ]
    return linkage.first_match(p.select("p_partkey", "p_brand", "p_size", "p_type"), lookups, "price").select("p_partkey", "price", "matched_by")


@query("""
WITH y AS (SELECT c_custkey, year(o_orderdate) AS y, count(*) AS n, max(o_orderpriority) AS top FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL),
a AS (SELECT * FROM y WHERE y = 1996), b AS (SELECT * FROM y WHERE y = 1997)
SELECT c_custkey, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'gone' ELSE 'changed' END AS change, a.n AS old_n, a.top AS old_top, b.n AS new_n, b.top AS new_top
FROM a FULL JOIN b USING (c_custkey) WHERE a.n IS DISTINCT FROM b.n OR a.top IS DISTINCT FROM b.top""")
def row_diff(spark, sf_dir):
    """New, gone and changed keys between two states, null-safe."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))

    def year(n):
        return o.filter(F.year("o_orderdate") == n).groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("top"))

    return temporal.row_diff(year(1996), year(1997), ["c_custkey"], ["n", "top"])


@query("""
WITH b AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS brand FROM part WHERE p_size <= 5), c AS (SELECT p_partkey, lower(p_name) AS name FROM part)
SELECT brand, count(*) AS parts, min(p_partkey) AS first_part FROM b JOIN c ON name = brand OR starts_with(name, brand || ' ') GROUP BY brand""")
def brand_prefix_join(spark, sf_dir):
    """Equal, or begins with the brand and a space: first-word equi join with the test as residual."""
    p = table(spark, sf_dir, "part")
    brands = p.filter("p_size <= 5").select(F.lower(F.split("p_name", " ")[0]).alias("brand")).distinct()
    met = linkage.prefix_join(brands, p.select("p_partkey", F.lower("p_name").alias("name")), "brand", "name")
    return met.groupBy("brand").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query("""
SELECT c_nationkey, c_mktsegment, c_custkey FROM (
SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY (c_acctbal > 5000) DESC, c_custkey) AS rn FROM customer WHERE c_acctbal > 0) WHERE rn = 1""")
def one_per_organisation(spark, sf_dir):
    """One row per group among the rows that match: the main member if it matches, else the least key."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").withColumn("org", F.concat_ws("/", "c_nationkey", "c_mktsegment"))
    return linkage.one_per_group(c, "org", F.col("c_acctbal") > 5000, "c_custkey").select("c_nationkey", "c_mktsegment", "c_custkey")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('R', 'A') THEN p_brand END AS brand FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey AND l_returnflag IN ('R', 'A')""")
def decode_some_rows(spark, sf_dir):
    """A decode join for some row types only."""
    items = table(spark, sf_dir, "lineitem").withColumn("_code", F.when(F.col("l_returnflag").isin("R", "A"), F.col("l_partkey")))
    return items.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("_code") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.col("p_brand").alias("brand"))


@query("""
SELECT c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, CAST(min(o_orderdate) AS DATE) AS first_day FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def first_child(spark, sf_dir):
    """The first child row of each key by aggregation instead of a correlated minimum."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.min("o_orderdate").cast("date").alias("first_day"))
    return filters.having(first, table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}).select(F.col("o_custkey").alias("c_custkey"), "first_order", "first_day")


# --- aggregations -----------------------------------------------------------------------------------------------------


@query("""
SELECT l_suppkey, coalesce(l_returnflag, 'Not specified') AS nature, round(sum(coalesce(l_extendedprice, 0)), 2) AS amount, count(*) AS payments FROM lineitem GROUP BY ALL""")
def nature_sums(spark, sf_dir):
    """Money per key and nature."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", aggregate.named_nature("l_returnflag").alias("nature")).agg(aggregate.money("l_extendedprice").alias("amount"), F.count("*").alias("payments"))


@query("""
SELECT l_suppkey, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END), 2) AS open_amount, round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END), 2) AS final_amount FROM lineitem GROUP BY 1""")
def conditional_sums(spark, sf_dir):
    """Sums by type as columns."""
    return reshape.conditional_sums(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linestatus", "l_extendedprice", {"O": "open_amount", "F": "final_amount"})


@query("""
SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderstatus = 'O') AS open, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) END) AS final_years,
bool_or(o_totalprice > 300000) AS large FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def conditional_counts(spark, sf_dir):
    """Conditional and distinct counts with a floor."""
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_distinct("o_orderpriority").alias("priorities"),
        F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate"))).alias("final_years"), aggregate.any_of(F.col("o_totalprice") > 300000).alias("large"), F.count("*").alias("n"),
    )
    return out.filter("n >= 3").drop("n")


@query("""
SELECT l_orderkey, l_partkey, max(l_returnflag) AS flag, min(l_linestatus) AS status, max(l_shipdate) AS shipped, max(l_tax) AS tax, coalesce(max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END), 0) = 1 AS large FROM lineitem GROUP BY ALL""")
def collapsed_rows(spark, sf_dir):
    """Rows that repeat a key collapsed to one by MAX and MIN of each column."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.max("l_shipdate").alias("shipped"), F.max("l_tax").alias("tax"), aggregate.any_of(F.col("l_quantity") > 25).alias("large")
    )


@query("""
SELECT l_suppkey, l_returnflag AS nature, round(amount, 2) AS amount FROM (
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY amount DESC, n DESC, l_returnflag) AS rn FROM (
SELECT l_suppkey, l_returnflag, sum(l_extendedprice) AS amount, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL)) WHERE rn = 1""")
def mode_value(spark, sf_dir):
    """The most used value by amount, rows, then text."""
    return ranking.mode_value(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "l_extendedprice").select("l_suppkey", F.col("l_returnflag").alias("nature"), F.round("amount", 2).alias("amount"))


@query("""
SELECT r_name, n_name, c_mktsegment, count(DISTINCT o_custkey) AS customers, CAST(GROUPING_ID(r_name, n_name, c_mktsegment) AS BIGINT) AS grouping
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((), (r_name), (r_name, n_name), (c_mktsegment), (r_name, c_mktsegment), (r_name, n_name, c_mktsegment))""")
def area_rollup(spark, sf_dir):
    """Distinct keys per area level and kind."""
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    wide = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return aggregate.area_rollup(wide, [[], ["r_name"], ["r_name", "n_name"]], [[], ["c_mktsegment"]], "o_custkey", "customers").select("r_name", "n_name", "c_mktsegment", "customers", "grouping")


@query("""
SELECT o_custkey, CAST(bit_or((CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) | (CASE WHEN o_totalprice > 200000 THEN 2 ELSE 0 END) | (CASE WHEN o_orderpriority = '1-URGENT' THEN 4 ELSE 0 END)) AS INTEGER) AS activity FROM orders GROUP BY 1""")
def bitmask_or(spark, sf_dir):
    """Evidence bits per key."""
    return aggregate.bit_or_of(table(spark, sf_dir, "orders"), ["o_custkey"], {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 200000, "urgent": F.col("o_orderpriority") == "1-URGENT"}, "activity")


@query("""
SELECT l_orderkey, md5(array_to_string(list_sort(list(md5(coalesce(l_partkey::VARCHAR, chr(0)) || chr(31) || coalesce(l_returnflag, chr(0))))), ',')) AS hash FROM lineitem GROUP BY 1""")
def multiset_hash(spark, sf_dir):
    """An order-free content hash of child rows."""
    return aggregate.multiset_hash(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_partkey", "l_returnflag"])


@query("""
WITH x AS (SELECT l_suppkey AS a, (l_partkey % 100) AS b, year(l_shipdate) AS y, l_extendedprice AS v FROM lineitem),
r AS (SELECT a AS id, y, v, a = b AS twice, true AS one FROM x UNION ALL SELECT b, y, v, false, false FROM x WHERE a <> b)
SELECT id, CAST(y AS INTEGER) AS y, round(sum(CASE WHEN one THEN v ELSE 0 END), 2) AS as_one, round(sum(CASE WHEN twice OR NOT one THEN v ELSE 0 END), 2) AS as_two, round(sum(CASE WHEN twice THEN v ELSE 0 END), 2) AS as_both, round(sum(v), 2) AS any_role FROM r GROUP BY ALL""")
def two_role_sums(spark, sf_dir):
    """Billing plus servicing less both: equal roles count once."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), F.year("l_shipdate").alias("y"), F.col("l_extendedprice").alias("v"))
    return aggregate.two_role_sums(x, "a", "b", "y", "v")


@query("""
SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS band, count(*) AS customers, sum(n)::BIGINT AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def size_bands(spark, sf_dir):
    """Size bands."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.groupBy(aggregate.bands(F.col("n"), [5, 10, 20], ["1-5", "6-10", "11-20", "21+"]).alias("band")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS customers, round(avg(c_acctbal), 4) AS mean_balance, median(c_acctbal) AS median_balance, round(count(DISTINCT CASE WHEN o_orderkey IS NOT NULL THEN c_custkey END) * 100000.0 / count(DISTINCT c_custkey), 1) AS active_rate
FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def area_profile(spark, sf_dir):
    """Counts, averages, medians and rates per place."""
    active = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(active, F.col("o_custkey") == F.col("c_custkey"), "left")
    g = c.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.median("c_acctbal").alias("median_balance"), F.count("o_custkey").alias("active"))
    return g.withColumn("active_rate", aggregate.rate_per(F.col("active"), F.col("customers"))).drop("active")


@query("""
SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1""")
def ordered_list(spark, sf_dir):
    """Ordered string aggregation (A10)."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", ").alias("priorities"))


@query("""
SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice * (1 + o_orderkey % 3)) , 2) AS weighted, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders""")
def overview(spark, sf_dir):
    """Whole-table counts and sums, plain and weighted."""
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), aggregate.money("o_totalprice").alias("total"), aggregate.money(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3)).alias("weighted"),
        F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"),
    )


# --- windows, sorts, pages --------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_row_per_key(spark, sf_dir):
    """The newest row per key."""
    return ranking.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS b FROM lineitem) WHERE a <= 10 OR b <= 10""")
def dual_rank(spark, sf_dir):
    """The most serious or the newest ten."""
    items, tie = table(spark, sf_dir, "lineitem"), [F.asc("l_orderkey"), F.asc("l_linenumber")]
    keys = ["l_suppkey", "l_orderkey", "l_linenumber"]
    serious = ranking.top_n(items, ["l_suppkey"], [F.desc("l_extendedprice"), *tie], 10).select(*keys)
    newest = ranking.top_n(items, ["l_suppkey"], [F.desc("l_shipdate"), *tie], 10).select(*keys)
    return serious.unionByName(newest).distinct()


@query("""
WITH y AS (SELECT l_suppkey, l_partkey, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS paid, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, max(y) AS y FROM y GROUP BY 1)
SELECT l_suppkey, l_partkey, paid, n FROM (SELECT y.*, row_number() OVER (PARTITION BY l_suppkey ORDER BY paid DESC, n DESC, l_partkey) AS rn FROM y JOIN m USING (l_suppkey, y)) WHERE rn <= 5""")
def top_in_newest_year(spark, sf_dir):
    """Top five of the key's newest year."""
    y = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y")).agg(aggregate.money("l_extendedprice").alias("paid"), F.count("*").alias("n"))
    newest = y.groupBy("l_suppkey").agg(F.max("y").alias("y"))
    return ranking.top_n(y.join(newest, ["l_suppkey", "y"]), ["l_suppkey"], [F.desc("paid"), F.desc("n"), F.asc("l_partkey")], 5).select("l_suppkey", "l_partkey", "paid", "n")


@query("SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 50")
def page_with_total(spark, sf_dir):
    """The second page of fifty with the total."""
    return ranking.page(table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 2)


@query("""
WITH pts AS (SELECT vec_id, sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)) AS d FROM embeddings),
r AS (SELECT CASE WHEN count(*) FILTER (d <= 0.02) >= 30 THEN 0.02 WHEN count(*) FILTER (d <= 0.05) >= 30 THEN 0.05 WHEN count(*) FILTER (d <= 0.1) >= 30 THEN 0.1 ELSE 0.25 END::DOUBLE AS radius FROM pts)
SELECT vec_id, radius FROM pts, r WHERE d <= radius""")
def widening_radius(spark, sf_dir):
    """The smallest radius that holds thirty rows."""
    e = F.col("embedding")
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.sqrt(F.pow(e[0].cast("double"), 2) + F.pow(e[1].cast("double"), 2)).alias("d"))
    return ranking.widening(p, "d", [0.02, 0.05, 0.1, 0.25], 30).select("vec_id", "radius")


@query("""
SELECT CAST(i AS INTEGER) AS position, k::BIGINT AS requested, c_name, c_custkey IS NOT NULL AS known FROM (SELECT unnest([7, 3, 99999999, 3, 12]) AS k, generate_subscripts([7, 3, 99999999, 3, 12], 1) - 1 AS i) LEFT JOIN customer ON c_custkey = k""")
def bulk_lookup(spark, sf_dir):
    """Status per requested key, in request order, unknown and repeated ones too."""
    return ranking.in_request_order([7, 3, 99999999, 3, 12], table(spark, sf_dir, "customer"), "c_custkey").select("position", "requested", "c_name", "known")


# --- reshaping, sets, JSON, HTML --------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, slot::INTEGER AS slot, kind, v AS value FROM (SELECT l_orderkey, l_linenumber, unnest([1, 2, 3]) AS slot, unnest(['discount', 'tax', 'quantity']) AS kind, unnest([l_discount, l_tax, l_quantity]) AS v FROM lineitem) WHERE v IS NOT NULL""")
def unpivot_measures(spark, sf_dir):
    """Slots to rows by one generator."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(x for c in ("discount", "tax", "quantity") for x in (F.lit(c).alias(f"{c}_kind"), F.col(f"l_{c}"))))
    return reshape.unpivot_slots(items, ["l_orderkey", "l_linenumber"], [{"kind": f"{c}_kind", "value": f"l_{c}"} for c in ("discount", "tax", "quantity")], need="value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_extract(spark, sf_dir):
    """Typed JSON fields by schema."""
    return table(spark, sf_dir, "events").withColumn("j", F.from_json("props", "k long")).filter("j.k is not null").select("event_id", F.col("j.k").alias("k"), "event_type")


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]+)"', 1))::INTEGER AS links FROM pages""")
def html_links(spark, sf_dir):
    """Titles and link counts of scraped pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("links"))


@query("""
SELECT DISTINCT key, place FROM (SELECT c_custkey AS key, c_nationkey AS place FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def union_membership(spark, sf_dir):
    """Distinct union of typed memberships."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("place"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("place"))
    return c.unionByName(s).distinct()


@query("""
WITH o AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y FROM orders)
SELECT o_custkey, o_orderpriority, sum(CASE WHEN y = 1997 THEN 1 ELSE -1 END)::BIGINT AS delta FROM o WHERE y IN (1996, 1997) GROUP BY 1, 2 HAVING sum(CASE WHEN y = 1997 THEN 1 ELSE -1 END) <> 0""")
def signed_delta(spark, sf_dir):
    """Symmetric difference by signed union."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return temporal.signed_delta(o.filter("y = 1996"), o.filter("y = 1997"), ["o_custkey", "o_orderpriority"])


# --- time -------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, count(*) AS orders FROM orders GROUP BY ALL")
def monthly_counts(spark, sf_dir):
    """Tumbling months."""
    return table(spark, sf_dir, "orders").groupBy(temporal.month(F.col("o_orderdate")).alias("month"), "o_orderstatus").agg(F.count("*").alias("orders"))


@query("""
SELECT CAST(CASE WHEN o_orderdate IS NULL THEN DATE '1998-07-01' ELSE greatest(date_trunc('month', o_orderdate), DATE '1998-06-01') END AS DATE) AS month, count(*) AS orders FROM orders GROUP BY 1""")
def late_events_redated(spark, sf_dir):
    """Late events count in the first open month; none is dropped."""
    m = temporal.open_month(F.col("o_orderdate"), F.lit("1998-06-01").cast("date"), F.lit("1998-07-15").cast("date"))
    return table(spark, sf_dir, "orders").groupBy(m.alias("month")).agg(F.count("*").alias("orders"))


@query("""
WITH p AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 20 + CAST(o_orderkey % 30 AS INTEGER) AS e FROM orders),
b AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s - m > 31 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM b)
SELECT id, min(s) AS s, max(e) AS e, count(*) AS parts FROM g GROUP BY id, grp""")
def interval_merge(spark, sf_dir):
    """Periods merged over gaps of up to 31 days."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("s"), F.date_add(F.col("o_orderdate").cast("date"), (20 + F.col("o_orderkey") % 30).cast("int")).alias("e"))
    return temporal.merge_periods(p, ["id"], "s", "e", 31)


@query("""
WITH x AS (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT * FROM x WHERE rn = 1 OR was IS DISTINCT FROM event_type)
SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM s""")
def scd2_versions(spark, sf_dir):
    """Runs of equal state as versions."""
    v = temporal.versions(table(spark, sf_dir, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], ["event_type"], "ts")
    return v.select("user_id", "event_type", "valid_from", "valid_to")


@query("""
WITH x AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events), g AS (SELECT *, sum(CASE WHEN was IS NULL OR epoch_us(ts) - epoch_us(was) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x)
SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM g GROUP BY 1, 2""")
def sessionize(spark, sf_dir):
    """Sessions with half-hour gaps."""
    return temporal.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 1800)


@query("""
WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT min(month) AS a, max(month) AS b FROM m), k AS (SELECT o_custkey, min(month) AS a, max(month) AS b FROM m GROUP BY 1)
SELECT k.o_custkey, d::DATE AS month, CASE WHEN d BETWEEN k.a AND k.b THEN coalesce(n, 0) END::BIGINT AS n
FROM k CROSS JOIN (SELECT unnest(generate_series(s.a::TIMESTAMP, s.b::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM s) x LEFT JOIN m ON m.o_custkey = k.o_custkey AND m.month = x.d::DATE""")
def series_fill(spark, sf_dir):
    """A month spine for each customer: 0 inside its span, null outside."""
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", temporal.month(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))
    return temporal.fill_months(m, ["o_custkey"], "month", "n")


@query("""
WITH m AS (SELECT o_orderstatus AS kind, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL)
SELECT kind, month, n, CASE WHEN lag(year(month)) OVER w = year(month) THEN n - lag(n) OVER w END AS net FROM m WINDOW w AS (PARTITION BY kind ORDER BY month)""")
def net_change(spark, sf_dir):
    """Month over month, null where the definition breaks."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), temporal.month(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n")).withColumn("basis", F.year("month"))
    return temporal.net_change(m, ["kind"], "month", "n", "basis").drop("basis")


@query("""
WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), i AS (SELECT o_custkey, min(y) AS a, max(y) AS b FROM (SELECT *, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS g FROM y) GROUP BY o_custkey, g)
SELECT o_custkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS years FROM i GROUP BY 1""")
def version_spans(spark, sf_dir):
    """Years of activity as text."""
    return temporal.year_spans(table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y")), ["o_custkey"], "y")


@query("""
WITH x AS (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT * FROM x WHERE rn = 1 OR was IS DISTINCT FROM event_type),
v AS (SELECT user_id, event_type, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s)
SELECT event_type, count(*) AS users FROM v WHERE a <= TIMESTAMP '2024-01-15 00:00:00' AND (b IS NULL OR b > TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1""")
def as_of_versions(spark, sf_dir):
    """The version in force at a moment."""
    v = temporal.versions(table(spark, sf_dir, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], ["event_type"], "ts")
    return temporal.as_of(v, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("users"))


# --- text and linkage -------------------------------------------------------------------------------------------------


#: Company names made of a part's name and number, with suffixes, signs and accents.
COMPANY_SQL = """CASE p_partkey % 7 WHEN 0 THEN concat(p_name, ', Inc. / DE') WHEN 1 THEN concat('The ', p_name, ' Company') WHEN 2 THEN concat(p_name, ' USA, LLC') WHEN 3 THEN concat('O’', p_name, '-', p_type) WHEN 4 THEN concat(p_type, ' é&co ', p_name) WHEN 5 THEN concat('a of ', p_partkey % 50) ELSE concat('GmbH ', upper(p_name)) END"""


@query(rf"""
WITH n AS (SELECT p_partkey, {COMPANY_SQL} AS name FROM part),
w AS (SELECT p_partkey, list_filter(string_split(regexp_replace(regexp_replace(upper(strip_accents(regexp_replace(name, '\s*/\s*[A-Za-z]{{2,3}}\s*$', ''))), '’', '', 'g'), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 1 AND x NOT IN (
'INC', 'INCORPORATED', 'CORP', 'CORPORATION', 'CO', 'COMPANY', 'COMPANIES', 'LLC', 'LP', 'LLP', 'LTD', 'LIMITED', 'PLC', 'SA', 'AG', 'NV', 'BV', 'GMBH', 'SPA', 'SRL', 'SAS', 'AB', 'AS', 'OY', 'KK', 'PTY', 'PC', 'PA', 'PLLC', 'DBA', 'THE', 'AND', 'OF')) AS t FROM n),
k AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(t)), ' ') AS name_key FROM w)
SELECT p_partkey, CASE WHEN length(name_key) >= 3 THEN name_key END AS name_key FROM k""")
def name_key(spark, sf_dir):
    """Company name keys."""
    return table(spark, sf_dir, "part").select("p_partkey", text.name_key(F.expr(COMPANY_SQL)).alias("name_key"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, upper(regexp_replace(strip_accents(p_name), '[^A-Za-z0-9]', '', 'g')) AS letters FROM part""")
def slugs(spark, sf_dir):
    """Slugs and letter keys."""
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.letters_key(F.col("p_name")).alias("letters"))


@query(r"""
WITH w AS (SELECT DISTINCT unnest(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM part),
l AS (SELECT w, regexp_replace(upper(w), '[^A-Z]', '', 'g') AS t FROM w),
c AS (SELECT w, t, left(t, 1) AS f, translate(left(t, 1) || regexp_replace(substr(t, 2), '[AEIOUYHW]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556') AS d FROM l),
r AS (SELECT w, t, f, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS d FROM c),
k AS (SELECT w, t, f, regexp_replace(CASE WHEN left(d, 1) = translate(f, 'BFPVCGJKQSXZDTLMNR', '111122222222334556') THEN substr(d, 2) ELSE d END, '[A-Z]', '', 'g') AS d FROM r)
SELECT CASE WHEN t = '' THEN '' ELSE rpad(left(f || d, 4), 4, '0') END AS sounds, count(*) AS words, min(w) AS first_word FROM k GROUP BY 1""")
def phonetic_names(spark, sf_dir):
    """Groups of names that sound alike."""
    words = table(spark, sf_dir, "part").select(F.explode(text.tokens(F.col("p_name"))).alias("w")).distinct()
    return words.groupBy(text.phonetic_key(F.col("w")).alias("sounds")).agg(F.count("*").alias("words"), F.min("w").alias("first_word"))


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 3 AS b FROM customer WHERE c_custkey % 60 < 54 AND c_custkey + 3 IN (SELECT c_custkey FROM customer)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS id, a AS seen FROM both_ways UNION SELECT r.id, t.b FROM reach r JOIN both_ways t ON t.a = r.seen)
SELECT id, min(seen) AS "group" FROM reach GROUP BY id""")
def connected_groups(spark, sf_dir):
    """Organisation groups by ties in chains of twenty."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    edges = c.filter("c_custkey % 60 < 54").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 3).alias("b"))  # the rule of the chains
    return linkage.connected_groups(filters.having(edges, c, {"b": "c_custkey"}))


@query("""
SELECT c_custkey, first_value(c_custkey) OVER w AS main, c_custkey = first_value(c_custkey) OVER w AS is_main, count(*) OVER (PARTITION BY c_nationkey) AS members FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY (c_acctbal > 5000)::INT * 4 + (c_mktsegment = 'BUILDING')::INT DESC, c_acctbal DESC, c_custkey)""")
def main_member(spark, sf_dir):
    """Each member's main one by tier, basis, freshness, key."""
    rank = (F.col("c_acctbal") > 5000).cast("int") * 4 + (F.col("c_mktsegment") == "BUILDING").cast("int")
    return linkage.ranked_main(table(spark, sf_dir, "customer"), "c_nationkey", rank, "c_acctbal", "c_custkey").select("c_custkey", "main", "is_main", "members")


@query("""
WITH s AS (SELECT o_custkey, max(o_orderdate) AS last, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_totalprice > 300000) AS big FROM orders GROUP BY 1),
r AS (SELECT c_custkey, (CASE WHEN last IS NULL THEN 1 ELSE 0 END) | (CASE WHEN last < TIMESTAMP '1996-01-01' THEN 2 ELSE 0 END) | (CASE WHEN p > 0 THEN 4 ELSE 0 END) | (CASE WHEN c_acctbal < 0 THEN 8 ELSE 0 END) AS reasons, CASE WHEN big > 0 THEN 1 ELSE 0 END AS activity FROM customer LEFT JOIN s ON o_custkey = c_custkey)
SELECT c_custkey, CAST(reasons AS INTEGER) AS reasons, CAST(activity AS INTEGER) AS activity, CAST(CASE WHEN (reasons & 2) <> 0 AND activity = 0 THEN 3 WHEN (reasons & 12) <> 0 OR ((reasons & 1) <> 0 AND activity = 0) THEN 2 ELSE 1 END AS INTEGER) AS label FROM r""")
def quality_label(spark, sf_dir):
    """Signs to reasons to a label: current, check, stale."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_totalprice") > 300000).alias("big"))
    c = table(spark, sf_dir, "customer").join(s, F.col("c_custkey") == F.col("o_custkey"), "left")
    reasons = quality.mask([F.col("last").isNull(), F.col("last") < F.lit("1996-01-01").cast("timestamp_ntz"), F.col("p") > 0, F.col("c_acctbal") < 0])
    c = c.select("c_custkey", reasons.alias("reasons"), F.when(F.col("big") > 0, 1).otherwise(0).alias("activity"))
    return c.withColumn("label", quality.label(F.col("reasons"), F.col("activity"), stale=2, check=12, check_if_idle=1))


@query("""
SELECT c_custkey, c_name, n_name, '[' || string_agg('{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}', ',' ORDER BY o_orderkey) || ']' AS orders, count(*) AS n_orders
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def detail_nested(spark, sf_dir):
    """A record with its children nested, as JSON."""
    child = F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(child)).alias("orders"), F.count("*").alias("n_orders"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("o_custkey") == F.col("c_custkey"))
    return c.select("c_custkey", "c_name", "n_name", F.to_json("orders").alias("orders"), "n_orders")


@query("""
WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING'), f AS (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_acctbal > 5000)
SELECT k, coalesce(f.v, a.v) AS v FROM a FULL JOIN f USING (k)""")
def keyed_upsert(spark, sf_dir):
    """Upsert by full outer join."""
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"))
    return upsert.upsert(old, new, ["k"])


# The queries of further modules register themselves here.
from rosterlake.plans import catalog_builders, catalog_directories, catalog_more, catalog_places, catalog_records  # noqa: E402, F401
