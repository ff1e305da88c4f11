"""Registry queries of addresses, buildings and boxes, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import address
from rosterlake.operators import placement, spatial
from rosterlake.plans.catalog import query, table

# --- addresses --------------------------------------------------------------------------------------------------------

#: Address lines made of each part: numbered streets with units, building names in short forms, and lines that say nothing.
_LINE = """CASE p_partkey % 7
  WHEN 0 THEN (p_partkey * 7 % 20) || ' N. ' || p_type || ' Road, Ste 4' WHEN 1 THEN (p_partkey * 7 % 20) || ' ' || p_type || ' AVENUE #3'
  WHEN 2 THEN p_name || ' Univ. Hosp, L4' WHEN 3 THEN 'The ' || p_name || ' ctr of ' || p_type WHEN 4 THEN (p_partkey % 20) || 'B-' || p_size || ' ' || p_type || ' Av Floor 2'
  WHEN 5 THEN p_type || ' & ' || p_name || ' Dept of Med' ELSE 'Suite ' || p_size END"""
_STREET = "CASE WHEN p_partkey % 2 = 0 THEN 'North ' || p_type || ' rd.' ELSE p_type || ' Ave' END"
_POINT_ZIP = "CASE WHEN p_partkey % 3 > 0 THEN lpad(CAST(p_partkey % 50 + 1 AS VARCHAR(9)), 5, '0') || '-0001' END"
_PLACE_NAME = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' University Hospital' WHEN 1 THEN p_name || ' ' || p_type || ' Center' WHEN 2 THEN p_type || ' ' || p_name || ' Med' ELSE p_brand END"
_PLACE_LINE = "CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 20) || CASE WHEN p_partkey % 6 = 0 THEN 'B-' || p_size ELSE '' END || ' ' || p_type || ' ave' END"
_PLACE_ZIP = "CASE WHEN p_partkey % 4 > 0 THEN lpad(CAST(p_size AS VARCHAR(9)), 5, '0') END"

_ADDRESS_SQL = rf"""
forms(w, v) AS (VALUES ('NORTH', ['N']), ('ROAD', ['RD']), ('AVENUE', ['AVE']), ('AV', ['AVE'])),
names(w, v) AS (VALUES ('UNIV', ['UNIVERSITY']), ('HOSP', ['HOSPITAL']), ('CTR', ['CENTER']), ('MED', ['MEDICAL']), ('DEPT', ['DEPARTMENT'])),
lines AS (
  SELECT p_partkey AS k, 'line' AS what, {_LINE} AS t, 'CITY ' || p_partkey % 7 AS city, lpad(p_size::VARCHAR, 5, '0') AS zip FROM part
  UNION ALL SELECT p_partkey, 'point', (p_partkey % 20) || ' ' || {_STREET}, 'CITY ' || p_partkey % 7, left({_POINT_ZIP}, 5) FROM part
  UNION ALL SELECT p_partkey, 'place', {_PLACE_LINE}, 'CITY ' || p_partkey % 7, {_PLACE_ZIP} FROM part),
cut AS (SELECT *, regexp_extract(upper(trim(regexp_replace(t, '[^A-Za-z0-9 #-]+', ' ', 'g'))), '^(\d+[A-Z]?(?:-\d+[A-Z]?)?)\s+(.+)$', ['number', 'rest']) AS h FROM lines),
words AS (
  SELECT k, what, h.number AS number, unnest(list_filter(string_split(regexp_replace(regexp_replace(replace(h.rest, '#', ' STE '), '[^A-Z0-9]+', ' ', 'g'), '\b(STE|SUITE|FLOOR|FL|DEPT)\b.*$', ''), ' '), lambda w: w <> '')) AS w,
  generate_subscripts(list_filter(string_split(regexp_replace(regexp_replace(replace(h.rest, '#', ' STE '), '[^A-Z0-9]+', ' ', 'g'), '\b(STE|SUITE|FLOOR|FL|DEPT)\b.*$', ''), ' '), lambda w: w <> ''), 1) AS i FROM cut WHERE h.number <> ''),
houses AS (SELECT k, what, number, string_agg(coalesce(v[1], w), ' ' ORDER BY i) AS street FROM words LEFT JOIN forms USING (w) GROUP BY ALL),
titles AS (SELECT k, 'line' AS what, t FROM lines WHERE what = 'line' AND k NOT IN (SELECT k FROM houses WHERE what = 'line') UNION ALL SELECT p_partkey, 'place', {_PLACE_NAME} FROM part),
tokens AS (
  SELECT DISTINCT k, what, unnest(coalesce(v, [w])) AS w FROM (SELECT k, what, unnest(string_split(regexp_replace(upper(t), '[^A-Z0-9]+', ' ', 'g'), ' ')) AS w FROM titles) LEFT JOIN names USING (w)),
telling AS (SELECT k, what, w, count(*) OVER (PARTITION BY k, what) AS n FROM tokens WHERE length(w) > 1 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ('THE', 'OF', 'SUITE', 'STE', 'DEPARTMENT')),
spots AS (SELECT l.k, l.what, l.city, l.zip, number, street, p_partkey * 0.001::DOUBLE + CASE WHEN l.what = 'place' THEN 40 ELSE 30 END AS lat, p_size * 0.01::DOUBLE - 90 AS lon, {_PLACE_NAME} AS name, (p_partkey % 100) / 100.0 AS confidence
  FROM lines l JOIN part ON p_partkey = k LEFT JOIN houses h ON h.k = l.k AND h.what = l.what)"""


def _world(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, size, city = F.col("p_partkey"), F.col("p_size"), F.concat(F.lit("City "), F.col("p_partkey") % 7)
    lat, lon = k * 0.001, size * 0.01 - 90
    addresses = p.select(k.alias("addr_key"), F.expr(_LINE).alias("address1"), city.alias("city"), F.lpad(size.cast("string"), 5, "0").alias("zip5"))
    points = p.select((k % 20).cast("string").alias("number"), F.expr(_STREET).alias("street"), F.expr(_POINT_ZIP).alias("zip"), city.alias("city"), (lat + 30).alias("lat"), lon.alias("lon"))
    places = p.select(F.expr(_PLACE_NAME).alias("name"), F.expr(_PLACE_LINE).alias("address"), F.expr(_PLACE_ZIP).alias("zip"), city.alias("city"), (lat + 40).alias("lat"), lon.alias("lon"), ((k % 100) / 100).alias("confidence"))
    return addresses, points, places


@query(f"""
WITH {_ADDRESS_SQL},
asked AS (SELECT * FROM spots WHERE what = 'line'),
exact AS (
  SELECT a.k, min({{'r': CASE WHEN p.zip = a.zip THEN 0 ELSE 1 END, 'lat': p.lat, 'lon': p.lon}}) AS m, any_value(a.number || ' ' || a.street) AS matched
  FROM asked a JOIN spots p ON p.what = 'point' AND p.number = a.number AND p.street = a.street AND (p.zip = a.zip OR p.city = a.city) GROUP BY a.k),
listed AS (
  SELECT a.k, r, median(p.lat) AS lat, median(p.lon) AS lon, min(p.name) AS matched
  FROM asked a JOIN spots p ON p.what = 'place' AND p.number = a.number AND p.street = a.street JOIN (VALUES (0), (1)) x(r) ON CASE WHEN r = 0 THEN p.zip = a.zip ELSE p.city = a.city END GROUP BY a.k, r),
middle AS (SELECT k, arg_min(lat, r) AS lat, arg_min(lon, r) AS lon, arg_min(matched, r) AS matched FROM listed GROUP BY k),
pairs AS (
  SELECT a.k, b.k AS p, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m
  FROM telling a JOIN telling b ON a.what = 'line' AND b.what = 'place' AND a.w = b.w JOIN spots x ON x.k = a.k AND x.what = 'line' JOIN spots y ON y.k = b.k AND y.what = 'place'
  WHERE CASE WHEN y.zip IS NULL THEN y.city = x.city ELSE y.zip = x.zip END GROUP BY ALL),
named AS (
  SELECT pairs.k, lat, lon, name, row_number() OVER (PARTITION BY pairs.k ORDER BY shared / n DESC, shared / m DESC, confidence DESC, name, lat, lon) AS rn
  FROM pairs JOIN spots ON spots.k = p AND what = 'place' WHERE shared >= 2 AND shared / n >= 0.75)
SELECT k AS addr_key, 'address' AS source, round(m.lat, 6) AS lat, round(m.lon, 6) AS lon, matched FROM exact
UNION ALL SELECT k, 'place', round(lat, 6), round(lon, 6), matched FROM middle WHERE k NOT IN (SELECT k FROM exact)
UNION ALL SELECT k, 'place_name', round(lat, 6), round(lon, 6), name FROM named WHERE rn = 1""")
def placed_addresses(spark, sf_dir):
    """Practice addresses at their address point, at the places listed there, or by a building's name."""
    found = placement.place(*_world(spark, sf_dir))
    return found.select("addr_key", "source", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "matched")


@query(f"WITH {_ADDRESS_SQL} SELECT p_partkey, number, street FROM part LEFT JOIN houses ON k = p_partkey AND what = 'line'")
def house_numbers(spark, sf_dir):
    """Address lines parted into a house number and a street in postal form (H08, UDF address split)."""
    h = address.house(F.expr(_LINE))
    return table(spark, sf_dir, "part").select("p_partkey", h["number"].alias("number"), h["street"].alias("street"))


@query(f"""
WITH {_ADDRESS_SQL},
l AS (SELECT a.k, b.name, b.k AS p FROM spots a JOIN spots b ON a.what = 'line' AND b.what = 'place' AND b.number = a.number AND b.street = a.street AND b.zip = a.zip)
SELECT k AS addr_key, min(name) AS name, CASE WHEN bool_or(p % 3 = 0) THEN 'open' ELSE 'closed' END AS status, max(DATE '2020-01-01' + (p % 500)::INTEGER) AS updated, string_agg(DISTINCT 's' || p % 4, ';' ORDER BY 's' || p % 4) AS sources
FROM l GROUP BY k, upper(name)""")
def listed_businesses(spark, sf_dir):
    """The businesses that are listed at each address, with their status, sources and newest date."""
    addresses, _, _ = _world(spark, sf_dir)
    k = F.col("p_partkey")
    places = table(spark, sf_dir, "part").select(
        F.expr(_PLACE_NAME).alias("name"), F.expr(_PLACE_LINE).alias("address"), F.expr(_PLACE_ZIP).alias("zip"), F.when(k % 3 == 0, "open").otherwise("closed").alias("status"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 500).cast("int")).alias("updated"), F.concat(F.lit("s"), k % 4).alias("sources"),
    )
    return placement.listed_at(addresses, places)


# --- buildings and boxes ----------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT vec_id AS point, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings),
b AS (SELECT s_suppkey AS building, (s_suppkey % 13)::DOUBLE - 7 AS x, (s_suppkey % 11)::DOUBLE - 6 AS y, 0.6 + (s_suppkey % 3) * 0.3 AS h, s_acctbal AS size FROM supplier),
e AS (
  SELECT building, size, x + h * ax AS ax, y + h * ay AS ay, x + h * bx AS bx, y + h * b_y AS b_y
  FROM b, (VALUES (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1), (-0.5, -0.5, 0.5, -0.5), (0.5, -0.5, 0, 0.5), (0, 0.5, -0.5, -0.5)) v(ax, ay, bx, b_y)),
m AS (
  SELECT point, building, any_value(size) AS size, sum(CASE WHEN (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS contained,
    min(sqrt(pow(ax + t * (bx - ax) - x, 2) + pow(ay + t * (b_y - ay) - y, 2))) AS d
  FROM (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) AS t FROM p CROSS JOIN e) GROUP BY point, building),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY contained DESC, CASE WHEN contained THEN 0 ELSE d END, size, building) AS rn FROM m WHERE contained OR d <= 0.4)
SELECT p.point, CASE WHEN r.point IS NULL THEN 'none' WHEN contained THEN 'inside' ELSE 'near' END AS match, CASE WHEN NOT contained THEN round(d, 6) END AS distance, building, size FROM p LEFT JOIN r ON r.point = p.point AND rn = 1""")
def nearest_building(spark, sf_dir):
    """The building, with a yard, that each point is in or else near (J13, W14, D58, scalar spatial)."""
    e = F.col("embedding")
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), (e[0].cast("double") * 10).alias("x"), (e[1].cast("double") * 10).alias("y"))
    k = F.col("s_suppkey")
    x, y, h = (k % 13).cast("double") - 7, (k % 11).cast("double") - 6, 0.6 + (k % 3) * 0.3
    ring = lambda *at: F.array(*(F.struct((x + h * a).alias("x"), (y + h * b).alias("y")) for a, b in at))
    outline, yard = ring((-1, -1), (1, -1), (1, 1), (-1, 1)), ring((-0.5, -0.5), (0.5, -0.5), (0, 0.5))
    buildings = table(spark, sf_dir, "supplier").select(k.alias("building"), F.array(outline, yard).alias("rings"), F.col("s_acctbal").alias("size"))
    return spatial.building_at(points, buildings, 0.4).select("point", "match", F.round("distance", 6).alias("distance"), "building", "size")


@query("""
WITH p AS (SELECT c_custkey, c_nationkey * 1.7::DOUBLE + (c_custkey % 10) * 0.1::DOUBLE + CASE WHEN c_nationkey > 12 THEN 20 ELSE 0 END AS lat, (c_nationkey % 5) * 12 + c_acctbal / 5000 AS lon FROM customer),
x AS (SELECT *, sum(n) OVER (ORDER BY lon, c_custkey) AS g FROM (SELECT *, CASE WHEN lon - lag(lon) OVER (ORDER BY lon, c_custkey) > 5 THEN 1 ELSE 0 END AS n FROM p)),
y AS (SELECT *, sum(m) OVER (PARTITION BY g ORDER BY lat, c_custkey) AS h FROM (SELECT *, CASE WHEN lat - lag(lat) OVER (PARTITION BY g ORDER BY lat, c_custkey) > 5 THEN 1 ELSE 0 END AS m FROM x)),
z AS (SELECT *, sum(o) OVER (PARTITION BY g, h ORDER BY lon, c_custkey) AS i FROM (SELECT *, CASE WHEN lon - lag(lon) OVER (PARTITION BY g, h ORDER BY lon, c_custkey) > 5 THEN 1 ELSE 0 END AS o FROM y))
SELECT round(min(lat), 6) AS south, round(min(lon), 6) AS west, round(max(lat), 6) AS north, round(max(lon), 6) AS east, count(*) AS points FROM z GROUP BY g, h, i""")
def point_boxes(spark, sf_dir):
    """Boxes around points, split where no point lies for five degrees."""
    nation = F.col("c_nationkey")
    lat = nation * 1.7 + (F.col("c_custkey") % 10) * 0.1 + F.when(nation > 12, 20).otherwise(0)
    points = table(spark, sf_dir, "customer").select(lat.alias("lat"), ((nation % 5) * 12 + F.col("c_acctbal") / 5000).alias("lon"))
    return spatial.boxes(points, 5.0).select(*(F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")), "points")
