"""Registry rules on small invented records."""

import datetime as dt
from itertools import product

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import address, geo, nulls, text
from rosterlake.operators import linkage, quality, ranking, temporal, upsert
from rosterlake.plans import projection, search
from rosterlake.sources import delimited, nested, releases, sinks
from rosterlake.streaming import incremental


def values(spark, expr, rows, schema="a string, b string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r, None) for r in rows], schema).select(expr).collect()]


@pytest.mark.parametrize(
    ("expr", "given", "wanted"),
    [
        (lambda: text.trimmed(F.col("a")), [" x ", "  ", None], ["x", None, None]),
        (lambda: text.mdy_date(F.col("a")), ["02/29/2024", "13/01/2024", "", None], [dt.date(2024, 2, 29), None, None, None]),
        (lambda: text.ymd_date(F.col("a")), ["20240229", "00000000", "2024"], [dt.date(2024, 2, 29), None, None]),
        (lambda: text.flexible_date(F.col("a")), ["2024-01-02", "01/02/2024", "20240102", "x"], [dt.date(2024, 1, 2)] * 3 + [None]),
        (lambda: text.yes_no(F.col("a")), ["y", "NO", "maybe", None], [True, False, None, None]),
        (lambda: text.whole_number(F.col("a")), ["1,234", "x", None], [1234, None, None]),
        (lambda: text.number(F.col("a")), ["$1,234.50", "12%", "n/a"], [1234.5, 12.0, None]),
        (lambda: text.registry_id(F.col("a")), ["1234567893", "0000000000", "12"], ["1234567893", None, None]),
        (lambda: text.check_digit_ok(F.col("a")), ["1234567893", "1234567890", "x", None], [True, False, False, False]),
        (lambda: text.zip5(F.col("a"), F.col("b")), [("11738-1234", "US"), ("11738", " "), ("1173", None), ("11738", "CA")], ["11738", "11738", None, None]),
        (lambda: text.zip4(F.col("a"), F.col("b")), [("11738-1234", "US"), ("11738", None)], ["1234", None]),
        (lambda: text.normalised(F.col("a")), ["  Müller & Söhne, Inc. "], ["muller and sohne inc"]),
        (lambda: text.name_key(F.col("a")), ["The Acme Widget Co., Inc.", "ACME  widget", "A B", "LILLY USA, LLC", "Eli Lilly and Company", "Dr. Reddy’s Ltd", "VERTEX INC / MA", None], ["ACME WIDGET", "ACME WIDGET", None, "LILLY USA", "ELI LILLY", "DR REDDYS", "VERTEX", None]),
        (lambda: text.slug(F.col("a")), [" Big Pill (10 mg) "], ["big-pill-10-mg"]),
        (lambda: address.street(F.col("a")), ["North Main Street, Suite 4", "Ocean Avenue", "N. Country Road #4"], ["N MAIN ST", "OCEAN AVE", "N COUNTRY RD"]),
        (lambda: text.phonetic_key(F.col("a")), ["Smith", "Smyth", "Smiht", "Pipa", "Muñoz", "Munoz", "", "Ashcraft"], ["S530", "S530", "S530", "P000", "M200", "M200", "", "A261"]),
        (lambda: text.name_distance(F.col("a"), F.col("b")), [("Smith", "Smith"), ("Smith", "Smyth"), ("Ann", "Anna"), ("Abcdefghijkl", "Z")], [0, 3, 2, 20]),
        (lambda: text.shared_word_match(F.col("a"), F.col("b")), [("Acme Widget Inc", "Widget Acme"), ("Acme Widget Tool Die", "Acme"), ("Inc", "Inc")], [True, True, False]),
        (lambda: text.ndc_key(F.col("a")), ["123-45-6", "12345678901", "x"], ["001230045", "123456789", None]),
        (lambda: nulls.strict_greatest(F.col("a"), F.col("b")), [("a", "b"), ("a", None)], ["b", None]),
    ],
)
def test_converters_and_keys(spark, expr, given, wanted):
    assert values(spark, expr(), given) == wanted


def test_geography(spark):
    row = spark.range(1).select(geo.haversine(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437)).alias("d"), geo.cell(F.lit(40.75), F.lit(-73.95)).alias("c")).first()
    assert abs(row["d"] - 2446) < 2 and row["c"] == 1307 * 3600 + 1060
    south, west, north, east = geo.box(40.0, -74.0, 69.0)
    assert (south, north) == (39.0, 41.0) and west < -75.2 and east > -72.8


def test_quality_rule_for_every_combination(spark):
    rows = [(r, a) for r, a in product(range(32), (0, 1))]
    got = spark.createDataFrame(rows, "r int, a int").select("r", "a", quality.label(F.col("r"), F.col("a"), stale=2, check=12, check_if_idle=1, stale_always=16).alias("l")).collect()
    for r in got:
        idle = r["a"] == 0
        want = 3 if r["r"] & 16 or (r["r"] & 2 and idle) else 2 if r["r"] & 12 or (r["r"] & 1 and idle) else 1
        assert r["l"] == want


def day(s):
    return dt.date.fromisoformat(s) if s else None


def test_periods_merge_by_the_running_end(spark):
    rows = [
        ("a", "2020-01-01", "2020-12-31"), ("a", "2020-02-01", "2020-03-01"), ("a", "2021-01-31", "2021-02-01"), ("b", "2020-01-01", "2020-01-31"), ("b", "2020-03-03", "2020-04-01"), ("b", "2020-05-04", "2020-06-01"),
        ("c", "2020-01-01", None), ("c", "2022-01-01", "2022-02-01"), ("d", "2020-01-01", "2020-02-01"), ("d", "2020-01-01", "2020-02-01"),
    ]
    df = spark.createDataFrame([(k, day(s), day(e)) for k, s, e in rows], "k string, s date, e date")
    got = {(r["k"], str(r["s"]), str(r["e"]), r["parts"]) for r in temporal.merge_periods(df, ["k"], "s", "e").collect()}
    assert got == {
        ("a", "2020-01-01", "2021-02-01", 3), ("b", "2020-01-01", "2020-01-31", 1), ("b", "2020-03-03", "2020-04-01", 1), ("b", "2020-05-04", "2020-06-01", 1), ("c", "2020-01-01", "None", 2), ("d", "2020-01-01", "2020-02-01", 2)
    }


def test_termination_ends_a_period_the_day_before(spark):
    periods = spark.createDataFrame([("a", day("2020-01-01"), day("2020-12-31")), ("b", day("2020-01-01"), day("2020-06-30")), ("c", day("2020-01-01"), None)], "k string, s date, e date")
    terms = spark.createDataFrame([("a", day("2020-05-01")), ("a", day("2020-06-01")), ("b", day("2020-07-15")), ("c", day("2020-01-01"))], "k string, t date")
    got = {r["k"]: (str(r["e"]), str(r["terminated"])) for r in temporal.cut_at_termination(periods, terms, "k", "s", "e", "t").collect()}
    assert got == {"a": ("2020-04-30", "2020-05-01"), "b": ("2020-06-30", "2020-07-15"), "c": ("None", "None")}


def test_versions_spans_and_fill(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x")], "k string, t int, v string")
    assert [(r["v"], r["valid_from"], r["valid_to"]) for r in temporal.versions(df, ["k"], [F.asc("t")], ["v"], "t").orderBy("valid_from").collect()] == [("x", 1, 3), (None, 3, 5), ("x", 5, None)]
    years = spark.createDataFrame([("a", y) for y in (2013, 2014, 2016, 2014)], "k string, y int")
    assert temporal.year_spans(years, ["k"], "y").first()["years"] == "2013–2014, 2016"
    assert [r["v"] for r in temporal.carry_forward(df, ["k"], [F.asc("t")], "v").orderBy("t").collect()] == ["x"] * 5
    diff = temporal.row_diff(df.filter("t < 4").select("t", "v"), df.filter("t > 1").select("t", F.when(F.col("t") == 2, "y").otherwise(F.col("v")).alias("v")), ["t"], ["v"])
    assert {r["t"]: r["change"] for r in diff.collect()} == {1: "gone", 2: "changed", 4: "new", 5: "new"}


def test_maintenance_equals_a_full_build(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (4, "d")], "k int, v string")
    changed = spark.createDataFrame([(1,), (2,), (4,)], "k int")
    assert sorted(map(tuple, upsert.replace_keys(old, new, changed, ["k"]).collect())) == sorted(map(tuple, new.collect()))
    assert dict(map(tuple, upsert.upsert(old, new, ["k"]).collect())) == {1: "a", 2: "B", 3: "c", 4: "d"}
    path = str(tmp_path / "t")
    assert upsert.guarded_replace(old, path) == 3
    with pytest.raises(upsert.TooFewRows):
        upsert.guarded_replace(old.limit(1), path)
    assert spark.read.parquet(path).count() == 3
    bits = upsert.or_bits(spark.createDataFrame([(1, 1)], "k int, b int"), spark.createDataFrame([(1, 4), (2, 2)], "k int, b int"), ["k"], "b")
    assert dict(map(tuple, bits.collect())) == {1: 5, 2: 2}


def test_groups_and_fallbacks(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2)], "a long, b long")
    assert {r["id"]: r["group"] for r in linkage.connected_groups(edges).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}
    left = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "z")], "p string, q string")
    one, two = (spark.createDataFrame(r, "k string, v int") for r in ([("a", None)], [("x", 2)]))
    got = {r["p"]: (r["v"], r["matched_by"]) for r in linkage.first_match(left, [(one, {"p": "k"}), (two, {"q": "k"})], "v").collect()}
    assert got == {"a": (None, 1), "b": (2, 2), None: (None, None)}
    ties = spark.createDataFrame([("a", "v", 1.0), ("a", "u", 1.0), ("a", None, 9.0)], "k string, v string, n double")
    assert ranking.mode_value(ties, ["k"], "v", "n").first()["v"] == "u"


# --- the registry world ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def world(spark):
    base = {f"{c}_{i}": "" for i in range(1, 16) for c in ("Healthcare_Provider_Taxonomy_Code", "Provider_License_Number", "Provider_License_Number_State_Code", "Healthcare_Provider_Primary_Taxonomy_Switch")}
    names = "NPI Entity_Type_Code Provider_Last_Name_Legal_Name Provider_First_Name Provider_Middle_Name Provider_Organization_Name_Legal_Business_Name Provider_Credential_Text Provider_Gender_Code Practice_Address Practice_City_Name Practice_State_Name Practice_Postal_Code Practice_Country_Code_If_outside_US Provider_Enumeration_Date Last_Update_Date NPI_Deactivation_Date NPI_Reactivation_Date".split()

    def record(**given):
        return {**base, **dict.fromkeys(names, ""), **given}

    place = {"Practice_City_Name": "Farmtown", "Practice_State_Name": "NY", "Practice_Postal_Code": "11738-0001"}
    rows = [
        record(NPI="1000000001", Entity_Type_Code="1", Provider_Last_Name_Legal_Name="Smith", Provider_First_Name="Ann", Provider_Credential_Text="D.C.", Healthcare_Provider_Taxonomy_Code_1="207Q", Healthcare_Provider_Primary_Taxonomy_Switch_1="Y", Healthcare_Provider_Taxonomy_Code_3="111N", Provider_License_Number_State_Code_3="NULL", Provider_Enumeration_Date="01/15/2024", Last_Update_Date="02/01/2024", **place),
        record(NPI="1000000002", Entity_Type_Code="1", Provider_Last_Name_Legal_Name="Jones", Provider_First_Name="Bob", Healthcare_Provider_Taxonomy_Code_1="111N", Provider_Enumeration_Date="01/15/2010", **{**place, "Practice_Postal_Code": "90210"}),
        record(NPI="1000000003", Entity_Type_Code="1", Provider_Last_Name_Legal_Name="Smith", Provider_First_Name="Cee", Healthcare_Provider_Taxonomy_Code_1="111N", NPI_Deactivation_Date="01/01/2020", **place),
        record(NPI="1000000004", Entity_Type_Code="2", Provider_Organization_Name_Legal_Business_Name="Island Spine Center", Healthcare_Provider_Taxonomy_Code_1="111N", **place),
        record(NPI="1000000005", Entity_Type_Code="1", Provider_Last_Name_Legal_Name="Muñoz", Provider_First_Name="Eva", Healthcare_Provider_Taxonomy_Code_2="111N", Healthcare_Provider_Primary_Taxonomy_Switch_2="Y", NPI_Deactivation_Date="01/01/2020", NPI_Reactivation_Date="01/01/2021", **place),
    ]
    raw = spark.createDataFrame(rows)
    more = spark.createDataFrame([{"NPI": "1000000002", "Practice_Address": "2 Side St", **place, "Practice_Country_Code_If_outside_US": ""}])
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return raw, search.Tables(
        provider=projection.providers(raw).cache(), taxonomy=projection.taxonomies(raw).cache(), location=projection.locations(raw, more).cache(),
        zip_county=one([("11738", "36103", "Farmville"), ("11738", "36059", "Farmville"), ("90210", "06037", "Beverly Hills")], "zip5 string, county_fips string, usps_city string"),
        zip_centroid=one([("11738", 40.8, -73.0), ("90210", 34.1, -118.4)], "zip5 string, lat double, lon double"), county_shortage=one([("36103", "PC")], "county_fips string, discipline string"),
        exclusion=one([("1000000002",)], "npi string"), opt_out=one([("1000000001", day("2020-01-01")), ("1000000005", None)], "npi string, end_date date"),
        quality=one([("1000000001", 1), ("1000000002", 3)], "npi string, label int"), group=one([("1000000001", "1000000004", False), ("1000000004", "1000000004", True)], "npi string, main_npi string, is_main boolean"),
        other_name=one([("1000000004", "Back Doctors of Long Island")], "npi string, name string"),
    )


def test_projection(spark, world):
    raw, t = world
    p = {r["npi"]: r for r in t.provider.collect()}
    assert set(p) == {"1000000001", "1000000002", "1000000004", "1000000005"}
    assert p["1000000001"]["primary_taxonomy_code"] == "207Q" and p["1000000005"]["primary_taxonomy_code"] == "111N" and p["1000000002"]["primary_taxonomy_code"] == "111N"
    assert p["1000000001"]["sort_name"] == "Smith, Ann" and p["1000000004"]["sort_name"] == "Island Spine Center" and p["1000000001"]["credential_key"] == "DC"
    slots = {(r["npi"], r["slot"]): r["license_state"] for r in t.taxonomy.collect()}
    assert slots[("1000000001", 3)] is None and len(slots) == 5
    assert t.location.count() == 5 and t.location.filter("zip4 = '0001'").count() == 4
    assert projection.search_cells(t.taxonomy, t.location).filter("npi = '1000000002'").count() == 2
    hashes = projection.content_hashes(raw, {"tax": (t.taxonomy, ["taxonomy_code"])}, ["Provider_First_Name"])
    assert hashes.select("hash").distinct().count() == 5


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ({"taxonomy_codes": ["111N"]}, "1245"), ({"taxonomy_codes": ["111N"], "county": "36103"}, "1245"), ({"zip5": "90210"}, "2"), ({"state": "ny", "city": "farmville"}, "1245"), ({"last_name": "munoz"}, "5"),
        ({"last_name": "Smyth"}, ""), ({"last_name": "Smyth", "similar": True}, "1"), ({"org_name": "island"}, "4"), ({"org_name": "back doctors", "similar": True}, "4"), ({"credential": "dc"}, "1"),
        ({"near": (40.8, -73.0, 10)}, "1245"), ({"shortage": "PC"}, "1245"), ({"excluded": True}, "2"), ({"excluded": False}, "145"), ({"opted_out": True}, "5"), ({"opted_out": False}, "124"),
        ({"quality": "stale"}, "2"), ({"quality": "notStale"}, "145"), ({"new_within_days": 90}, "1"), ({"updated_within_days": 90}, "1"), ({"entity_type": 1}, "125"), ({"all_members": False}, "245"), ({"npi": "1000000003"}, ""),
    ],
)
def test_search(world, given, wanted):
    got = search.search(world[1], search.SearchFilter(**given), "2024-03-01").collect()
    assert "".join(sorted(r["npi"][-1] for r in got)) == wanted
    assert all(r["total"] == len(wanted) for r in got)


def test_search_order_and_limits(world):
    names = [r["npi"][-1] for r in search.search(world[1], search.SearchFilter(sort="-enumerated"), "2024-03-01").collect()]
    assert names[:2] == ["1", "2"]
    for bad in ({"sort": "phone"}, {"page_size": 201}, {"page": 300}, {"new_within_days": 0}, {"quality": "old"}, {"near": (0, 0, 500)}):
        with pytest.raises(search.InvalidFilter):
            search.search(world[1], search.SearchFilter(**bad), "2024-03-01")


# --- sources and sinks ------------------------------------------------------------------------------------------------


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Report of things\nprinted today\nNPI,Name,Excl Date,Extra\n1234567893,"Smith, A",20240131,x\n0000000000, ,,y\n')
    spec = delimited.FileSpec((delimited.Field("npi", "npi", "npi"), delimited.Field("name", "NAME"), delimited.Field("on", "excl date", "date_ymd"), delimited.Field("none", "absent", required=False)), header_starts_with="NPI", constants={"kind": "k"})
    rows = [tuple(r) for r in delimited.read(spark, str(path), spec).collect()]
    assert rows == [("1234567893", "Smith, A", day("2024-01-31"), None, "k"), (None, None, None, None, "k")]
    with pytest.raises(delimited.HeaderError):
        delimited.read(spark, str(path), delimited.FileSpec((delimited.Field("x", "absent"),), header_starts_with="NPI"))
    plain = tmp_path / "b.txt"
    plain.write_text("A|B\n1|two\n")
    assert [tuple(r) for r in delimited.read(spark, str(plain), delimited.FileSpec((delimited.Field("b", "B"), delimited.Field("a", "A", "whole")), sep="|")).collect()] == [("two", 1)]


def test_nested_sources_and_sinks(spark, tmp_path):
    feed = tmp_path / "f.json"
    feed.write_text('{"meta": 1, "results": [{"id": "a", "keys": ["x", "y"]}, {"id": "b"}]}')
    rows = nested.read_results(spark, str(feed), "id string, keys array<string>")
    assert [tuple(r) for r in nested.exploded(rows, "keys", "key").collect()] == [("a", "x"), ("a", "y")]
    sinks.write_ranges(rows.select("id"), str(tmp_path / "out"), "id", 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    sinks.write_manifest(rows, str(tmp_path / "m"), "t", "v1")
    assert spark.read.json(str(tmp_path / "m")).first()["rows"] == 2
    pages = spark.createDataFrame([(1, '<a href="/x"><a href="/y">')], "id int, html string")
    assert [r["link"] for r in nested.links(pages).collect()] == ["/x", "/y"]


def test_release_planning():
    names = ["D_August_2024.zip", "D_September_2024_V2.zip", "D_September_2024.zip", "D_090924_091524_Weekly.zip", "D_082624_090124_Weekly.zip", "other.zip"]
    assert [r.name for r in releases.plan(names)] == ["D_September_2024_V2.zip", "D_090924_091524_Weekly.zip"]
    assert [r.name for r in releases.plan(names, dt.date(2024, 9, 1))] == ["D_090924_091524_Weekly.zip"]
    assert releases.missing_months([dt.date(2024, 1, 9)], dt.date(2024, 1, 1), dt.date(2024, 3, 1)) == [dt.date(2024, 2, 1), dt.date(2024, 3, 1)]


def test_streaming_counts_equal_the_batch(spark, tmp_path):
    schema, source = "at date, kind string", str(tmp_path / "in")
    parts = [[("2024-01-05", "a"), ("2024-03-01", "a")], [("2023-01-01", "b"), (None, "a"), ("2024-03-09", "a")]]
    every = []
    for rows in parts:
        rows = [(day(d), k) for d, k in rows]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.maintain_counts(spark, source, schema, "at", ["kind"], str(tmp_path / "t"), str(tmp_path / "c"), "2024-02-01", "2024-03-15").awaitTermination()
    got = {(str(r["month"]), r["kind"]): r["n"] for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    full = incremental.monthly_deltas(spark.createDataFrame(every, schema), "at", ["kind"], F.lit("2024-02-01").cast("date"), F.lit("2024-03-15").cast("date"))
    assert got == {(str(r["month"]), r["kind"]): r["n"] for r in full.collect()} == {("2024-02-01", "a"): 1, ("2024-03-01", "a"): 3, ("2024-02-01", "b"): 1}
