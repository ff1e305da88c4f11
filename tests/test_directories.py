"""Facility and group directories, similar companies, prescribing, record quality and organisations on hand-worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import address, text
from rosterlake.operators import directories, linkage, quality


def dated(df, *columns):
    return df.withColumns({c: F.col(c).cast("date") for c in columns})


def test_facilities_are_merged(spark):
    registered = spark.createDataFrame(
        [("01a", "Old Name", "1 A St", "B", "NY", "00001", True, "00", None), ("02", "Closed", None, None, "NJ", "00002", False, "07", "2020-01-01"), ("03", None, None, None, None, None, True, "00", None), ("05", "Clinic", None, None, None, None, True, "00", None)],
        "ccn string, name string, address string, city string, state string, zip5 string, active boolean, termination_code string, termination_date string",
    )
    listed = spark.createDataFrame(
        [("hospice", "01A ", "Twice", None, None, None, None, None, None, None, None, 1.0), ("hospital", "01A", "New Name", None, None, None, None, "555", "Acute", "Gov", 7, 4.5), ("hospital", "04", "Only Listed", None, None, "CT", None, None, None, None, None, None)],
        "type string, ccn string, name string, address string, city string, state string, zip5 string, phone string, kind string, ownership string, beds int, rating double",
    )
    billing = spark.createDataFrame([("01A", "1", "hospital"), ("01A", "1", "hospital"), ("01A", "9", "hospital"), ("02", "2", "rhc"), ("02", "3", "rhc"), ("02", "3", "fqhc")], "ccn string, npi string, kind string")
    providers = spark.createDataFrame([("1",), ("2",), ("3",)], "npi string")
    centroids = spark.createDataFrame([("00001", 40.0, -70.0)], "zip5 string, lat double, lon double")
    changes = spark.createDataFrame([("01A", "02", "2021-01-01"), (None, "01a", "2022-01-01")], "buyer_ccn string, seller_ccn string, effective_date string")
    fines = spark.createDataFrame([("02", 10.0, "2019-01-01"), ("02", 5.5, "2020-01-01")], "ccn string, fine_amount double, penalty_date string")
    got = {r["ccn"]: r for r in directories.facility_directory(dated(registered, "termination_date"), listed, billing, providers, centroids, dated(changes, "effective_date"), dated(fines, "penalty_date"), ["hospital", "hospice"], F.lit("other")).collect()}
    assert set(got) == {"01A", "02", "04", "05"}  # 03 has no name
    a, b, d = got["01A"], got["02"], got["04"]
    assert (a["type"], a["name"], a["address"], a["state"], a["phone"], a["rating"], a["active"], a["termination_code"], a["billing_npis"], a["lat"], a["ownership_changed"]) == ("hospital", "New Name", "1 A St", "NY", "555", 4.5, True, None, 1, 40.0, dt.date(2022, 1, 1))
    assert (b["type"], b["active"], b["termination_code"], b["billing_npis"], b["penalties"], b["fines"], b["last_penalty"]) == ("rhc", False, "07", 2, 2, 15.5, dt.date(2020, 1, 1))
    assert (d["type"], d["active"], d["penalties"], got["05"]["type"]) == ("hospital", True, 0, "other")


def test_groups_count_active_clinicians_once(spark):
    reassigned = spark.createDataFrame([("G", "1", "Re", "NY"), ("G", None, "Re", "NY"), ("H", "9", None, None), ("I", "2", None, None)], "group_pac_id string, npi string, group_name string, group_state string")
    members = spark.createDataFrame([("G", "1", "Care", "NJ", True), ("G", "2", "Care", "NJ", False)], "org_pac_id string, npi string, group_name string, state string, accepts_assignment boolean")
    enrolled = spark.createDataFrame([("G", "1", "Org"), ("G", "2", None), ("G", "9", "Org")], "pac_id string, npi string, org_name string")
    scores = spark.createDataFrame([("G", "group", 2022, 88.125), ("G", "individual", 2023, 99.0)], "org_pac_id string, source string, program_year int, final_score double")
    got = sorted(map(tuple, directories.group_directory(reassigned, members, enrolled, scores, spark.createDataFrame([("1",), ("2",)], "npi string")).collect()))
    assert got == [("G", "Care", "NY", 2, 1, True, 88.13, 2022), ("I", "Group I", None, 1, 0, None, None, None)]


def test_organisations_by_specialty_state_and_label(spark):
    providers = spark.createDataFrame([("1", 2, "X"), ("2", 2, "X"), ("3", 1, "X"), ("4", 2, None)], "npi string, entity_type int, primary_taxonomy_code string")
    locations = spark.createDataFrame([("1", True, "ny"), ("1", False, "NJ"), ("2", True, "NY"), ("4", True, "Ontario")], "npi string, is_primary boolean, state string")
    got = sorted(map(tuple, directories.organisation_counts(providers, locations, spark.createDataFrame([("1", 3), ("2", 3)], "npi string, label int")).collect()))
    assert got == [("", "", 0, 1), ("X", "NY", 3, 2)]


def test_similar_companies_share_the_distinctive_word(spark):
    rows = [(1, "Acme Medical Inc", 5.0), (2, "THE ACME GROUP", 9.0), (3, "Acmed LLC", 99.0), (4, "New Acme-Labs", 7.0), (5, "Health Inc", 1.0), (6, "acme_x", 100.0), (7, "Zeta", None)]
    got = sorted(map(tuple, directories.similar_companies(spark.createDataFrame(rows, "company_id int, name string, amount double"), 2).collect()))
    ranked = {c: [s for _, s, _, _ in sorted((g for g in got if g[0] == c), key=lambda g: g[3])] for c in {g[0] for g in got}}
    assert ranked == {1: [2, 4], 2: [4, 1], 4: [2, 1], 6: [2, 4]}  # a word ends where letters, digits and _ do: acme_x and Acmed have others


def test_prescribers_of_a_product(spark):
    products = spark.createDataFrame([("dupixent", "Dupixent", "Drug", "000110022"), ("stent", "Stent", "Device", None), ("x", "X", "Biological", "000330044")], "slug string, name string, kind string, ndc_key string")
    ndc = spark.createDataFrame([("000330044", "Xarel"), ("000110022", None)], "ndc_key string, brand_name string")
    brands = spark.createDataFrame([("Dupixent", 5, 50.0), ("Dupixent Pen", 9, 90.0), ("Dupixentine", 1, 1.0), ("Xarel Kit", 2, 20.0), ("Stent", 1, 1.0)], "brand string, claims long, drug_cost double")
    matched = directories.product_brands(products, ndc, brands)
    assert sorted(map(tuple, matched.collect())) == [("dupixent", "Dupixent"), ("dupixent", "Dupixent Pen"), ("x", "Xarel Kit")]
    prescribed = spark.createDataFrame([("Dupixent", "1", 2, 20.0, 1), ("Dupixent Pen", "1", 3, 30.0, 1), ("Dupixent Pen", "2", 6, 60.0, 2), ("Xarel Kit", "3", 2, 20.0, 1)], "brand string, npi string, claims long, drug_cost double, beneficiaries long")
    paid = spark.createDataFrame([("dupixent", "1", 7.0, 1), ("dupixent", "9", 7.0, 1), ("dupixent", "4", 7.0, 1), ("x", "9", 1.0, 1)], "slug string, npi string, amount double, records int")
    providers = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "npi string")
    assert [tuple(r) for r in directories.paid_prescribers(paid, matched, prescribed, providers).collect()] == [("dupixent", "1", 7.0, 1, 5, 50.0, 2)]
    got = sorted(map(tuple, directories.prescribing_overlap(paid, matched, prescribed, brands, providers).collect()))
    assert got == [("dupixent", "Dupixent Pen | Dupixent", 2, 14, 140.0, 2, 1, 5, 50.0), ("x", "Xarel Kit", 1, 2, 20.0, 0, 0, 0, None)]


@pytest.mark.parametrize(("ccn", "key"), [(" 33s014", "330014"), ("33Z305", "331305"), ("33A014", "33A014"), ("330014", "330014"), ("3SS014", "3SS014"), ("33S01", "33S01"), (None, None)])
def test_a_units_number_is_its_hospitals(spark, ccn, key):
    assert spark.createDataFrame([(ccn,)], "c string").select(text.facility_key(F.col("c")).alias("k")).first()["k"] == key


@pytest.mark.parametrize(("line", "want"), [("8900 Van Wyck Expwy", ("8900", "VAN WYCK EXPY")), ("89-00 VAN WYCK EXPRESS WAY STES 1, 2", ("8900", "VAN WYCK EXPY")), ("Old Mill Suites 1-3", ("", "OLD MILL")), (" ", None), (None, None)])
def test_an_organisations_address(spark, line, want):
    got = spark.createDataFrame([(line,)], "a string").select(address.building(F.col("a")).alias("b")).first()["b"]
    assert (got and tuple(got)) == want


ORGS = "npi string, org_name string, hospital boolean, ccns array<string>, parent_key string, parent_tin string"


def matches(spark, names, orgs, **sizes):
    out = linkage.participant_matches(spark.createDataFrame([("A", n) for n in names], "group_id string, name string"), spark.createDataFrame(orgs, ORGS), **sizes)
    return sorted((r["name"], r["npi"], r["candidates"], r["hospital"], r["grouped_by"], r["grouped_value"]) for r in out.collect())


def test_participants_of_one_name_or_of_a_hospital_family(spark):
    few = [("1", "Lake, Clinic", False, None, None, None), ("2", "LAKE CLINIC", False, [], None, None)]
    assert matches(spark, ["lake clinic.", "???", "Nobody"], few) == [("lake clinic.", "1", 2, False, None, None), ("lake clinic.", "2", 2, False, None, None)]
    assert matches(spark, ["lake clinic"], [(str(i), "Lake Clinic", False, None, None, None) for i in range(4)], most=3) == []
    family = [("1", "Lake Hospital", True, ["330001"], None, None), ("2", "Lake Hospital", False, ["330001"], None, None), ("3", "LAKE HOSPITAL", False, None, "LAKEHOSPITAL", None), ("4", "Lake Hospital", False, None, None, "9")]
    assert matches(spark, ["Lake Hospital"], family, most=3) == []  # 4 is another's
    assert {m[3:] for m in matches(spark, ["Lake Hospital"], family[:3], most=2)} == {(True, "hospital", "Lake Hospital")}
    shared = [(n, o, h, ["330001", "330002"], p, t) for n, o, h, _, p, t in family[:3]]
    assert {m[3:] for m in matches(spark, ["Lake Hospital"], shared, most=2)} == {(True, "ccn", "330001")}
    by_parent = [(n, o, h, None, None if h else "LAKEHOSPITAL", t) for n, o, h, _, _, t in family[:3]]
    assert {m[3:] for m in matches(spark, ["Lake Hospital"], by_parent, most=2)} == {(True, "parent", "LAKEHOSPITAL")}
    by_tin = [(n, o, h, None, None, "7") for n, o, h, _, _, _ in family[:3]]
    assert {m[3:] for m in matches(spark, ["Lake Hospital"], by_tin, most=2)} == {(True, "parent_tin", None)}
    assert matches(spark, ["Lake Hospital"], by_tin, most=2, family=2) == []


def test_reasons_of_other_tables(spark):
    as_of = F.lit("2024-06-01").cast("date")
    listed = spark.createDataFrame([("1", "00001", "NY", "A"), ("2", "00009", "NY", "A"), ("3", "00009", "NJ", "Z"), ("4", "99999", "NJ", "Z"), ("5", "00009", "CT", "Q"), ("5", "00001", "CT", "Q")], "npi string, zip5 string, state string, city string")
    ours = spark.createDataFrame([(n, "00001", "NY", "A") for n in "12345"], "npi string, zip5 string, state string, city string")
    centroids = spark.createDataFrame([("00001", 40.0, -70.0), ("00009", 41.0, -70.0)], "zip5 string, lat double, lon double")
    assert {r["npi"] for r in quality.address_reasons(listed, ours, centroids).collect()} == {"3"}  # 69 miles away; 4's ZIP code is unknown
    licences = dated(spark.createDataFrame([("1", "license", "Active", "2020-01-01"), ("2", "license", "Expired", None), ("3", "license", "deceased", "2030-01-01"), ("4", "roster", "Expired", None), ("5", "license", "Active", "2030-01-01")], "npi string, kind string, status string, expiration_date string"), "expiration_date")
    activity = spark.createDataFrame([("2", 128), ("1", 1)], "npi string, activity int")
    got = sorted((r["npi"], r["bit"]) for r in quality.license_reasons(licences, activity, as_of).collect())
    assert got == [("1", 256), ("3", 256), ("3", 512)]
    years = spark.createDataFrame([("1", 2020), ("2", 2020), ("2", 2022), ("3", 2022)], "npi string, data_year int")
    assert [r["npi"] for r in quality.stopped_billing(years, years.filter("data_year = 2022")).collect()] == ["1"]
    clinicians = spark.createDataFrame([("1", "HEART"), ("2", "HEART"), ("3", "UNKNOWN"), ("4", "HEART")], "npi string, primary_specialty string")
    codes = spark.createDataFrame([("1", "X"), ("2", "Y"), ("2", "Z")], "npi string, taxonomy_code string")
    by_code = spark.createDataFrame([("X", "Doctors"), ("Y", "Clinics")], "code string, category string")
    assert {r["npi"] for r in quality.specialty_reasons(clinicians, codes, by_code, spark.createDataFrame([("HEART", "Doctors")], "specialty string, category string")).collect()} == {"2", "4"}


def test_similar_companies_broadcast_only_lists(spark, tmp_path):
    rows = [(i, f"Acme number{i % 50}", float(i % 90)) for i in range(400)]
    spark.createDataFrame(rows, "company_id int, name string, amount double").write.parquet(str(tmp_path / "companies"))
    found = directories.similar_companies(spark.read.parquet(str(tmp_path / "companies")), 3)
    order = sorted(rows, key=lambda r: (-r[2], r[1], r[0]))
    want = sorted((i, r[0], r[1], k + 1) for i, _, _ in rows for k, r in enumerate([r for r in order if r[0] != i][:3]))
    assert sorted(map(tuple, found.collect())) == want
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
