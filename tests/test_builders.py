"""Datasets, history, grouping, quality and the repairs of table maintenance, on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import changes, history, linkage, quality, spatial, temporal, upsert
from rosterlake.plans import interpret, projection, search
from rosterlake.sources import datasets, delimited
from rosterlake.streaming import incremental


def day(text):
    return dt.date.fromisoformat(text) if text else None


# --- files ------------------------------------------------------------------------------------------------------------


def test_rows_below_a_letterhead_are_told_by_position(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Report of things\n"x",y\nNumber,Name,Status\n,"Smith, A",Active\n7,Jones,\nNumber,Name,Status\n\n8,,""\n')
    spec = delimited.FileSpec(tuple(delimited.Field(n.lower(), n) for n in ("Number", "Name", "Status")), header_starts_with="Number")
    assert [tuple(r) for r in delimited.read(spark, str(path), spec).collect()] == [(None, "Smith, A", "Active"), ("7", "Jones", None), ("Number", "Name", "Status"), ("8", None, None)]


def test_bad_rows_fail_or_are_listed(spark, tmp_path):
    path = tmp_path / "a.csv"
    spec = delimited.FileSpec((delimited.Field("a", "A"), delimited.Field("b", "B")))
    path.write_text("A,B\n1,2\n3\n4,5\n")
    with pytest.raises(Exception):  # noqa: B017
        delimited.read(spark, str(path), spec).collect()
    assert [r["a"] for r in delimited.read(spark, str(path), spec, strict=False).collect()] == ["1", "3", "4"]
    assert [r["line"] for r in delimited.bad_rows(spark, str(path), spec).collect()] == ["3"]


def test_datasets_are_read_and_built(spark, tmp_path):
    (tmp_path / "leie.csv").write_text("LASTNAME,FIRSTNAME,MIDNAME,BUSNAME,GENERAL,SPECIALTY,NPI,ADDRESS,CITY,STATE,ZIP,EXCLTYPE,EXCLDATE,REINDATE,WAIVERDATE,WVRSTATE\nDOE,ANN,,,X,Y,0000000000,1 A ST,B,NY,11111,1128a1,20240131,00000000,00000000,\n")
    found = datasets.load(spark, datasets.DATASETS["oig_leie"], {"main": str(tmp_path / "leie.csv")})["oig_exclusion"].first()
    assert (found["last_name"], found["npi"], found["exclusion_date"], found["reinstatement_date"]) == ("DOE", None, day("2024-01-31"), None)
    head = "NPI,Ind_PAC_ID,Med_sch,Grd_yr,pri_spec,sec_spec_all,Telehlth,Facility Name,org_pac_id,num_org_mem,City/Town,State,ind_assgn,grp_assgn,adr_ln_1,ZIP Code\n"
    (tmp_path / "dac.csv").write_text(head + "1234567893,P1,S,1999,CARDIO,,Y,Group A,G1,5,B,NY,Y,M,1 A ST,117381234\n1234567893,P1,S,1999,CARDIO,,N,Group A,G1,7,A,NY,N,Y,2 A ST,11738\n")
    out = datasets.load(spark, datasets.DATASETS["cc_clinicians"], {"main": str(tmp_path / "dac.csv")})
    assert [(r["npi"], r["graduation_year"], r["accepts_assignment"], r["telehealth"]) for r in out["cc_clinician"].collect()] == [("1234567893", 1999, True, True)]
    assert [(r["org_pac_id"], r["members"], r["accepts_assignment"], r["city"]) for r in out["cc_group"].collect()] == [("G1", 7, True, "A")]
    assert [(r["zip5"], r["address1"]) for r in out["cc_clinician_location"].collect()] == [("11738", "1 A ST")]
    for kind, rows in (("Hospital", "1234567893,330001,E1,12,One,NY\n"), ("Hospice", "1234567893,330001,E1,0000000012,Two,NYC\n,330002,E2,12345678901,Three,NJ\n")):
        (tmp_path / f"{kind}.csv").write_text("NPI,CCN,ENROLLMENT ID,ASSOCIATE ID,ORGANIZATION NAME,ENROLLMENT STATE\n" + rows)
    out = datasets.load(spark, datasets.DATASETS["cms_facility_enrollments"], {k: str(tmp_path / f"{k}.csv") for k in ("Hospital", "Hospice")})
    assert [tuple(r) for r in out["cms_facility_npi"].collect()] == [("330001", "1234567893", "Hospice")]
    assert sorted((r["enrollment_id"], r["kind"], r["associate_id"], r["org_name"], r["state"]) for r in out["cms_facility_enrollment"].collect()) == [("E1", "Hospice", "0000000012", "Two", "NY"), ("E2", "Hospice", None, "Three", "NJ")]


def test_every_dataset_names_its_columns_once():
    for name, d in datasets.DATASETS.items():
        for spec in d.files.values():
            names, headers = [f.name for f in spec.fields], [delimited.header_key(f.header) for f in spec.fields]
            assert len(set(names)) == len(names) and len(set(headers)) == len(headers), name
            assert {f.kind for f in spec.fields} <= set(delimited.CONVERTERS), name


def frame(spark, spec, rows):
    """A raw table of a spec's columns; columns that aren't given are null."""
    kinds = {"number": "double", "optional_number": "double", "whole": "long", "optional_whole": "long", "yes_no": "boolean", "date": "date", "date_mdy": "date", "date_ymd": "date"}
    schema = ", ".join(f"{f.name} {kinds.get(f.kind, 'string')}" for f in spec.fields)
    return spark.createDataFrame([tuple(r.get(f.name) for f in spec.fields) for r in rows], schema)


def raw(spark, name, part="main", rows=()):
    return frame(spark, datasets.DATASETS[name].files[part], rows)


def test_builds_of_facilities(spark):
    owner = {"enrollment_id": "E1", "owner_id": "77", "role_code": "34", "owner_type": "O", "org_name": "Holdco", "percentage": 50.0}
    rows = [owner, {**owner, "enrollment_id": "E2", "role_code": "43"}, {**owner, "owner_id": "88", "owner_type": "I", "first_name": "Ann", "last_name": "Doe"}, {**owner, "owner_id": "x"}]
    out = datasets.facility_owners({"main": raw(spark, "cms_facility_owners", "Hospital", rows).withColumn("kind", F.lit("Hospital"))})
    assert sorted((r["enrollment_id"], r["owner_id"], r["name"]) for r in out["facility_owner"].collect()) == [("E1", "0000000077", "Holdco"), ("E1", "0000000088", "Ann Doe"), ("E2", "0000000077", "Holdco")]
    assert [(r["owner_id"], r["facilities"], r["owned"]) for r in out["facility_owner_entity"].collect()] == [("0000000077", 2, 1)]
    change = raw(spark, "cms_ownership_changes", "changes", [{"seller_enrollment_id": "E2", "buyer_associate_id": "5"}])
    out = datasets.ownership_changes({"changes": change, "owners": raw(spark, "cms_ownership_changes", "owners", rows).withColumn("kind", F.lit("Seller"))})
    assert [(r["enrollment_id"], r["role_code"]) for r in out["facility_ownership_change_owner"].collect()] == [("E2", "43")]
    assert out["facility_ownership_change"].first()["buyer_associate_id"] == "0000000005"
    pos = raw(spark, "cms_provider_of_services", "2", [{"ccn": "1", "name": "New", "status": "Terminated", "zip": "12345-6"}]).withColumn("part", F.lit("2"))
    pos = pos.unionByName(raw(spark, "cms_provider_of_services", "1", [{"ccn": "1", "name": "Old"}, {"ccn": "2", "termination_code": "05"}]).withColumn("part", F.lit("1")))
    got = {r["ccn"]: (r["name"], r["active"], r["zip5"], r["termination_code"]) for r in datasets.provider_of_services({"main": pos})["cms_pos_facility"].collect()}
    assert got == {"1": ("New", False, "12345", None), "2": (None, False, None, "05")}
    volume = datasets.hospital_volume({
        "totals": raw(spark, "cms_hospital_volume", "totals", [{"ccn": "a1", "discharges": 5}]),
        "services": raw(spark, "cms_hospital_volume", "outpatient", [{"ccn": "A1", "code": "c", "cases": 2, "avg_medicare_payment": 10.0}, {"ccn": "b", "code": "d", "cases": 3, "avg_medicare_payment": 1.0}]).withColumn("setting", F.lit("O")),
    })
    assert sorted((r["ccn"], r["discharges"], r["outpatient_services"], r["outpatient_payments"]) for r in volume["cms_hospital_volume"].collect()) == [("A1", 5, 2, 20.0), ("B", None, 3, 3.0)]
    qip = raw(spark, "cc_esrd_qip", rows=[{"ccn": "1a", "total_score": "70", "payment_reduction": "0.50%"}, {"ccn": "1A", "total_score": "No Score"}, {"ccn": "-"}])
    assert [(r["ccn"], r["total_score"], r["payment_reduction"]) for r in datasets.dialysis_qip({"main": qip})["cms_dialysis_qip"].collect()] == [("1A", 70, 0.5)]
    d = datasets.dialysis({"listing": raw(spark, "cc_dialysis", "listing", [{"ccn": "1"}, {"ccn": "2"}]), "survey": raw(spark, "cc_dialysis", "survey", [{"ccn": "1", "star_rating": 3.6}, {"ccn": "2", "star_rating": 0.0}])})
    assert {r["ccn"]: r["survey_rating"] for r in d["cms_dialysis"].collect()} == {"1": 4, "2": None}


def test_builds_of_areas_and_drugs(spark):
    hpsa = raw(spark, "hrsa_hpsa", "Mental Health", [{"hpsa_id": "a", "status": "Designated", "score": 5, "component_type": "Single County", "county_fips": "36103"}, {"hpsa_id": "b", "status": "Withdrawn", "county_fips": "36103"}]).withColumn("discipline", F.lit("Mental Health"))
    assert [tuple(r) for r in datasets.shortage_areas({"main": hpsa})["county_shortage"].collect()] == [("36103", "Mental Health", True, 1, 5)]
    people = datasets.population_file(2024)
    got = people.build({"main": frame(spark, people.files["main"], [{"sumlev": "050", "state_fips": "36", "county_code": "103", "population": 9}, {"sumlev": "040", "state_fips": "36", "county_code": "000", "population": 99}])})
    assert [r["county_fips"] for r in got["county_population"].collect()] == ["36103"]
    price = {"ndc": "12345678901", "per_unit": 1.0, "as_of": day("2024-01-01")}
    prices = raw(spark, "nadac", rows=[price, {**price, "per_unit": 2.0, "as_of": day("2024-02-01")}, {**price, "ndc": "1"}])
    assert [(r["ndc"], r["per_unit"]) for r in datasets.drug_prices({"main": prices})["nadac"].collect()] == [("12345678901", 2.0)]
    wide = spark.createDataFrame([("Pill*", "gen", "Overall", "1,000", "5", None, "7"), ("Pill", "gen", "Maker", "9", "9", "9", "9"), ("Pill", "gen", "Overall", "1", None, "3", "2")], "Brnd_Name string, Gnrc_Name string, Mftr_Name string, Tot_Spndng_2022 string, Tot_Clms_2022 string, Tot_Spndng_2023 string, Tot_Clms_2023 string")
    assert sorted((r["brand_name"], r["year"], r["spending"], r["claims"]) for r in datasets.drug_spending(wide, "Part D").collect()) == [("Pill", 2022, 1001.0, 5.0), ("Pill", 2023, 3.0, 2.0)]
    named = datasets.payments_entities({
        "profiles": raw(spark, "open_payments_entities", "profiles", [{"company_id": "1", "name": "Acme Inc", "alt_name1": "Acme Labs"}]),
        "years": raw(spark, "open_payments_entities", "years", [{"company_id": "1", "name": "x", "program_year": "2022", "general_amount": 2.0}, {"company_id": "2", "name": "Beta LLC", "state": "NY", "program_year": "2023", "general_amount": 1.0}]),
    })
    assert sorted((r["company_id"], r["name"], r["other_names"], r["state"], r["general_amount"], r["last_year"]) for r in named["op_company"].collect()) == [("1", "Acme Inc", "Acme Labs", None, 2.0, 2022), ("2", "Beta LLC", None, "NY", 1.0, 2023)]
    assert sorted(map(tuple, named["op_company_key"].collect())) == [("1", "ACME"), ("1", "ACME LABS"), ("2", "BETA")]
    study = raw(spark, "open_payments_research", rows=[{"company_id": "1", "amount": 5.0, "study": "S", "product": "Pill", "product2": "pill"}, {"company_id": "1", "amount": 2.0, "nct_id": "N1", "product": "Pill"}])
    got = datasets.payments_research({"main": study})
    assert [(r["slug"], r["amount"], r["records"], r["studies"]) for r in got["op_product_research"].collect()] == [("pill", 12.0, 3, 2)]
    assert [(r["study_rank"], r["study"], r["nct_id"]) for r in got["op_product_study"].orderBy("study_rank").collect()] == [(1, "S", None), (2, None, "N1")]


# --- history ----------------------------------------------------------------------------------------------------------

NOW = "npi string, status string, state string, code string, places string, from_period date"


def test_a_file_moves_the_history_on(spark):
    at = day("2020-01-01")
    now = spark.createDataFrame([(n, s, "NY", "A", "p", at) for n, s in (("same", "active"), ("moved", "active"), ("gone", "active"), ("off", "deactivated"), ("back", "deactivated"), ("twice", "active"))], NOW)
    listed = spark.createDataFrame([("same", "active", "NY", "A", None, 1), ("moved", "active", "NJ", "A", None, 2), ("new", "active", "NY", "B", None, 3), ("back", "active", "NY", "A", None, 4), ("twice", "active", "CT", "A", None, 5), ("twice", "active", "PA", "B", "q", 6)], "npi string, status string, state string, code string, places string, line int")
    file = history.last_listed(listed, "npi", [F.desc("line")])
    got = {r["npi"]: r for r in history.apply_period(now, file, "npi", ["state", "code", "places"], F.lit("2020-02-01").cast("date"), ["places"], ["state", "places"], "code").collect()}
    assert {n: r["change"] for n, r in got.items()} == {"same": None, "moved": "changed", "gone": "gone", "off": None, "new": "new", "back": "changed", "twice": "changed"}
    assert got["same"]["places"] == "p" and got["same"]["from_period"] == at and got["moved"]["places"] == "p"
    assert (got["gone"]["status"], got["gone"]["state"], got["gone"]["from_period"]) == ("gone", None, day("2020-02-01"))
    assert (got["back"]["places"], got["back"]["reactivated"], got["twice"]["state"], got["twice"]["special_changed"]) == (None, True, "PA", True)
    assert [got[n]["moved"] for n in ("same", "moved", "twice", "new")] == [False, True, True, False]
    summary = history.period_summary(history.apply_period(now, file, "npi", ["state", "code", "places"], F.lit("2020-02-01").cast("date"), ["places"], ["state", "places"], "code")).first()
    assert tuple(summary) == (5, 1, 2, 1, 1, 1, 1, 5)
    history.check_listed(95, 100)
    with pytest.raises(history.TruncatedFile):
        history.check_listed(94, 100)


def test_terminations_cut_periods_without_fan_out(spark):
    p = spark.createDataFrame([("a", day("2020-01-01"), day("2020-03-01"), 1), ("a", day("2020-05-01"), None, 2), ("b", day("2020-01-01"), day("2020-02-01"), 3)], "k string, s date, e date, other int")
    t = spark.createDataFrame([("a", day("2020-01-01")), ("a", day("2020-02-01")), ("a", day("2020-02-10")), ("a", day("2020-06-01")), ("b", day("2020-03-05")), (None, day("2020-01-05"))], "k string, t date")
    got = {r["other"]: (r["e"], r["terminated"]) for r in temporal.cut_at_termination(p, t, "k", "s", "e", "t").collect()}
    assert got == {1: (day("2020-01-31"), day("2020-02-01")), 2: (day("2020-05-31"), day("2020-06-01")), 3: (day("2020-02-01"), None)}


# --- groups and quality -----------------------------------------------------------------------------------------------


def test_a_bucket_of_one_specialty_is_tied_by_address_only(spark):
    schema = "npi string, name_key string, zip5 string, number string, street string, taxonomy string, ccns array<string>, pac_ids array<string>, parent_key string, parent_tin string, updated int"
    org = lambda n, number, taxonomy, pac: (n, f"K{n}", "1", number, "MAIN", taxonomy, [], [pac], None, None, 1)
    rows = [org("1", "1", "S", "chain"), org("2", "2", "S", "chain"), org("3", "2", "S", "chain"), org("4", "4", "A", "mixed"), org("5", "5", "B", "mixed"), org("6", "6", "B", "mixed")]
    got = {r["npi"]: (r["main_npi"], r["ties"]) for r in linkage.organisation_groups(spark.createDataFrame(rows, schema), F.lit(0), "updated").collect()}
    assert got == {"2": ("2", 4), "3": ("2", 4), "4": ("4", 4), "5": ("4", 4), "6": ("4", 4)}


def test_quality_classes(spark):
    r = quality.REASONS
    cases = {0: 1, r["no_activity"]: 1, r["not_updated_10"]: 1, r["not_updated_10"] | r["no_activity"]: 3, r["not_updated_5"] | r["no_activity"]: 2, r["deceased"]: 3, r["other_current"]: 3, r["facility_closed"]: 2, r["listed_closed"] | r["no_activity"]: 3, r["po_box"]: 2, r["reactivated"]: 1, r["home_address"]: 1, r["medicare_stopped"]: 1}
    df = spark.createDataFrame([(k,) for k in cases], "r int")
    assert {x["r"]: x["label"] for x in df.select("r", quality.classify(F.col("r")).alias("label")).collect()} == cases


def test_search_refuses_unknown_values_and_puts_near_names_first(spark):
    for bad in ({"bbox": (1.0, 1.0, 0.0, 2.0)}, {"order_refer": "x"}, {"address_type": "x"}):
        with pytest.raises(search.InvalidFilter):
            search.SearchFilter(**bad).check()
    from rosterlake.functions import text

    people = spark.createDataFrame([("1", "Smythe", "Smythe"), ("2", "Smith", "Smith"), ("3", "Smyth", "Smyth")], "npi string, last_name string, sort_name string").withColumn("last_phonetic", text.phonetic_key(F.col("last_name")))
    found = search.search(search.Tables(people), search.SearchFilter(last_name="Smith", similar=True), "2024-01-01")
    assert [r["npi"] for r in found.collect()] == ["2", "3", "1"]


# --- maintenance ------------------------------------------------------------------------------------------------------


def test_an_update_to_null_is_written(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, None), (3, None)], "k int, v string")
    assert dict(map(tuple, upsert.upsert(old, new, ["k"]).collect())) == {1: None, 2: "b", 3: None}
    assert dict(map(tuple, upsert.upsert(old, new, ["k"], keep_old=True).collect())) == {1: "a", 2: "b", 3: None}
    first = upsert.insert_ignore(old, spark.createDataFrame([(2, "x"), (4, "z"), (4, "y")], "k int, v string"), ["k"], [F.asc("v")])
    assert dict(map(tuple, first.collect())) == {1: "a", 2: "b", 4: "y"}


def test_a_swap_that_ended_half_way_is_undone(spark, tmp_path):
    path = tmp_path / "t"
    upsert.guarded_replace(spark.range(10), str(path))
    path.rename(tmp_path / "t_old")  # as if the job died between its two renames
    upsert.recover(spark, str(path))
    assert spark.read.parquet(str(path)).count() == 10
    path.rename(tmp_path / "t_old")
    with pytest.raises(upsert.TooFewRows):
        upsert.guarded_replace(spark.range(1), str(path))
    assert spark.read.parquet(str(path)).count() == 10


def test_the_first_batch_run_again_is_counted_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(day("2024-03-01"), "a")], "at date, kind string").write.parquet(source)
    for checkpoint in ("c1", "c2"):  # a lost checkpoint runs batch 0 again
        incremental.maintain_counts(spark, source, "at date, kind string", "at", ["kind"], str(tmp_path / "t"), str(tmp_path / checkpoint), "2024-02-01", "2024-03-15").awaitTermination()
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]


def test_last_values_are_carried_forward(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, None), (2, 2, "b")], "k int, t int, v string")
    assert [r["v"] for r in temporal.carry_forward(df, ["k"], [F.asc("t")], "v").orderBy("k", "t").collect()] == ["a", "a", None, "b"]


# --- places, changes, free text ---------------------------------------------------------------------------------------


def test_points_in_polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    polygons = spark.createDataFrame([(1, ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))), (2, ring((4, 4), (6, 4), (6, 6), (4, 6))), (3, ring((20, 0), (30, 0), (20, 10)))], "polygon int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 9.0), (3, 28.0, 8.0), (4, 21.0, 1.0), (5, -1.0, 5.0)], "point int, x double, y double")
    got = {r["point"]: (r["polygon"], r["area"]) for r in spatial.smallest_containing(points, polygons, 3.0).collect()}
    assert got == {1: (2, 4.0), 2: (1, 100.0), 4: (3, 50.0)}


def test_changes_and_their_texts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, place string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "x", None), (4, "d", 1)], "k int, place string, n int")
    log = changes.change_log(old, new, ["k"], {"moved": ["place"], "count": ["n"]})
    assert sorted((r["k"], r["kind"], r["was"], r["is"]) for r in log.collect()) == [(2, "count", "1", ""), (2, "moved", "b", "x"), (3, "removed", None, None), (4, "added", None, None)]
    assert dict(map(tuple, changes.described(log, ["k"], {"moved": "moved from {was} to {is}", "added": "new"}).collect())) == {2: "moved from b to x", 4: "new"}


@pytest.fixture(scope="module")
def known(spark):
    kinds = [("Chiropractor", "CH"), ("Nurse (Practitioner)", "NP"), ("Surgery", "SU"), ("Dentist", "DE"), ("Doctor", "DR"), ("Hospital", "HO"), ("Family Doctor", "FD"), ("Cardiology", "CA")]
    counties = [("Suffolk County", "NY", "36103", 1_520_000), ("Suffolk County", "MA", "25025", 770_000), ("St. Louis County", "MO", "29189", 990_000), ("Orleans Parish", "LA", "22071", 380_000)]
    cities = [("BROOKLYN", "NY", 40), ("BROOKLYN", "MI", 1), ("SAINT JAMES", "NY", 1), ("NEW YORK", "NY", 90), ("PORTLAND", "OR", 30), ("PORTLAND", "ME", 6), ("STONY BROOK", "NY", 2)]
    states = [("NY", "New York"), ("MA", "Massachusetts"), ("MO", "Missouri"), ("OR", "Oregon"), ("ME", "Maine"), ("IN", "Indiana"), ("LA", "Louisiana")]
    frames = [spark.createDataFrame(r, s) for r, s in ((kinds, "name string, value string"), (counties, "name string, state string, fips string, population int"), (cities, "city string, state string, zips int"), (states, "code string, name string"))]
    return interpret.vocabulary(*frames).cache()


ASKED = {
    "1234-567-893": {"kind": "number", "npi": "1234567893"},
    " 123 456 7893 ": {"kind": "number", "npi": "1234567893"},
    "12345678934": {"kind": "names", "name": "12345678934"},
    "Chiropractors in Suffolk County, NY": {"kind": "list", "specialty": "CH", "state": "NY", "county": "36103"},
    "dentists suffolk county": {"kind": "list", "specialty": "DE", "state": "NY", "county": "36103", "notes": ["Suffolk County: also in MA"]},
    "dentists in suffolk county ma": {"kind": "list", "specialty": "DE", "state": "MA", "county": "25025"},
    "dentists saint louis county": {"kind": "list", "specialty": "DE", "state": "MO", "county": "29189"},
    "surgeries orleans parish": {"kind": "list", "specialty": "SU", "state": "LA", "county": "22071"},
    "chiropractors within 25 miles of 11701": {"kind": "list", "specialty": "CH", "zip5": "11701", "radius": 25},
    "dentists near 11701-4321": {"kind": "list", "specialty": "DE", "zip5": "11701", "radius": 10},
    "dentists 11701": {"kind": "list", "specialty": "DE", "zip5": "11701"},
    "dentist 500 mi 11701": {"kind": "list", "specialty": "DE", "zip5": "11701", "radius": 100},
    "dentists within 5 miles": {"kind": "list", "specialty": "DE", "notes": ["a distance needs a ZIP code"]},
    "nurses in nyc": {"kind": "list", "specialty": "NP", "state": "NY", "city": "New York"},
    "nurses in new york city": {"kind": "list", "specialty": "NP", "state": "NY", "city": "New York"},
    "nurses in portland me": {"kind": "list", "specialty": "NP", "state": "ME", "city": "Portland"},
    "nurses in portland": {"kind": "list", "specialty": "NP", "state": "OR", "city": "Portland"},
    "cardiology brooklyn ny": {"kind": "list", "specialty": "CA", "state": "NY", "city": "Brooklyn"},
    "family doctor st james": {"kind": "list", "specialty": "FD", "state": "NY", "city": "Saint James"},
    "chiropractor in": {"kind": "list", "specialty": "CH", "state": "IN"},
    "doctors in Indiana": {"kind": "list", "specialty": "DR", "state": "IN"},
    "dentist john smith in brooklyn": {"kind": "list", "specialty": "DE", "state": "NY", "city": "Brooklyn", "first_name": "john", "last_name": "smith", "name": "john smith"},
    "dentist smith ny": {"kind": "list", "specialty": "DE", "state": "NY", "last_name": "smith", "name": "smith"},
    "bayside dental group ny": {"kind": "list", "state": "NY", "org_name": "bayside dental group", "name": "bayside dental group"},
    "Stony Brook University Hospital": {"kind": "names", "name": "Stony Brook University Hospital"},
    "hospitals in stony brook": {"kind": "list", "specialty": "HO", "state": "NY", "city": "Stony Brook"},
    "doctor john smith": {"kind": "names", "name": "doctor john smith"},
    "doctor jane brooklyn": {"kind": "names", "name": "doctor jane brooklyn"},
    "Brooklyn": {"kind": "names", "name": "Brooklyn"},
    "Dr. Jordan Ellis": {"kind": "names", "name": "Jordan Ellis"},
    "dentists near me": {"kind": "list", "specialty": "DE", "near_me": True},
    "dr": {"kind": "empty"}, "   ": {"kind": "empty"}, "": {"kind": "empty"}, "?!": {"kind": "empty"},
}


def test_free_text_queries(spark, known):
    asked = [*ASKED, None]
    rows = interpret.interpret(spark.createDataFrame(list(enumerate(asked)), "id int, text string"), known).collect()
    assert len(rows) == len(asked)
    nothing = {**interpret.EMPTY, "near_me": False, "notes": []}
    for r in rows:
        got = r.asDict()
        want = {"id": r["id"], **nothing, **ASKED.get(asked[r["id"]], {"kind": "empty"})}
        assert got == want, asked[r["id"]]


def test_suggestions(spark):
    people = spark.createDataFrame([("Suffern, Ann",)], "label string")
    places = spark.createDataFrame([("Suffield", 5), ("Suffolk", 50), ("East Suffolk", 500)], "label string, population long")
    found = interpret.suggestions("suff", spark.createDataFrame([("Surgery",)], "label string"), places, people).collect()
    assert [r["label"] for r in found] == ["Suffolk", "Suffield", "Suffern, Ann", "East Suffolk"]


def test_more_projected_tables(spark):
    wide = {"NPI": "1", "Entity_Type_Code": "2", "NPI_Deactivation_Date": None, "NPI_Reactivation_Date": None}
    for i in range(1, 51):
        wide |= {f"Other_Provider_Identifier_{i}": "id" if i == 50 else " ", f"Other_Provider_Identifier_Type_Code_{i}": "05", f"Other_Provider_Identifier_State_{i}": "NY", f"Other_Provider_Identifier_Issuer_{i}": None}
    record = spark.createDataFrame([tuple(wide.values()), ("2", "1", "01/01/2020", None, *list(wide.values())[4:])], ", ".join(f"{c} string" for c in wide))
    assert [tuple(r) for r in projection.identifiers(record).collect()] == [("1", 50, "id", "05", "NY", None)]
    names = spark.createDataFrame([("1", "Other", "3"), ("1", "Other", "3"), ("2", "Gone", "3"), ("1", " ", "3")], "NPI string, Provider_Other_Organization_Name string, Provider_Other_Organization_Name_Type_Code string")
    other = projection.other_names(record, names)
    assert [tuple(r) for r in other.collect()] == [("1", "Other", "3")]
    orgs = spark.createDataFrame([("1", "Legal"), ("3", None)], "npi string, org_name string")
    assert sorted(map(tuple, projection.org_names(orgs, other).collect())) == [("1", "Legal"), ("1", "Other")]
    ends = spark.createDataFrame([("1", "DIRECT", "a@b", "X", None, "Y")], "NPI string, Endpoint_Type string, Endpoint string, Use_Code string, Content_Type string, Affiliation string")
    assert [tuple(r) for r in projection.endpoints(record, ends).collect()] == [("1", "DIRECT", "a@b", "X", None, True)]
    new = projection.incremental({"t": orgs}, {"t": spark.createDataFrame([("1", "New")], "npi string, org_name string")}, spark.createDataFrame([("1",)], "npi string"), 20)
    assert sorted(map(str, map(tuple, new["t"].collect()))) == ["('1', 'New')", "('3', None)"]
    assert projection.incremental({"t": orgs}, {"t": orgs}, orgs, 10) is None
    shown = spark.createDataFrame([("DOE", "ANN", None, "M.D.", None), (None, None, None, None, "Acme LLC")], "l string, f string, m string, c string, o string")
    assert [r[0] for r in shown.select(projection.display_name(*(F.col(c) for c in "lfmco"))).collect()] == ["Ann Doe, M.D.", "Acme LLC"]


# --- what was wrong ---------------------------------------------------------------------------------------------------


def test_a_period_with_its_defaults(spark):
    now = spark.createDataFrame([(1, "active", "a", 1), (2, "active", "b", 1)], "k int, status string, v string, from_period int")
    listed = spark.createDataFrame([(1, "active", "x"), (3, "active", "c")], "k int, status string, v string")
    got = sorted((r["k"], r["status"], r["change"], r["moved"], r["special_changed"]) for r in history.apply_period(now, listed, "k", ["v"], F.lit(2)).collect())
    assert got == [(1, "active", "changed", False, False), (2, "gone", "gone", False, False), (3, "active", "new", False, False)]


def test_a_leftover_is_old(spark):
    labels = spark.createDataFrame([(i, 1 if i == 1 else 2, 5 if i == 1 else 0) for i in range(1, 7)], "npi int, label int, activity int")
    groups = spark.createDataFrame([(i, 1, i == 1) for i in range(1, 7)], "npi int, main_npi int, is_main boolean")
    dates = {1: (None, None), 2: ("2015-01-01", "2019-01-01"), 3: ("2015-01-01", "2023-06-01"), 4: ("2023-06-01", None), 5: (None, None), 6: ("2022-06-01", "2020-01-01")}
    ages = spark.createDataFrame([(k, *v) for k, v in dates.items()], "npi int, e string, u string").select("npi", F.col("e").cast("date").alias("enumeration_date"), F.col("u").cast("date").alias("last_update_date"))
    got = {r["npi"] for r in quality.other_current(labels, groups, ages, F.lit("2024-06-01").cast("date")).collect()}
    assert got == {2, 5}  # 6 was issued exactly two years before
