"""Change queue, moving counts, area histories, full text, bitmap sets and plain specialties."""

import datetime as dt
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import area_counts, bitsets, fulltext, specialties
from rosterlake.streaming import area_state
from rosterlake.streaming.change_queue import ChangeQueue, StaleBatch


def day(text):
    return dt.date.fromisoformat(text) if text else None


# --- change queue -----------------------------------------------------------------------------------------------------


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "npi string")


def rows(spark, **states):
    return spark.createDataFrame([(k, s) for k, v in states.items() for s in v], "npi string, state string")


def told(taken):
    return sorted(r["npi"] for r in taken.keys.collect()), sorted((r["npi"], r["state"]) for r in taken.old.collect())


def test_consumers_at_different_offsets(spark, tmp_path):
    q = ChangeQueue(spark, str(tmp_path), "npi", "state string")
    assert told(q.take("a")) == ([], [])
    q.append(keys(spark, "1", "2", "2"), rows(spark, **{"1": ["NY", "NJ"], "3": ["CT"]}))
    first = q.take("a")
    assert told(first) == (["1", "2"], [("1", "NJ"), ("1", "NY")])  # 2 is new
    q.commit(first, "v1")
    q.append(keys(spark, "1", "3"), rows(spark, **{"1": ["MA"], "2": ["VT"], "3": ["CT"]}))
    assert told(q.take("a")) == (["1", "3"], [("1", "MA"), ("3", "CT")])
    both = q.take("b")
    assert told(both) == (["1", "2", "3"], [("1", "NJ"), ("1", "NY"), ("3", "CT")])  # 1 as b last saw it
    q.commit(both, "w1")
    assert (q.offset("a"), q.offset("b")) == ((1, "v1"), (2, "w1"))
    assert told(q.take("b")) == ([], [])


def test_a_crash_loses_and_repeats_nothing(spark, tmp_path):
    q = ChangeQueue(spark, str(tmp_path), "npi", "state string")
    q.append(keys(spark, "1"), rows(spark, **{"1": ["NY"]}))
    lost = q.take("a")  # and the builder dies before it commits
    q = ChangeQueue(spark, str(tmp_path), "npi", "state string")
    q.append(keys(spark, "1", "2"), rows(spark, **{"1": ["NJ"]}))
    again = q.take("a")
    assert told(again) == (["1", "2"], [("1", "NY")])
    q.commit(again, "v")
    with pytest.raises(StaleBatch):
        q.commit(lost, "old")
    assert told(q.take("a")) == ([], [])
    # A batch whose writer died before it was listed is not there, and its number is given again.
    keys(spark, "9").withColumn("old", F.lit(None).cast("struct<state:string>")).write.parquet(f"{tmp_path}/log/batch=3")
    assert told(q.take("a")) == ([], [])
    assert q.append(keys(spark, "4"), rows(spark, **{"4": ["OH"]})) == 3
    assert told(q.take("a")) == (["4"], [("4", "OH")])


def test_trimmed_batches_are_those_that_all_have(spark, tmp_path):
    q = ChangeQueue(spark, str(tmp_path), "npi", "state string")
    for n in "123":
        q.append(keys(spark, n), rows(spark, **{n: ["NY"]}))
        q.commit(q.take("a"))
    assert q.trim(["a", "b"]) == []
    q.commit(q.take("b"))
    assert q.trim(["a", "b"]) == [1, 2, 3]
    assert spark.read.parquet(f"{tmp_path}/log/batch=1").count() == 0
    assert q.append(keys(spark, "4"), rows(spark, **{"4": ["NY"]})) == 4
    assert told(q.take("b")) == (["4"], [("4", "NY")])


# --- counts -----------------------------------------------------------------------------------------------------------


def test_batches_of_changes_equal_the_full_build(spark, tmp_path):
    rnd = random.Random(6)
    crossing = spark.createDataFrame([(f"{z:05}", f"{(z + g) % 4:05}") for z in range(8) for g in range(1 + z % 2)], "zip5 string, county_fips string")
    kinds = spark.createDataFrame([("X", "A", "a1"), ("X", "B", "b1"), ("Y", "A", "a1"), ("Y", "A", "a2")], "code string, category string, subcategory string")
    place = lambda: (rnd.choice(["NY", "NJ", None, "TOOLONG"]), f"{rnd.randrange(10):05}" if rnd.random() < 0.9 else None)
    now = {f"n{i}": [place() for _ in range(rnd.randrange(3))] for i in range(30)}
    codes = {k: rnd.sample(["X", "Y", "Z"], rnd.randrange(3)) for k in now}

    def cells(state, only=None):
        at = spark.createDataFrame([(k, *p) for k, ps in state.items() for p in ps if only is None or k in only], "npi string, state string, zip5 string")
        return area_counts.contributions(at, spark.createDataFrame([(k, c) for k, cs in codes.items() for c in cs], "npi string, taxonomy_code string"), crossing, kinds)

    counts = area_counts.counted(cells(now))
    for n in range(3):
        new = dict(now)
        changed = rnd.sample(sorted(now), 6)
        for k in changed:
            new[k] = [place() for _ in range(rnd.randrange(3))]
        area_counts.moved(counts, cells(now, changed), cells(new, changed)).write.parquet(f"{tmp_path}/{n}")
        counts, now = spark.read.parquet(f"{tmp_path}/{n}"), new
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, area_counts.counted(cells(now)).collect()))


def test_a_member_counts_while_a_row_holds_it(spark, tmp_path):
    rnd = random.Random(8)
    schema = "area string, npi int, d int"
    held = Counter()
    supports = spark.createDataFrame([], "area string, npi int, n long")
    counts = spark.createDataFrame([], "area string, members long")
    for n in range(5):
        batch = []
        for _ in range(40):
            k = (rnd.choice("ab"), rnd.randrange(9))
            d = -1 if held[k] > 0 and rnd.random() < 0.5 else 1
            held[k] += d
            batch.append((*k, d))
        supports, delta = area_counts.apply_rows(supports, spark.createDataFrame(batch, schema), ["area"], "npi")
        area_counts.add_deltas(counts, delta, ["area"]).write.parquet(f"{tmp_path}/c{n}")
        supports.write.parquet(f"{tmp_path}/s{n}")
        counts, supports = spark.read.parquet(f"{tmp_path}/c{n}"), spark.read.parquet(f"{tmp_path}/s{n}")
        assert dict(map(tuple, counts.collect())) == {a: m for a in "ab" if (m := sum(v > 0 for k, v in held.items() if k[0] == a))}
    with pytest.raises(Exception, match="NEGATIVE_SUPPORT"):
        area_counts.apply_rows(supports, spark.createDataFrame([("z", 1, -1)], schema), ["area"], "npi")[0].collect()


# --- histories --------------------------------------------------------------------------------------------------------


def test_moves_and_the_members_behind_them(spark):
    at = "npi string, area_type string, area_id string"
    old = spark.createDataFrame([("1", "us", "US"), ("1", "state", "NY"), ("2", "state", "NY"), ("3", "state", "NJ"), ("3", "county", "9")], at)
    new = spark.createDataFrame([("1", "us", "US"), ("1", "state", "CT"), ("2", "state", "NY"), ("4", "state", "NY")], at)
    dates = [("1", "2024-05-20"), ("2", None), ("4", "2024-05-01")]
    providers = spark.createDataFrame(dates, "npi string, u string").select("npi", F.col("u").cast("date").alias("last_update_date"))
    gone = spark.createDataFrame([("3", "2023-01-01"), ("2", "2024-04-01")], "npi string, d string").select("npi", F.col("d").cast("date").alias("deactivation_date"))
    events = area_counts.area_events(old, new, providers, gone, F.lit("2024-04-01").cast("date"), F.lit("2024-06-11").cast("date"))
    got = sorted((r["area_type"], r["area_id"], str(r["month"]), r["kind"], r["npi"]) for r in events.collect())
    assert got == [("county", "9", "2024-04-01", "deactivated", "3"), ("state", "CT", "2024-05-01", "moved_in", "1"), ("state", "NJ", "2024-04-01", "deactivated", "3"), ("state", "NY", "2024-05-01", "moved_out", "1")]
    for c in area_counts.monthly(events).collect():
        assert area_counts.behind(events, c["area_type"], c["area_id"], F.lit(c["month"]), c["kind"]).count() == c["members"]


def test_months_that_a_change_may_date_from(spark):
    periods = [("2024-01-01", "Completed"), ("2024-02-01", "Missing"), ("2024-03-01", "Completed"), ("2024-04-01", "Missing"), ("2024-05-01", "Missing"), ("2024-06-01", "Completed")]
    p = spark.createDataFrame(periods, "period string, status string").withColumn("period", F.col("period").cast("date"))
    v = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-03-01"), (1, "2024-06-01"), (2, "2024-06-01"), (3, "2024-03-01"), (3, "2024-06-01")], "k int, at string").withColumn("at", F.col("at").cast("date"))
    got = {(r["k"], str(r["at"])): [str(m) for m in r["missing"]] for r in area_counts.months_without_file(v, p, "k", "at").collect()}
    assert got == {(1, "2024-01-01"): [], (1, "2024-03-01"): ["2024-02-01"], (1, "2024-06-01"): ["2024-04-01", "2024-05-01"], (2, "2024-06-01"): [], (3, "2024-03-01"): [], (3, "2024-06-01"): ["2024-04-01", "2024-05-01"]}


def test_a_stream_of_versions_equals_the_batch(spark, tmp_path):
    rnd = random.Random(1)
    schema = "npi string, from_period date, active boolean, areas array<string>"
    months = [dt.date(2023, m, 15) for m in range(1, 10)]
    versions = [(f"n{i}", m, rnd.random() < 0.8, rnd.choice([None, [], rnd.sample("abcd", rnd.randrange(1, 4))])) for i in range(8) for m in months if rnd.random() < 0.7]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", area_state.PROVIDER)
    try:
        for part in (months[:3], months[3:6], months[6:]):  # each run starts again from the checkpoint
            spark.createDataFrame([v for v in versions if v[1] in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = area_state.area_delta_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "2023-04-10")
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.schema(area_state.OUTPUT).parquet(f"{tmp_path}/out").select("npi", "area", "month", "delta").collect())
    batch = area_state.area_deltas(spark.createDataFrame(versions, schema), F.lit("2023-04-10").cast("date"))
    assert got == sorted(tuple(r) for r in batch.select("npi", "area", "month", "delta").collect())
    assert {m for _, _, m, _ in got} >= {dt.date(2023, 4, 1)} and min(m for _, _, m, _ in got) == dt.date(2023, 4, 1)
    active = Counter()
    for npi in {v[0] for v in versions}:
        last = max((v for v in versions if v[0] == npi), key=lambda v: v[1])
        active.update(set(last[3] or []) if last[2] else ())
    sums = defaultdict(int)
    for _, area, _, delta in got:
        sums[area] += delta
    assert {a: n for a, n in sums.items() if n} == dict(active)


# --- text, sets, specialties ------------------------------------------------------------------------------------------


def test_full_text_search(spark, tmp_path):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["red", "Red-box", "blue", "blues", "Élan", "the", "of", "end.", "x&y"]) for _ in range(rnd.randrange(12))) for _ in range(120)] + [None, "", "!?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    fulltext.write_index(docs, "id", "text", str(tmp_path / "index"))
    index = fulltext.read_index(spark, str(tmp_path / "index"))

    def plain(t):
        return re.findall("[a-z0-9]+", (t or "").lower().replace("é", "e").replace("&", " and "))

    def brute(words=(), prefixes=(), phrases=(), without=()):
        out = {}
        for i, t in enumerate(texts):
            w = plain(t)
            runs = [sum(w[k : k + len(p.split())] == p.split() for k in range(len(w))) for p in phrases]
            if all(x in w for x in words) and all(any(y.startswith(p) for y in w) for p in prefixes) and all(runs) and not any(x in w for x in without):
                out[i] = sum(y in words or any(y.startswith(p) for p in prefixes) for y in w) + sum(runs)
        return out

    for asked in ({"words": ["red"]}, {"prefixes": ["blu"]}, {"phrases": ["the blue"]}, {"words": ["elan"], "prefixes": ["re"], "phrases": ["red box", "of the"], "without": ["end"]}, {"phrases": ["red red"]}, {"words": ["nowhere"]}, {"words": ["blue"], "without": ["blues", "x"]}):
        assert dict(map(tuple, fulltext.search(index, "id", **asked).collect())) == brute(**asked), asked
    assert dict(map(tuple, fulltext.search(index, "id", phrases=["ÉLAN, Red-Box!"]).collect())) == brute(phrases=["elan red box"])
    assert fulltext.search(index, "id").count() == 0
    assert "PushedFilters: [Or(" in fulltext.search(index, "id", words=["red"], phrases=["of the"])._jdf.queryExecution().toString() or "In(word" in fulltext.search(index, "id", words=["red"], phrases=["of the"])._jdf.queryExecution().toString()


def test_sets_as_bitmaps(spark):
    rnd = random.Random(5)
    sets = {n: {rnd.choice([rnd.randrange(1, 50), rnd.randrange(1, 200_000), 32_768, 32_769]) for _ in range(60)} for n in "abc"}
    rows_ = [(n, i) for n, s in sets.items() for i in s for _ in range(2)] + [("a", None)]
    maps = bitsets.bitmaps(spark.createDataFrame(rows_, "name string, id long"), "name", "id")
    assert dict(map(tuple, bitsets.count(maps, ["name"]).collect())) == {n: len(s) for n, s in sets.items()}
    ids = spark.createDataFrame([(i,) for i in sorted(set.union(*sets.values()) | set(range(1, 60)))], "id long")
    for found, want in ((bitsets.union(maps), set.union(*sets.values())), (bitsets.intersection(maps, "name", 3), set.intersection(*sets.values())), (maps.filter("name = 'b'"), sets["b"])):
        assert bitsets.count(found).first()["members"] == len(want)
        assert {r["id"] for r in bitsets.members(ids, "id", found).collect()} == want
    assert bitsets.count(maps.limit(0)).first()["members"] == 0


def test_plain_specialties(spark):
    rules = spark.createDataFrame([("a1", "Doctors", "Heart", 2), ("A1", "Clinics", "Heart", 1), ("b2", "Doctors", "Skin", 1), ("b2", "Doctors", "Heart", 1)], "code string, category string, subcategory string, rank int")
    members = spark.createDataFrame([(1, "A1"), (1, "B2"), (2, "b2"), (3, "zz"), (3, "a1"), (4, None)], "npi int, code string")
    got = {(r["code"], r["category"], r["subcategory"]): r["main"] for r in specialties.placements(members, rules).collect()}
    assert got == {("A1", "Clinics", "Heart"): True, ("A1", "Doctors", "Heart"): False, ("a1", "Clinics", "Heart"): True, ("a1", "Doctors", "Heart"): False, ("B2", "Doctors", "Heart"): True, ("B2", "Doctors", "Skin"): False, ("b2", "Doctors", "Heart"): True, ("b2", "Doctors", "Skin"): False, ("zz", "Other", "Other"): True}
    counts = {(r["level"], r["category"], r["subcategory"]): r["members"] for r in specialties.breakdown(members, rules, "npi").collect()}
    assert counts == {("all", None, None): 3, ("category", "Clinics", None): 2, ("category", "Doctors", None): 3, ("category", "Other", None): 1, ("subcategory", "Clinics", "Heart"): 2, ("subcategory", "Doctors", "Heart"): 3, ("subcategory", "Doctors", "Skin"): 2, ("subcategory", "Other", "Other"): 1}
    shown = {(r["category"], r["subcategory"]): r["members"] for r in specialties.shown(members.filter("npi in (2, 3)"), rules, "npi").collect()}
    assert shown == {("Doctors", "Heart"): 1, ("Other", "Other"): 1, ("Clinics", "Heart"): 1}


def test_sets_are_dealt_out_once(spark):
    from rosterlake.operators import bitsets

    rows = spark.range(5000).selectExpr("id * 7 as id", "if(id % 2 = 0, 'a', 'b') as name").union(spark.range(700).selectExpr("id * 70 as id", "'b' as name")).union(spark.createDataFrame([(None, "a")], "id long, name string"))
    sets = bitsets.bitmaps(rows, "name", "id")
    both = bitsets.intersection(sets, "name", 2)
    told = both._jdf.queryExecution().executedPlan().toString()
    assert told.count("Exchange hashpartitioning") == 1  # ids once, no bitmap
    assert bitsets.count(both).first()["members"] == 500 and bitsets.count(bitsets.union(sets)).first()["members"] == 5200


def test_record_quality_takes_one_source_at_a_time(spark):
    from rosterlake.plans import catalog
    from tests.test_oracle import SF_DIR

    # Put down apart, the sources leave few sorts to the tasks that label.
    plan = catalog.QUERIES["record_quality"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 6 and "o_orderkey" not in plan


def test_postings_are_gathered_without_a_shuffle(spark):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 9))) for i in range(700)] + [(700, None), (701, "!")]
    found = fulltext.postings(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    want = {(w, i): [k for k, x in enumerate(t.split()) if x == w] for i, t in rows[:700] for w in t.split()}
    assert {(r["word"], r["id"]): r["places"] for r in found.collect()} == want and found.count() == len(want)
    assert all(r["n"] == len(r["places"]) for r in found.collect())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_every_line_shapes_the_hash(spark):
    import numpy as np

    from rosterlake.llm import line_dedup

    rnd = random.Random(8)
    texts = ["\n".join(" ".join(rnd.choice(["red", "blue", "stone", "of", "größe", "x7"]) for _ in range(rnd.randrange(1, 30))) for _ in range(6)) for _ in range(60)] + [None, "", "12\n!"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    sums = line_dedup.summed(docs)
    assert sums[0] == 360  # every line with letters, short ones and copies too
    assert abs(sums - line_dedup.moments(texts)).max() <= 8
    changed = line_dedup.summed(spark.createDataFrame([(t,) for t in [*texts, "one more line"]], "text string"))
    assert changed[0] == 361 and not np.array_equal(changed[1:], sums[1:])


def test_providers_of_one_bucket_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(area_state, "BUCKETS", 1)
    versions = spark.sql("select concat('N', id % 5) as npi, make_date(2023, int(1 + id div 5), 1) as from_period, id % 7 > 0 as active, array(concat('A', id % 3)) as areas from range(40)")
    versions.write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", area_state.PROVIDER)
    try:
        stream = area_state.area_delta_stream(spark.readStream.schema(versions.schema).parquet(f"{tmp_path}/in"), "2023-02-01")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = area_state.area_deltas(versions, F.lit("2023-02-01").cast("date"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_cells_are_not_shuffled(spark):
    at = spark.createDataFrame([("N1", "NY", "00001"), ("N1", "NY", "00002"), ("N1", "NY", "00001"), ("N2", None, "00001"), ("N3", "CA", None)], "npi string, state string, zip5 string")
    codes = spark.createDataFrame([("N1", "a"), ("N1", "b"), ("N1", "a"), ("N2", "a")], "npi string, taxonomy_code string")
    crossing = spark.createDataFrame([("00001", "C1"), ("00002", "C1"), ("00002", "TOOLONG")], "zip5 string, county_fips string")
    kinds = spark.createDataFrame([("a", "X", "x"), ("b", "X", "y")], "code string, category string, subcategory string")
    cells = area_counts.contributions(at, codes, crossing, kinds)
    own = [("", ""), ("X", ""), ("X", "x"), ("X", "y")]
    want = [(t, i, c, s, "N1") for t, i in (("us", "US"), ("state", "NY"), ("county", "C1")) for c, s in own] + [("us", "US", "", "", "N3"), ("state", "CA", "", "", "N3")]
    assert sorted(map(tuple, cells.collect())) == sorted(want)
    assert "hashpartitioning(area_type" not in cells._jdf.queryExecution().executedPlan().toString()
