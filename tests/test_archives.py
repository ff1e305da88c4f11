"""Zip archives, header sniffing and letterheads."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from rosterlake.sources import archives, delimited
from rosterlake.sources.sniffing import Dialect, DialectError, sniff


@pytest.fixture
def registry(tmp_path):
    """Two monthly archives of two entries each; the second has its columns in another order."""
    with zipfile.ZipFile(tmp_path / "2020_01.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("npidata_1.csv", "﻿NPI,Name,State\r\n1,\"Doe, \"\"Al\"\"\",NY\r\n2,,NJ\r\n1,Late,CT\r\n")
        z.writestr("pl_pfile_1.csv", "NPI,State,Postal,Country\r\n1,NY,117381234,US\r\n1,NY,11738,\r\n1,TOOLONGSTATE,1,US\r\n3,ON,K1A,CA\r\n")
        z.writestr("readme.pdf", b"\x00")
    with zipfile.ZipFile(tmp_path / "2020_02.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("npidata_2.csv", "State,NPI,Name\nNY,1,\"two\nlines\"\n")
    return tmp_path


def test_every_entry_is_a_partition(spark, registry):
    rows = archives.read_zipped(spark, [str(registry / "*.zip")], "npidata")
    assert rows.columns == ["_archive", "_entry", "_number", "NPI", "Name", "State"]
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [("npidata_1.csv", 1, "1", 'Doe, "Al"', "NY"), ("npidata_1.csv", 2, "2", None, "NJ"), ("npidata_1.csv", 3, "1", "Late", "CT"), ("npidata_2.csv", 1, "1", "two\nlines", "NY")]
    with pytest.raises(Exception, match="no entry like"):
        archives.read_zipped(spark, [str(registry / "*.zip")], "nothing")


def test_staging_tables_have_a_hash_of_the_cells(spark, registry):
    out = archives.staged(spark, [str(registry / "*.zip")], {"main": "npidata", "places": "pl_pfile"}, hashed="main")
    assert out["places"].columns == ["NPI", "State", "Postal", "Country", "loaded_from"] and out["places"].count() == 4
    rows = out["main"].collect()
    assert len({r["source_hash"] for r in rows}) == 4 and len(rows[0]["source_hash"]) == 32
    # The same cells in another order of columns are the same row.
    a = spark.createDataFrame([("x", "", "z")], "b string, a string, C string").select(archives.row_hash(["b", "a", "C"]).alias("h")).first()["h"]
    b = spark.createDataFrame([("z", "x", None)], "C string, b string, a string").select(archives.row_hash(["C", "b", "a"]).alias("h")).first()["h"]
    assert a == b


def test_two_entries_are_merged_by_key(spark, registry):
    main = archives.read_zipped(spark, [str(registry / "2020_01.zip")], "npidata")
    places = archives.read_zipped(spark, [str(registry / "2020_01.zip")], "pl_pfile")
    got = {r["NPI"]: (r["Name"], [tuple(p) for p in r["places"]]) for r in archives.with_locations(main, places, "NPI", "State", "Postal", "Country").collect()}
    assert got == {"1": ("Late", [("NY", "11738")]), "2": (None, [])}  # the last row of a key stands
    assert [r["places"] for r in archives.with_locations(main, None, "NPI", "State", "Postal", "Country").collect()] == [None, None]


def test_the_largest_entry_of_a_big_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("notes.txt", "a|b\n1|2\n")
        z.writestr("data/all.csv", "k,v\n" + "".join(f"{i},{i * i}\n" for i in range(25_000)))
    rows = archives.read_zipped(spark, [str(tmp_path / "big.zip")], largest="true")
    assert rows.select(F.count("*"), F.sum(F.col("v").cast("long")), F.max("_number")).first()[:] == (25_000, sum(i * i for i in range(25_000)), 25_000)


def test_rows_of_another_width(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "a,b,c\n1,2,3\n4,5\n\n6,7,8,9\n")
    with pytest.raises(Exception, match="2 cells"):
        archives.read_zipped(spark, [str(tmp_path / "a.zip")], sep=",").collect()
    rows = archives.read_zipped(spark, [str(tmp_path / "a.zip")], sep=",", ragged="true")
    assert [tuple(r)[2:] for r in rows.collect()] == [(1, "1", "2", "3"), (2, "4", "5", None), (4, "6", "7", "8")]


def test_pipe_list_with_continuation_lines(spark, tmp_path):
    lines = [
        "ID|Provider Name|Enrollment Type|NPI|Current Medicaid Enrollment Status|Claims Effective|Claims End|Address",
        "1|Doe \"Al|ENROLLMENT|1234567893|A|2020-01-01|2999-12-31|1 A St", "1|||||||2 B St", "1|", "2|Roe|limited enrollment|1234567893|A|1899-01-01||x", "3|Poe|ENROLLMENT|1234567890|A|2020-01-01||bad digit", "4|Moe|ENROLLMENT|1234567893|I|2020-01-01||",
        "5|Noe|REGISTERED|1234567893|A|2020-01-01||", "6|Joe|ENROLLMENT|1234567893|A|2020-01-01|2021-01-01|ended", "7|Léo|LIMITED|1234567893|A|20200101|soon|x",
    ]
    with zipfile.ZipFile(tmp_path / "fl.zip", "w") as z:
        z.writestr("list.txt", "\r\n".join(lines).encode("latin-1"))
    rows = archives.read_zipped(spark, [str(tmp_path / "fl.zip")], sep="|", quote="", encoding="latin-1", ragged="true")
    assert rows.count() == 9
    named = {"name": "Provider Name", "type": "Enrollment Type", "npi": "NPI", "status": "Current Medicaid Enrollment Status", "effective": "Claims Effective", "end": "Claims End"}
    got = [tuple(r) for r in archives.active_enrollments(rows, named, F.lit("2026-01-01").cast("date")).collect()]
    assert got == [("1234567893", dt.date(2020, 1, 1), False), ("1234567893", None, True), ("1234567893", None, True)]


@pytest.mark.parametrize(
    ("sample", "want"),
    [
        ("a,b\n1,2\n", Dialect(",")), ("a;b\n1,5;2\n3,4;4\n", Dialect(";")), ("﻿a\tb\r\n1\t2\r\n", Dialect("\t", '"', "\r\n", True)), ('a|b\n"x|y"|"z\nq"\n1|2\n', Dialect("|")),
        ("a,b,c\n'x,y','it''s',3\n'p,q',r,4\n", Dialect(",", "'")), ("a,b\r1,2\r", Dialect(",", '"', "\r")), ("only\n1\n2\n", Dialect(",")), ('"a, b",c\n"1, 2",3\n', Dialect(",")), ("a;b;c\n1;2;3\n4;5;\"cut", Dialect(";")), ("x", Dialect(",")),
    ],
)
def test_sniffed_dialects(sample, want):
    assert sniff(sample) == want


def test_a_sample_that_fits_no_separator():
    with pytest.raises(DialectError):
        sniff("a,\"b,'c\n1,2,3\n", whole=True)


def test_odd_files_are_read(spark, tmp_path):
    fields = (delimited.Field("a", "A"), delimited.Field("b", "B"))
    for name, content in {"semi.csv": "A;B\n1,5;x\n2,5;\"y;z\"\n", "tab.csv": "﻿A\tB\r\n1,5\tx\r\n2,5\ty;z\r\n", "pipe.csv": 'A|B\n"1,5"|x\n2,5|y;z\n', "single.csv": "A,B\n'1,5','x'\n'2,5','y;z'\n"}.items():
        (tmp_path / name).write_text(content, newline="")
        got = [tuple(r) for r in delimited.read(spark, str(tmp_path / name), delimited.FileSpec(fields, sep="auto")).collect()]
        assert got == [("1,5", "x"), ("2,5", "y;z")], name


def test_a_folder_of_files_with_letterheads(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"{n:02}.csv").write_text("Report\n" * (n % 3) + f"Number,Name\n{n},x\n,Number\nNumber,y\n")
    spec = delimited.FileSpec((delimited.Field("number", "Number"), delimited.Field("name", "Name")), header_starts_with="Number")
    got = sorted(((r["number"] or ""), r["name"]) for r in delimited.read(spark, str(tmp_path), spec).collect())
    assert got == sorted([(str(n), "x") for n in range(12)] + [("", "Number")] * 12 + [("Number", "y")] * 12)
