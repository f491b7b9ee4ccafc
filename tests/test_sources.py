import pytest
from pyspark.sql import functions as F

from gridloom.sources import csv_files, files, workbook
from tests.support import write_workbook


def cells(row):
    return [(c.header, c.value) for c in row.cells]


def by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.source_file, r.source_row_index)):
        out.setdefault(r.source_file.rsplit("/", 1)[-1], []).append(r)
    return out


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_files_with_different_headers(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("﻿sku, name \n\nS1,  Trek one \n   \nS2,\"Dive, two\",extra\nS3\n", "utf-8")
    (tmp_path / "b.csv").write_text('email,fullName,email\nx@y.com,"Ann ""A"" Lee",z@y.com\n')
    (tmp_path / "c.csv").write_text("only,header\n")
    (tmp_path / "d.csv").write_text("")
    got = by_file(csv_files.read_csv(spark, str(tmp_path), multi_line).collect())
    assert [r.source_row_index for r in got["a.csv"]] == [0, 1, 2]
    assert [cells(r) for r in got["a.csv"]] == [
        [("sku", "S1"), ("name", "Trek one")],
        [("sku", "S2"), ("name", "Dive, two")],
        [("sku", "S3"), ("name", None)],
    ]
    assert cells(got["b.csv"][0]) == [("email", "x@y.com"), ("fullName", 'Ann "A" Lee'), ("email", "z@y.com")]
    assert set(got) == {"a.csv", "b.csv"}


def test_csv_quoted_line_break(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nx,"two\nlines"\ny,z\n')
    got = csv_files.read_csv(spark, str(tmp_path)).orderBy("source_row_index").collect()
    assert [cells(r) for r in got] == [[("name", "x"), ("note", "two\nlines")], [("name", "y"), ("note", "z")]]


def test_csv_rows_keep_their_place_across_splits(spark, tmp_path):
    n = 20_000
    (tmp_path / "big.csv").write_text("id,v\n" + "".join(f"{i},value {i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = csv_files.read_csv(spark, str(tmp_path), multi_line=False)
        bad = rows.filter(F.col("source_row_index").cast("string") != F.col("cells")[0]["value"])
        assert rows.count() == n and bad.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_of_500_columns(spark, tmp_path):
    wide = [f"h{i}" for i in range(500)]
    (tmp_path / "w.csv").write_text(",".join(wide) + "\n" + ",".join(map(str, range(500))) + "\n")
    (tmp_path / "n.csv").write_text("a\n1\n")
    got = by_file(csv_files.read_csv(spark, str(tmp_path)).collect())
    assert cells(got["w.csv"][0]) == [(f"h{i}", str(i)) for i in range(500)]
    assert cells(got["n.csv"][0]) == [("a", "1")]


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_empty_cells_keep_their_place(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text(
        'sku,name,price\nA,,10\n,Gamma,5\n,,7\n,,\n   \n\nD, ,9\nE\n"",,\nF,5" pipe,"a ""b"", c"\n')
    rows = by_file(csv_files.read_csv(spark, str(tmp_path), multi_line).collect())["a.csv"]
    assert [[v for _, v in cells(r)] for r in rows] == [
        ["A", "", "10"], ["", "Gamma", "5"], ["", "", "7"], ["", "", ""], ["D", "", "9"], ["E", None, None],
        ["", "", ""], ["F", '5" pipe', 'a "b", c'],
    ]


def test_files_with_a_header_only_are_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,x\n")
    (tmp_path / "b.csv").write_text("x\n1\n2\n")
    found = csv_files.sheets_of(csv_files.scan_csv(spark, str(tmp_path))).collect()
    assert {r.source_file.rsplit("/", 1)[-1]: (r.headers, r.row_count) for r in found} == {
        "a.csv": (["x", "y"], 0), "b.csv": (["x"], 2)}


def test_workbook_cells(spark, tmp_path):
    write_workbook(tmp_path / "book.xlsx", {
        "Products": [["sku", " Name ", None, "price", "when", "flag"],
                     ["S1", ("rich", ["Big ", "trek"]), "lost", 2450, ("date", 46204.5), True],
                     [None, "", None, None, None, None],
                     ["S2", ("formula", 7), None, 0.1, ("formula", None), ("error", "#N/A")]],
        "Empty": [["a", "b"]],
        "Nothing": [],
    })
    scan = workbook.read_workbooks(spark, str(tmp_path))
    rows = workbook.data_rows(scan).orderBy("source_row_index").collect()
    assert [cells(r) for r in rows] == [
        [("sku", "S1"), ("Name", "Big trek"), ("price", "2450"), ("when", "2026-07-01T12:00:00.000Z"), ("flag", "true")],
        [("sku", "S2"), ("Name", "7"), ("price", "0.1"), ("when", "[object Object]"), ("flag", "[object Object]")],
    ]
    assert [r.source_row_index for r in rows] == [0, 1]
    sheets = {r.sheet_name: (r.sheet_index, r.headers, r.row_count) for r in workbook.sheet_list(scan).collect()}
    assert sheets == {
        "Products": (0, ["sku", "Name", "price", "when", "flag"], 2),
        "Empty": (1, ["a", "b"], 0), "Nothing": (2, [], 0),
    }


def test_merged_cells_show_their_first_value(spark, tmp_path):
    write_workbook(tmp_path / "m.xlsx", {"Guides": [["name", "email"], ["Ann", "a@b.com"], ["Bob", None]]},
                   merges=["B2:B3"])
    rows = workbook.data_rows(workbook.read_workbooks(spark, str(tmp_path))).orderBy("source_row_index").collect()
    assert [dict(cells(r))["email"] for r in rows] == ["a@b.com", "a@b.com"]


def test_routing_and_manifest(spark, tmp_path):
    for name in ("a.CSV", "b.xlsm", "c.pdf"):
        (tmp_path / name).write_bytes(b"abc")
    found = files.list_files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[-1]: r.kind for r in found.collect()}
    assert kinds == {"a.CSV": "CSV", "b.xlsm": "XLSX", "c.pdf": None}
    assert [r.reject_reason for r in files.unsupported(found).collect()] == ["unsupported file: c.pdf"]
    raw = spark.createDataFrame([("s1", "my file?.csv", bytearray(b"abc"))], "session string, name string, body binary")
    row = files.artifact_manifest(raw, F.col("session"), F.col("name"), F.col("body"), F.lit("text/csv")).first()
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert (row.content_hash, row.byte_size) == (digest, 3)
    assert row.storage_key == f"s1/{digest[:12]}-my_file_.csv"
