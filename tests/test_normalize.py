import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom import model
from gridloom.functions.coerce import cell_text, coerce, parse_date
from gridloom.functions.similarity import similarity
from gridloom.functions.text import file_stem, norm_header, safe_file_name
from gridloom.plans import driver_inputs
from gridloom.operators.normalize import header_key, normalize, normalized_counts, validation_items


def canonical(spark, *rows, maps=None):
    body = [("b", "f", 0, None, i, e, [(h, v) for h, v in cells]) for i, (e, cells) in enumerate(rows)]
    df = spark.createDataFrame(body, model.EXTRACTED_SCHEMA)
    if maps is not None:
        m = spark.createDataFrame(list(enumerate(maps)), "source_row_index bigint, columns map<string,string>")
        df = df.join(m, "source_row_index")
    return normalize(df).orderBy("row_ord").collect()


def test_aliases_and_numbers(spark):
    row, = canonical(spark, ("PRODUCT", [("Product Name", "Harbour Walk 3h"), ("SKU", "NO-HRB-3"),
                                         ("Price", "1,875"), ("Currency", "USD")]))
    assert (row.data.name, row.data.price, row.data.currency) == ("Harbour Walk 3h", 1875.0, "USD")
    assert (row.key_code, row.dedupe_key, row.validation_errors) == ("no-hrb-3", "no-hrb-3", [])
    assert (row.record_id, row.status) == ("b:0:0", "DRAFT")


def test_explicit_mapping_has_no_alias_behind_it(spark):
    one, two, three = canonical(
        spark,
        ("BOOKING", [("Ref", "BK-1"), ("Departs", "2026-07-01")]),
        ("TRAVELER", [("Mail To", ""), ("MAIL-TO", "a@b.com"), ("email", "z@z.com")]),
        ("TRAVELER", [("Mail To", None), ("MAIL-TO", "a@b.com"), ("email", "z@z.com")]),
        maps=[{"reference": "Ref", "startDate": "Departs"}, {"email": "Mail To"}, {"email": "Mail To"}],
    )
    assert (one.data.reference, one.data.startDate) == ("BK-1", "2026-07-01T00:00:00.000Z")
    assert two.data.email is None  # an empty cell under the exact header is final
    assert three.data.email == "a@b.com"  # a missing one falls back to the normal form


def test_errors_keep_best_effort_data(spark):
    row, blank, none, person = canonical(
        spark, ("TRAVELER", [("Email", "mira at home"), ("Name", "Mira Lindqvist")]),
        ("PRODUCT", [("name", "  ")]), ("PRODUCT", [("name", "")]),
        ("GUIDE", [("guide", "\t"), ("e-mail", " A@B.co ")]))
    assert row.validation_errors == ["email: Invalid email"]
    assert (row.data.fullName, row.key_name, row.key_email) == ("Mira Lindqvist", "mira lindqvist", "mira at home")
    assert blank.validation_errors == ["name: String must contain at least 1 character(s)"]
    assert (blank.data.name, blank.key_name) == ("", None)
    assert none.validation_errors == ["name: Required"]
    assert person.validation_errors == ["fullName: String must contain at least 1 character(s)"]
    assert person.data.email == "a@b.co"


def test_headers_with_one_key_last_wins_and_blank_hits_fall_through(spark):
    row, = canonical(spark, ("PRODUCT", [("NAME", "first"), ("name", "second"), ("Title", "third"), ("price", "")]))
    assert (row.data.name, row.data.price) == ("second", None)
    row, = canonical(spark, ("PRODUCT", [("name", ""), ("Title", "third"), ("product", "fourth")]))
    assert row.data.name == "third"


NUMBERS = {"1,875": 1875.0, "N/A": 0.0, "1-2": None, "1e5": 15.0, "€1.234,56": 1.23456, "-": None, "5.": 5.0,
           ".5": 0.5, " ": 0.0, "": None, "-0.5": -0.5, "--5": None, "9" * 400: None, None: None}
DATES = {
    "2026-07-01": "2026-07-01T00:00:00.000Z", "2026-07-01T10:00": "2026-07-01T10:00:00.000Z",
    "2026-07-01T10:00:05.123456Z": "2026-07-01T10:00:05.123Z", "2026-07-01 10:00:05+02:00": "2026-07-01T08:00:05.000Z",
    "7/1/2026 9:05": "2026-07-01T09:05:00.000Z", "Jul 1, 2026": "2026-07-01T00:00:00.000Z",
    "1 July 2026": "2026-07-01T00:00:00.000Z", "2026": "2026-01-01T00:00:00.000Z", " soon ": "soon",
    "2026/7/1": "2026-07-01T00:00:00.000Z", "2026-07-01T00:00:00-0530": "2026-07-01T05:30:00.000Z", "": None,
    "13/45/2026": "13/45/2026",
}


@pytest.mark.parametrize("field,cases", [("price", NUMBERS), ("startDate", DATES)])
def test_coercion(spark, field, cases):
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.v for r in df.select("c", coerce(field, cell_text(F.col("c"))).alias("v")).collect()}
    assert got == cases


def test_dates_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2026-03-08T02:30:00",), ("2026-03-08T02:30:00Z",), ("Mar 8, 2026",)], "c string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        shown = [r.v for r in df.select(parse_date(F.col("c")).cast("string").alias("v")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert shown == ["2026-03-08 02:30:00", "2026-03-08 02:30:00", "2026-03-08 00:00:00"]


def test_booking_key_date(spark):
    row, bad = canonical(spark, ("BOOKING", [("date", "7/1/2026")]), ("BOOKING", [("date", "later")]))
    assert row.key_date == dt.datetime(2026, 7, 1) and row.dedupe_key == "2026-07-01T00:00:00.000Z"
    assert (bad.key_date, bad.dedupe_key, bad.data.startDate) == (None, None, "later")


def test_validation_items_and_counts(spark):
    df = normalize(spark.createDataFrame(
        [("b", "f", 0, None, 0, "GUIDE", [("email", "x"), ("name", " ")])], model.EXTRACTED_SCHEMA))
    item = validation_items(df).first()
    assert item.explanation == ("This row has validation problems: fullName: String must contain at least"
                                " 1 character(s); email: Invalid email.")
    assert (item.priority, item.status, item.review_item_id) == (2, "OPEN", "b:0:0:VALIDATION_ERROR")
    assert normalized_counts(df).first().asDict() == {
        "batch_id": "b", "entity_type": "GUIDE", "normalized": 1, "validation_flags": 1}


def test_text_helpers(spark):
    df = spark.createDataFrame([("a/b\\My  File (1).tar.csv",), ("???",), ("noext",)], "p string")
    got = [tuple(r) for r in df.select(file_stem(F.col("p")), safe_file_name(F.col("p"))).collect()]
    assert got == [("My  File (1).tar", "a_b_My_File_1_.tar.csv"), ("???", "_"), ("noext", "noext")]
    for text in ("Full Name", "fullName", " e-mail ", "Ünit Price", "__"):
        assert spark.range(1).select(norm_header(F.lit(text))).first()[0] == header_key(text)


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "abd"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1 - 1 / 3, 0.0]


def test_rows_of_one_file_are_normalised_by_many_tasks(spark, tmp_path, monkeypatch):
    """Also where only the faulty ones are wanted: none are picked out before the rows are dealt."""
    spark.range(300).selectExpr("id AS s_suppkey", "concat('Supplier ', id) AS s_name", "cast(id % 25 AS int) AS s_nationkey") \
        .coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(driver_inputs, "TASK_ROWS", 50)
    rows = normalize(driver_inputs.extracted(spark, str(tmp_path), driver_inputs.GUIDES), ("GUIDE",))
    assert rows.rdd.getNumPartitions() == 6
    assert rows.select("row_ord").distinct().count() == rows.count() == 300
    faulty = rows.filter(F.size("validation_errors") > 0)
    plan = faulty._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.index("Repartition") > plan.rindex("Filter")
