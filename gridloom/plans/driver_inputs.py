"""Raw spreadsheet rows derived from the driver's tables.

Each cell is one SQL expression that Spark and DuckDB read alike, so a query and its check start
from the same text. The expressions plant what spreadsheets bring: other header spellings,
mixed date layouts, unreadable prices, broken e-mails, keys used twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lineage import materialize
from gridloom.operators.findings import find_duplicates
from gridloom.operators.normalize import normalize

_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(o_orderdate) * 3 - 2, 3)"
_YMD = (
    "concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'),"
    " '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))"
)
_MDY = (
    "concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/',"
    " CAST(year(o_orderdate) AS STRING))"
)
_WRITTEN = (
    f"concat({_MONTH}, ' ', CAST(day(o_orderdate) AS STRING), ', ', CAST(year(o_orderdate) AS STRING))"
)


@dataclass(frozen=True)
class Raw:
    """One entity's raw rows: the table, batch, row number and cells by header."""

    table: str
    entity_type: str
    batch: str
    row: str
    cells: dict[str, str]

    def sql(self) -> str:
        """The raw rows as a DuckDB query: batch_id, ord and one column per header."""
        cells = ", ".join(f'{e} AS "{h}"' for h, e in self.cells.items())
        return f"SELECT {self.batch} AS batch_id, {self.row} AS ord, {cells} FROM {self.table}"


PRODUCTS = Raw(
    "part", "PRODUCT", "concat('P', p_partkey % 4)", "p_partkey",
    {
        "Product Name": "CASE WHEN p_partkey % 97 = 0 THEN '' WHEN p_partkey % 89 = 0 THEN '   '"
                        " ELSE concat(' ', p_name, ' ', p_type, ' ', p_brand, ' ') END",
        "SKU": "CASE WHEN p_partkey % 20 = 8 THEN concat('SKU-', p_partkey - 8)"
               " ELSE concat('sku-', p_partkey) END",
        "Type": "p_type",
        "Price": "CASE p_partkey % 10 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '1-2'"
                 " WHEN 3 THEN concat('USD 1,234.', p_partkey % 100) WHEN 4 THEN '  '"
                 " ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END",
        "Ccy": "'USD'",
    },
)
TRAVELERS = Raw(
    "customer", "TRAVELER", "concat('T', c_nationkey)", "c_custkey",
    {
        "Full Name": "CASE WHEN c_custkey % 101 = 5 THEN '  ' ELSE concat(c_name, ' of ', c_mktsegment) END",
        "E-Mail": "CASE WHEN c_custkey % 11 = 0 THEN concat('user', c_custkey)"
                  " WHEN c_custkey % 13 = 0 THEN concat('.a', c_custkey, '@example.com')"
                  " WHEN c_custkey % 17 = 0 THEN concat('a..b', c_custkey, '@example.com')"
                  " WHEN c_custkey % 7 = 3 THEN concat(' USER', c_custkey % 40, '@Example.com ')"
                  " ELSE concat('user.', c_custkey, '@example.com') END",
        "Mobile": "concat('+', c_custkey * 7919)",
    },
)
GUIDES = Raw(
    "supplier", "GUIDE", "concat('G', s_nationkey % 3)", "s_suppkey",
    {
        "Guide Name": "concat(s_name, ' Mountain Tours ', s_suppkey % 30)",
        "mail": "CASE WHEN s_suppkey % 9 = 4 THEN 'office@tours.example'"
                " WHEN s_suppkey % 5 = 0 THEN ''"
                " ELSE concat('guide', s_suppkey, '@tours.example') END",
    },
)
BOOKINGS = Raw(
    "orders", "BOOKING", "concat('B', o_orderpriority)", "o_orderkey",
    {
        "Booking Ref": "CASE WHEN o_orderkey % 25 = 5 THEN concat('BK-', o_orderkey - o_orderkey % 100)"
                       " ELSE concat('bk-', o_orderkey) END",
        "Product Code": "concat('SKU-', o_custkey % 200)",
        "Customer": "concat('user.', o_custkey, '@example.com')",
        "Departure Date": f"CASE o_orderkey % 6 WHEN 0 THEN {_YMD} WHEN 1 THEN {_MDY}"
                          f" WHEN 2 THEN concat({_YMD}, 'T10:00:00+02:00') WHEN 3 THEN ' soon '"
                          f" WHEN 4 THEN '' ELSE {_WRITTEN} END",
    },
)
QUALIFICATIONS = Raw(
    "supplier", "QUALIFICATION", "concat('Q', s_nationkey % 3)", "s_suppkey",
    {
        "Qual Code": "concat('Q-', s_suppkey % 40)",
        "Title": "concat('Level ', s_suppkey % 40, ' Guide')",
        "Guide Email": "concat('Guide', s_suppkey + s_suppkey % 3, '@tours.example')",
    },
)
RULES = Raw(
    "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) AS pairs", "STAFFING_RULE",
    "concat('R', l_partkey)", "l_suppkey",
    {
        "Rule": "concat('Rule ', l_partkey, ' ', l_suppkey % 40)",
        "Product": "concat('SKU-', l_partkey)",
        "Qual": "concat('q-', l_suppkey % 40)",
    },
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_frame(spark: SparkSession, sf_dir: str, raw: Raw) -> DataFrame:
    if raw is RULES:
        return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return table(spark, sf_dir, raw.table)


#: raw rows one task turns into canonical ones, and how few make a task of their own while cores are free
TASK_ROWS = 50_000
MIN_TASK_ROWS = 5_000


def spread(rows: DataFrame, n: int) -> DataFrame:
    """Rows, at most `n` of them, dealt evenly to as many tasks as their number asks for.

    A table is read by a task per file or row group, however many rows that holds, and normalising a row
    costs far more than its bytes tell.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil(n / TASK_ROWS), min(cores, math.ceil(n / MIN_TASK_ROWS)))
    return rows.repartition(tasks) if tasks > 1 else rows


def extracted(spark: SparkSession, sf_dir: str, raw: Raw) -> DataFrame:
    """Extracted rows with their cells in header order."""
    cells = F.array(*[
        F.struct(F.lit(h).alias("header"), F.expr(e).alias("value")) for h, e in raw.cells.items()
    ])
    n = table(spark, sf_dir, "lineitem" if raw is RULES else raw.table).count()
    own = F.struct(F.expr(raw.batch).alias("batch_id"), F.expr(raw.row).cast("bigint").alias("source_row_index"),
                   cells.alias("cells"))
    # Unpacked from a list of one, so that no filter on what follows from the cells is worked out before the rows are dealt.
    return spread(raw_frame(spark, sf_dir, raw), n).select(F.inline(F.array(own))).select(
        "batch_id", F.lit(0).alias("sheet_index"), "source_row_index",
        F.lit(raw.entity_type).alias("entity_type"), "cells",
    )


def canonical(spark: SparkSession, sf_dir: str, raw: Raw) -> DataFrame:
    return normalize(extracted(spark, sf_dir, raw), (raw.entity_type,)).withColumn(
        "external_id", F.lit(None).cast("string")
    )


def guide_base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Canonical guides and their duplicate findings, each computed once."""
    rows = materialize(canonical(spark, sf_dir, GUIDES))
    return rows, materialize(find_duplicates(rows, one_key=True))


# -- the same canonical rows in SQL, written out by hand per entity ---------------------------

_BAD_MAIL = (
    "({e} LIKE '.%' OR {e} LIKE '%..%' OR NOT regexp_full_match({e},"
    " '[a-z0-9_''+.-]*[a-z0-9_+-]@([a-z0-9][a-z0-9-]*\\.)+[a-z]{{2,}}'))"
)
_ID = "concat(batch_id, ':0:', ord)"


def products_sql() -> str:
    """canonical product rows: batch_id, ord, record_id, name, sku, category, price, ..."""
    digits = "regexp_replace(\"Price\", '[^0-9.-]', '', 'g')"
    return f"""
      SELECT batch_id, ord, {_ID} AS record_id, 'PRODUCT' AS entity_type, name, sku, category,
             CASE WHEN "Price" = '' THEN NULL WHEN {digits} = '' THEN 0.0
                  ELSE TRY_CAST({digits} AS DOUBLE) END AS price,
             "Ccy" AS currency, CAST(NULL AS VARCHAR) AS key_email, lower(sku) AS key_code,
             CASE WHEN name <> '' THEN lower(name) END AS key_name,
             lower(sku) AS dedupe_key,
             CASE WHEN name IS NULL THEN 'name: Required'
                  WHEN name = '' THEN 'name: String must contain at least 1 character(s)'
                  ELSE '' END AS errors
      FROM (SELECT *, CASE WHEN "Product Name" <> '' THEN trim("Product Name") END AS name,
                   "SKU" AS sku, "Type" AS category FROM ({PRODUCTS.sql()}))"""


def people_sql(raw: Raw, name: str, mail: str, phone: str | None) -> str:
    bad = _BAD_MAIL.format(e="email")
    return f"""
      SELECT batch_id, ord, {_ID} AS record_id, '{raw.entity_type}' AS entity_type, full_name,
             email, {f'"{phone}"' if phone else 'CAST(NULL AS VARCHAR)'} AS phone,
             CASE WHEN email <> '' THEN email END AS key_email, CAST(NULL AS VARCHAR) AS key_code,
             CASE WHEN full_name <> '' THEN lower(full_name) END AS key_name,
             coalesce(CASE WHEN email <> '' THEN email END,
                      CASE WHEN full_name <> '' THEN lower(full_name) END) AS dedupe_key,
             concat_ws('; ',
               CASE WHEN full_name = '' THEN 'fullName: String must contain at least 1 character(s)' END,
               CASE WHEN email IS NOT NULL AND {bad} THEN 'email: Invalid email' END) AS errors
      FROM (SELECT *, CASE WHEN "{name}" <> '' THEN trim("{name}") END AS full_name,
                   CASE WHEN "{mail}" <> '' THEN lower(trim("{mail}")) END AS email
            FROM ({raw.sql()}))"""


def travelers_sql() -> str:
    return people_sql(TRAVELERS, "Full Name", "E-Mail", "Mobile")


def guides_sql() -> str:
    return people_sql(GUIDES, "Guide Name", "mail", None)


def bookings_sql() -> str:
    """The dates come from the order date itself, not from the texts made of it."""
    return f"""
      SELECT batch_id, ord, {_ID} AS record_id, 'BOOKING' AS entity_type, reference, product_ref,
             traveler_ref,
             CASE WHEN ord % 6 = 4 THEN NULL WHEN ord % 6 = 3 THEN 'soon'
                  ELSE strftime(day_at, '%Y-%m-%dT%H:%M:%S.000Z') END AS start_date,
             CASE WHEN ord % 6 NOT IN (3, 4) THEN day_at END AS key_date,
             CAST(NULL AS VARCHAR) AS key_email, lower(reference) AS key_code,
             lower(product_ref) AS key_name, lower(reference) AS dedupe_key, '' AS errors
      FROM (SELECT batch_id, ord, "Booking Ref" AS reference, "Product Code" AS product_ref,
                   "Customer" AS traveler_ref,
                   CASE WHEN ord % 6 = 2 THEN o_orderdate + INTERVAL 8 HOUR ELSE o_orderdate END AS day_at
            FROM ({BOOKINGS.sql()}) JOIN orders ON o_orderkey = ord)"""


def qualifications_sql() -> str:
    return f"""
      SELECT batch_id, ord, {_ID} AS record_id, 'QUALIFICATION' AS entity_type,
             "Qual Code" AS code, "Title" AS name, "Guide Email" AS guide_ref,
             CAST(NULL AS VARCHAR) AS key_email, lower("Qual Code") AS key_code,
             lower("Title") AS key_name, lower("Qual Code") AS dedupe_key, '' AS errors
      FROM ({QUALIFICATIONS.sql()})"""


def rules_sql() -> str:
    return f"""
      SELECT batch_id, ord, {_ID} AS record_id, 'STAFFING_RULE' AS entity_type, "Rule" AS name,
             "Product" AS product_ref, "Qual" AS qualification_ref,
             CAST(NULL AS VARCHAR) AS key_email, CAST(NULL AS VARCHAR) AS key_code,
             lower("Rule") AS key_name, lower("Rule") AS dedupe_key, '' AS errors
      FROM ({RULES.sql()})"""


def findings_sql(records: str) -> str:
    """Duplicate findings of any records query, comparing all names of a batch in SQL."""
    ratio = ("1.0::DOUBLE - levenshtein(a.key_name, b.key_name)"
             " / greatest(length(a.key_name), length(b.key_name))")
    return f"""
      WITH recs AS (SELECT batch_id, ord, record_id, entity_type, key_email, key_code, key_name
                    FROM ({records})),
      firsts AS (SELECT *,
          min(ord) OVER (PARTITION BY batch_id, entity_type, key_email) AS pe,
          min(ord) OVER (PARTITION BY batch_id, entity_type, key_code) AS pc FROM recs),
      exact AS (SELECT *, CASE WHEN key_email IS NOT NULL AND pe < ord THEN 'email'
          WHEN key_code IS NOT NULL AND pc < ord THEN 'code' END AS kind FROM firsts),
      rest AS (SELECT * FROM exact WHERE kind IS NULL AND key_name IS NOT NULL),
      names AS (SELECT batch_id, entity_type, key_name, min(ord) AS first_ord FROM rest
          GROUP BY batch_id, entity_type, key_name),
      best AS (SELECT a.batch_id, a.entity_type, a.key_name, min(b.first_ord) AS peer_ord
          FROM names a JOIN names b ON a.batch_id = b.batch_id AND a.entity_type = b.entity_type
            AND b.first_ord <= a.first_ord
            AND (a.key_name = b.key_name OR ({ratio}) >= 0.85::DOUBLE)
          GROUP BY a.batch_id, a.entity_type, a.key_name),
      fuzzy AS (SELECT a.batch_id, a.ord, a.record_id, a.entity_type, a.key_name, t.peer_ord,
            b.key_name AS peer_name,
            CASE WHEN a.key_name = b.key_name THEN 1.0::DOUBLE ELSE {ratio} END AS score
          FROM rest a JOIN best t ON a.batch_id = t.batch_id AND a.entity_type = t.entity_type
            AND a.key_name = t.key_name AND t.peer_ord < a.ord
          JOIN names b ON b.batch_id = t.batch_id AND b.entity_type = t.entity_type
            AND b.first_ord = t.peer_ord),
      label AS (SELECT * FROM (VALUES ('PRODUCT', 'product'), ('BOOKING', 'booking'),
          ('TRAVELER', 'traveler'), ('GUIDE', 'guide'), ('QUALIFICATION', 'qualification'),
          ('STAFFING_RULE', 'staffing rule')) AS v(entity_type, label)),
      found AS (
        SELECT batch_id, ord, record_id, entity_type, concat(kind, '_exact') AS strategy,
          1.0::DOUBLE AS score, 'DUPLICATE' AS reason,
          CASE kind WHEN 'email' THEN pe ELSE pc END AS peer_ord,
          concat('Shares ', kind, ' "', CASE kind WHEN 'email' THEN key_email ELSE key_code END,
            '" with an earlier ', label, ' in this upload — likely the same record.') AS explanation
        FROM exact JOIN label USING (entity_type) WHERE kind IS NOT NULL
        UNION ALL
        SELECT batch_id, ord, record_id, entity_type, 'name_fuzzy', score,
          CASE WHEN score >= 0.97::DOUBLE THEN 'DUPLICATE' ELSE 'LOW_CONFIDENCE' END, peer_ord,
          concat('Name "', key_name, '" is ~', CAST(floor(score * 100 + 0.5) AS INTEGER),
            '% similar to "', peer_name, '" on another ', label, ' row',
            CASE WHEN score >= 0.97::DOUBLE THEN ' — likely a duplicate.'
                 ELSE ' — possible duplicate, please confirm.' END)
        FROM fuzzy JOIN label USING (entity_type))
      SELECT *, concat(batch_id, ':0:', peer_ord) AS peer_record_id FROM found"""


def candidates_sql(records: str) -> str:
    return f"""
      SELECT batch_id, ord, concat(record_id, ':', strategy) AS candidate_id, record_id, entity_type,
             'INTRA_BATCH' AS target_kind, peer_record_id AS target_record_id, score, strategy,
             'CANDIDATE' AS status FROM ({findings_sql(records)})"""


def items_sql(records: str) -> str:
    """All open review items of a records query: validation problems and findings."""
    return f"""
      SELECT batch_id, ord, concat(record_id, ':VALIDATION_ERROR') AS review_item_id, record_id,
             entity_type, 'VALIDATION_ERROR' AS reason, 'OPEN' AS status, 2 AS priority,
             concat('This row has validation problems: ', errors, '.') AS explanation
      FROM ({records}) WHERE errors <> ''
      UNION ALL
      SELECT batch_id, ord, concat(record_id, ':', reason), record_id, entity_type, reason, 'OPEN',
             CASE reason WHEN 'DUPLICATE' THEN 1 ELSE 0 END, explanation
      FROM ({findings_sql(records)})"""
