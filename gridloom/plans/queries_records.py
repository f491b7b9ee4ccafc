"""Driver queries over raw rows: normalisation, validation, files, sheets and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.fixed_values import FIELD_ALIASES
from gridloom.operators import batches, normalize, resolve, suggest
from gridloom.operators.normalize import header_key
from gridloom.plans import driver_inputs as inp
from gridloom.plans.registry import query
from gridloom.functions.text import file_stem, safe_file_name, source_kind
from gridloom.sources import files

_KEYS = ["key_email", "key_code", "key_name", "dedupe_key"]


def _flat(canonical: DataFrame, **fields: str) -> DataFrame:
    body = [F.col(f"data.{f}").alias(shown) for shown, f in fields.items()]
    return canonical.select(
        "record_id", *body, *_KEYS, F.array_join("validation_errors", "; ").alias("errors")
    )


def _shown(sql: str, *fields: str) -> str:
    return f"SELECT record_id, {', '.join(fields)}, {', '.join(_KEYS)}, errors FROM ({sql})"


@query("normalize_products", _shown(inp.products_sql(), "name", "sku AS sku", "category", "price", "currency"))
def normalize_products(spark, sf):
    return _flat(inp.canonical(spark, sf, inp.PRODUCTS), name="name", sku="sku",
                 category="category", price="price", currency="currency")


@query("normalize_travelers", _shown(inp.travelers_sql(), "full_name", "email", "phone"))
def normalize_travelers(spark, sf):
    return _flat(inp.canonical(spark, sf, inp.TRAVELERS), full_name="fullName", email="email", phone="phone")


@query("normalize_guides", _shown(inp.guides_sql(), "full_name", "email"))
def normalize_guides(spark, sf):
    return _flat(inp.canonical(spark, sf, inp.GUIDES), full_name="fullName", email="email")


@query("normalize_bookings", "SELECT record_id, reference, product_ref, traveler_ref, start_date,"
       f" key_date, key_code, key_name, dedupe_key FROM ({inp.bookings_sql()})")
def normalize_bookings(spark, sf):
    return inp.canonical(spark, sf, inp.BOOKINGS).select(
        "record_id", F.col("data.reference").alias("reference"),
        F.col("data.productRef").alias("product_ref"), F.col("data.travelerRef").alias("traveler_ref"),
        F.col("data.startDate").alias("start_date"), "key_date", "key_code", "key_name", "dedupe_key",
    )


@query("normalize_qualifications", _shown(inp.qualifications_sql(), "code", "name", "guide_ref"))
def normalize_qualifications(spark, sf):
    return _flat(inp.canonical(spark, sf, inp.QUALIFICATIONS), code="code", name="name", guide_ref="guideRef")


@query("normalize_staffing_rules", _shown(inp.rules_sql(), "name", "product_ref", "qualification_ref"))
def normalize_staffing_rules(spark, sf):
    return _flat(inp.canonical(spark, sf, inp.RULES), name="name", product_ref="productRef",
                 qualification_ref="qualificationRef")


_ALL_RAW = (inp.PRODUCTS, inp.TRAVELERS, inp.GUIDES, inp.BOOKINGS, inp.QUALIFICATIONS, inp.RULES)
_ALL_SQL = " UNION ALL ".join(
    f"SELECT batch_id, entity_type, record_id, errors FROM ({sql})" for sql in (
        inp.products_sql(), inp.travelers_sql(), inp.guides_sql(), inp.bookings_sql(),
        inp.qualifications_sql(), inp.rules_sql())
)


def _mixed(spark, sf) -> DataFrame:
    """Rows of all six entities in one frame, normalised together."""
    out = None
    for raw in _ALL_RAW:
        rows = inp.extracted(spark, sf, raw)
        out = rows if out is None else out.unionByName(rows)
    return normalize.normalize(out)


@query("normalized_counts", "SELECT batch_id, entity_type, count(*) AS normalized,"
       f" count(*) FILTER (errors <> '') AS validation_flags FROM ({_ALL_SQL}) GROUP BY ALL")
def normalized_counts(spark, sf):
    return normalize.normalized_counts(_mixed(spark, sf))


@query("records_per_type", f"SELECT batch_id, entity_type, count(*) AS records FROM ({_ALL_SQL}) GROUP BY ALL")
def records_per_type(spark, sf):
    return batches.records_per_type(_mixed(spark, sf))


@query("validation_items", "SELECT concat(record_id, ':VALIDATION_ERROR') AS review_item_id, record_id,"
       " entity_type, 2 AS priority, concat('This row has validation problems: ', errors, '.') AS explanation"
       f" FROM ({_ALL_SQL}) WHERE errors <> ''")
def validation_items(spark, sf):
    return normalize.validation_items(_mixed(spark, sf)).select(
        "review_item_id", "record_id", "entity_type", "priority", "explanation")


_MAPPED = """
  SELECT concat('M', c_nationkey, ':0:', c_custkey) AS record_id,
    CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment
         ELSE NULL END AS full_name,
    CASE WHEN c_custkey % 3 = 2 THEN lower(c_mktsegment) ELSE concat('c', c_custkey, '@x.org') END AS email
  FROM customer"""


@query("mapped_columns", _MAPPED)
def mapped_columns(spark, sf):
    """Explicit column maps: exact header, header by normal form, and no alias behind a map."""
    cells = F.expr("array(named_struct('header', 'Who', 'value', c_name),"
                   " named_struct('header', 'SEGMENT!', 'value', c_mktsegment),"
                   " named_struct('header', 'email', 'value', concat('c', c_custkey, '@x.org')))")
    maps = F.expr("CASE c_custkey % 3 WHEN 0 THEN map('fullName', 'Who')"
                  " WHEN 1 THEN map('fullName', 'Segment')"
                  " ELSE map('fullName', 'gone', 'email', 'segment') END")
    rows = inp.table(spark, sf, "customer").select(
        F.expr("concat('M', c_nationkey)").alias("batch_id"), F.lit(0).alias("sheet_index"),
        F.col("c_custkey").alias("source_row_index"), F.lit("TRAVELER").alias("entity_type"),
        cells.alias("cells"), maps.alias("columns"))
    return normalize.normalize(rows, ("TRAVELER",)).select(
        "record_id", F.col("data.fullName").alias("full_name"), F.col("data.email").alias("email")
    )


# -- files -----------------------------------------------------------------------------------


@query("file_names", """
  SELECT page_id, CASE WHEN base LIKE '%.%' THEN regexp_replace(base, '\\.[^.]+$', '') ELSE base END AS stem,
    coalesce(nullif(left(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), 120), ''), 'upload') AS safe_name,
    CASE WHEN lower(name) LIKE '%.csv' THEN 'CSV' WHEN lower(name) LIKE '%.xlsx' OR lower(name) LIKE '%.xlsm'
         THEN 'XLSX' END AS kind
  FROM (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS base,
        concat(url, CASE page_id % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.xlsm' WHEN 2 THEN '.xlsx' ELSE '' END) AS name
        FROM pages)""")
def file_names(spark, sf):
    """Stem, safe name and format of file names made of page addresses."""
    suffix = "CASE page_id % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.xlsm' WHEN 2 THEN '.xlsx' ELSE '' END"
    return inp.table(spark, sf, "pages").select(
        "page_id", file_stem(F.col("url")).alias("stem"), safe_file_name(F.col("url")).alias("safe_name"),
        source_kind(F.concat("url", F.expr(suffix))).alias("kind"),
    )


@query("artifact_manifest", """
  SELECT doc_id, sha256(text) AS content_hash, octet_length(encode(text)) AS byte_size, 'text/csv' AS mime_type,
    concat(source, '/', left(sha256(text), 12), '-doc_', doc_id, '_.csv') AS storage_key
  FROM documents""")
def artifact_manifest(spark, sf):
    """Whole document texts as uploaded bytes."""
    docs = inp.table(spark, sf, "documents").select("doc_id", "source", "text")
    name = F.concat(F.lit("doc "), F.col("doc_id"), F.lit(" (?).csv"))
    return files.artifact_manifest(docs, F.col("source"), name, F.col("text"), F.lit("text/csv")).select(
        "doc_id", "content_hash", "byte_size", "mime_type", "storage_key")


def _turn_rows(spark, sf) -> DataFrame:
    """Each conversation as a sheet, each turn as a row."""
    cells = F.array(*[F.struct(F.lit(h).alias("header"), F.col(c).alias("value"))
                      for h, c in (("Role", "role"), ("Text", "text"))])
    return inp.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("batch_id"), F.lit(0).alias("sheet_index"),
        F.lit("turns").alias("sheet_name"), F.col("turn").alias("source_row_index"), cells.alias("cells"))


@query("sheet_profile", """
  SELECT concat('c', conv_id) AS batch_id, 0 AS sheet_index, 'turns' AS sheet_name,
    count(*) AS row_count, 'Role|Text' AS headers FROM conversations GROUP BY conv_id""")
def sheet_profile(spark, sf):
    return files.sheet_profile(_turn_rows(spark, sf), "batch_id").withColumn(
        "headers", F.array_join("headers", "|"))


@query("sample_rows", "SELECT concat('c', conv_id) AS batch_id, turn AS source_row_index, role, text"
       " FROM conversations WHERE turn < 5")
def sample_rows(spark, sf):
    return files.sample_rows(_turn_rows(spark, sf)).select(
        "batch_id", "source_row_index", F.get("cells", F.lit(0))["value"].alias("role"),
        F.get("cells", F.lit(1))["value"].alias("text"))


# -- sheets and mappings ---------------------------------------------------------------------

_SHEETS = """
  SELECT concat('f', o_custkey) AS batch_id,
    concat('in/', CASE o_custkey % 3 WHEN 0 THEN 'products' WHEN 1 THEN 'misc' ELSE 'Travellers' END, '.csv')
      AS source_file,
    CAST(o_orderkey AS INTEGER) AS sheet_index,
    CASE o_orderkey % 9 WHEN 0 THEN 'Products' WHEN 1 THEN ' bookings ' WHEN 2 THEN 'Guides'
      WHEN 3 THEN 'staffing-rules' WHEN 4 THEN CAST(NULL AS STRING) WHEN 5 THEN 'Sheet1'
      WHEN 6 THEN 'TRAVELLERS' WHEN 7 THEN 'qualifications' ELSE 'Staffing_Rules' END AS sheet_name,
    o_orderkey % 5 AS row_count FROM orders"""
#: condition, position, entity type, sheet, field, header
_MAPPING_ROWS = (
    ("c_custkey % 4 = 0", 0, "GUIDE", "sheet1", "fullName", "Who"),
    ("c_custkey % 5 = 0", 1, "PRODUCT", None, "name", "What"),
    ("c_custkey % 7 = 0", 2, "BOOKING", "SHEET1", "reference", "No"),
    ("c_custkey % 3 = 0", 3, "TRAVELER", "elsewhere", "email", "Contact"),
    ("c_custkey % 11 = 0", 4, "HOTEL", None, "name", "Hotel"),
)


def _mapping_sql(columns: str) -> str:
    """Mapping entries per file in either dialect; `columns` renders (field, header)."""
    parts = []
    for where, position, entity, sheet, field, header in _MAPPING_ROWS:
        shown = f"'{sheet}'" if sheet else "CAST(NULL AS STRING)"
        parts.append(
            f"SELECT concat('f', c_custkey) AS batch_id, {position} AS position, '{entity}' AS entity_type,"
            f" {shown} AS sheet, {columns.format(field=field, header=header)} FROM customer WHERE {where}")
    return " UNION ALL ".join(parts)


_RESOLVED_SQL = f"""
  WITH sheets AS ({_SHEETS}), m AS (SELECT * FROM ({_mapping_sql("'{field}' AS field, '{header}' AS header")})
      WHERE entity_type <> 'HOTEL'),
  names(n, e) AS (VALUES ('product','PRODUCT'),('products','PRODUCT'),('booking','BOOKING'),('bookings','BOOKING'),
    ('traveler','TRAVELER'),('travelers','TRAVELER'),('traveller','TRAVELER'),('travellers','TRAVELER'),
    ('guide','GUIDE'),('guides','GUIDE'),('qualification','QUALIFICATION'),('qualifications','QUALIFICATION'),
    ('staffing rule','STAFFING_RULE'),('staffing rules','STAFFING_RULE'),('staffing_rule','STAFFING_RULE'),
    ('staffing_rules','STAFFING_RULE'),('staffingrules','STAFFING_RULE')),
  sized AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n_sheets,
    regexp_extract(source_file, '([^/]*)\\.csv$', 1) AS stem FROM sheets),
  shown AS (SELECT *, CASE WHEN sheet_name IS NULL AND n_sheets = 1 THEN stem ELSE sheet_name END AS name FROM sized),
  typed AS (SELECT s.*,
    (SELECT arg_min(entity_type, position) FROM m WHERE m.batch_id = s.batch_id AND lower(m.sheet) = lower(s.name)) AS t1,
    CASE WHEN n_sheets = 1 THEN (SELECT arg_min(entity_type, position) FROM m
      WHERE m.batch_id = s.batch_id AND m.sheet IS NULL) END AS t2,
    (SELECT e FROM names WHERE n = lower(trim(s.name))) AS t3 FROM shown s),
  resolved AS (SELECT *, coalesce(t1, t2, t3) AS entity_type FROM typed),
  final AS (SELECT r.*, coalesce(
      (SELECT arg_min(concat(field, '=', header), position) FROM m
        WHERE m.batch_id = r.batch_id AND lower(m.sheet) = lower(r.sheet_name)),
      (SELECT arg_min(concat(field, '=', header), position) FROM m
        WHERE m.batch_id = r.batch_id AND m.entity_type = r.entity_type), '') AS columns FROM resolved r)"""


def _resolved(spark, sf) -> DataFrame:
    orders, customers = inp.table(spark, sf, "orders"), inp.table(spark, sf, "customer")
    orders.createOrReplaceTempView("orders")
    customers.createOrReplaceTempView("customer")
    good, _ = resolve.valid_mappings(spark.sql(_mapping_sql("map('{field}', '{header}') AS columns")))
    return resolve.resolve_sheets(spark.sql(_SHEETS), good)


@query("resolve_sheets", _RESOLVED_SQL + " SELECT batch_id, sheet_index, entity_type, columns FROM final")
def resolve_sheets(spark, sf):
    pairs = F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _resolved(spark, sf).select(
        "batch_id", "sheet_index", "entity_type", F.array_join(pairs, ";").alias("columns"))


@query("unmapped_sheets", _RESOLVED_SQL + " SELECT batch_id, sheet_index,"
       " coalesce(sheet_name, concat('sheet#', sheet_index)) AS sheet FROM final WHERE entity_type IS NULL")
def unmapped_sheets(spark, sf):
    return resolve.unmapped_sheets(_resolved(spark, sf))


@query("extracted_counts", _RESOLVED_SQL + " SELECT batch_id, entity_type,"
       " CAST(sum(row_count) AS BIGINT) AS extracted FROM final WHERE entity_type IS NOT NULL GROUP BY ALL")
def extracted_counts(spark, sf):
    return resolve.extracted_counts(_resolved(spark, sf))


@query("extract_summary", _RESOLVED_SQL + """ SELECT batch_id,
    CAST(coalesce(sum(row_count) FILTER (entity_type IS NOT NULL), 0) AS BIGINT) AS total_rows,
    coalesce(string_agg(coalesce(sheet_name, concat('sheet#', sheet_index)), '|' ORDER BY sheet_index)
      FILTER (entity_type IS NULL), '') AS unmapped
  FROM final GROUP BY batch_id""")
def extract_summary(spark, sf):
    return resolve.batch_extract_summary(_resolved(spark, sf)).select(
        "batch_id", "total_rows", F.array_join("unmapped_sheets", "|").alias("unmapped"))


@query("rejected_mappings", "SELECT concat('f', c_custkey) AS batch_id, 4 AS position, 'HOTEL' AS entity_type,"
       " 'invalid entity type' AS reject_reason FROM customer WHERE c_custkey % 11 = 0")
def rejected_mappings(spark, sf):
    inp.table(spark, sf, "customer").createOrReplaceTempView("customer")
    _, bad = resolve.valid_mappings(spark.sql(_mapping_sql("map('{field}', '{header}') AS columns")))
    return bad.select("batch_id", "position", "entity_type", "reject_reason")


_HEADER_SETS = (
    ("Email", "Full Name", "Mobile", "e-MAIL"),
    ("SKU", "Title", "product name", "Price", "PRICE"),
    ("foo", "bar"),
    ("Name", "fullName", "Guide"),
)
_HINT = ("CASE c_custkey % 5 WHEN 0 THEN 'TRAVELER' WHEN 1 THEN 'GUIDE' WHEN 2 THEN 'PRODUCT'"
         " WHEN 3 THEN 'HOTEL' ELSE CAST(NULL AS STRING) END")
_TAB = ("CASE c_custkey % 3 WHEN 0 THEN 'Travelers' WHEN 1 THEN ' product '"
        " ELSE CAST(NULL AS STRING) END")


def _suggest_sql() -> str:
    header_rows = ", ".join(
        f"({s}, {i}, '{h}')" for s, hs in enumerate(_HEADER_SETS) for i, h in enumerate(hs))
    spellings = ", ".join(
        f"('{e}', '{f}', {fi}, {rank}, '{header_key(a)}')"
        for e, fields in FIELD_ALIASES.items() for fi, (f, aliases) in enumerate(fields.items())
        for rank, a in enumerate((f, *aliases)))
    return f"""
      WITH h(set_no, pos, header) AS (VALUES {header_rows}),
      a(entity_type, field, field_no, rank, spelling) AS (VALUES {spellings}),
      keyed AS (SELECT *, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) AS k FROM h),
      last AS (SELECT set_no, k, arg_max(header, pos) AS header FROM keyed GROUP BY set_no, k),
      sheets AS (SELECT c_custkey, c_custkey % 4 AS set_no, nullif({_HINT}, 'HOTEL') AS hint,
        CASE lower(trim({_TAB})) WHEN 'travelers' THEN 'TRAVELER' WHEN 'product' THEN 'PRODUCT' END AS by_name
        FROM customer),
      typed AS (SELECT *, coalesce(hint, by_name) AS t FROM sheets),
      hits AS (SELECT c_custkey, a.field_no, a.field, arg_min(last.header, a.rank) AS header, min(a.rank) AS rank
        FROM typed JOIN a ON a.entity_type = typed.t JOIN last ON last.set_no = typed.set_no AND last.k = a.spelling
        GROUP BY ALL),
      lists AS (SELECT c_custkey, string_agg(concat(field, '=', header, '@', CASE WHEN rank = 0 THEN '0.95' ELSE '0.8' END),
        ';' ORDER BY field_no) AS mapping FROM hits GROUP BY c_custkey)
      SELECT c_custkey, coalesce(t, 'PRODUCT') AS entity_type, coalesce(mapping, '') AS mapping,
        (mapping IS NULL OR hint IS NULL) AS needs_review FROM typed LEFT JOIN lists USING (c_custkey)"""


@query("suggest_mapping", _suggest_sql())
def suggest_mapping(spark, sf):
    sets = [F.array(*[F.lit(h) for h in hs]) for hs in _HEADER_SETS]
    headers = F.when(F.expr("c_custkey % 4 = 0"), sets[0])
    for i, one in enumerate(sets[1:], 1):
        headers = headers.when(F.expr(f"c_custkey % 4 = {i}"), one)
    sheets = inp.table(spark, sf, "customer").select(
        "c_custkey", F.expr(_TAB).alias("sheet_name"), headers.alias("headers"),
        F.expr(_HINT).alias("entity_hint"))
    entry = F.transform("mapping", lambda m: F.concat(
        m["field"], F.lit("="), m["header"], F.lit("@"), m["confidence"].cast("string")))
    return suggest.suggest_mapping(sheets).select(
        "c_custkey", "entity_type", F.array_join(entry, ";").alias("mapping"), "needs_review")


@query("scoped_hints", f"""SELECT o_orderkey, CASE WHEN n = 1 THEN 'GUIDE' END AS entity_hint FROM
  (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus, year(o_orderdate)) AS n FROM orders)""")
def scoped_hints(spark, sf):
    """An entity hint survives only in files with a single sheet."""
    file = F.concat_ws("-", "o_custkey", "o_orderstatus", F.year("o_orderdate"))
    sheets = inp.table(spark, sf, "orders").select(
        "o_orderkey", file.alias("source_file"), F.lit("GUIDE").alias("entity_hint"))
    return suggest.scope_hint(sheets).select("o_orderkey", "entity_hint")
