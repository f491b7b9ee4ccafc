"""Driver queries over duplicate matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import model
from gridloom.fixed_values import FUZZY_THRESHOLD
from gridloom.functions.similarity import similarity
from gridloom.lineage import materialize
from gridloom.operators import exact_match, findings, fuzzy_match
from gridloom.plans import driver_inputs as inp
from gridloom.plans.registry import query

_FINDING = ["record_id", "entity_type", "strategy", "score", "reason", "peer_record_id", "explanation"]


def found(spark, sf, raw: inp.Raw) -> DataFrame:
    return findings.find_duplicates(materialize(inp.canonical(spark, sf, raw)), one_key=True)


def _check(records: str) -> str:
    return f"SELECT {', '.join(_FINDING)} FROM ({inp.findings_sql(records)})"


@query("duplicates_guides", _check(inp.guides_sql()))
def duplicates_guides(spark, sf):
    """E-mail first, then names."""
    return found(spark, sf, inp.GUIDES).select(*_FINDING)


@query("duplicates_bookings", _check(inp.bookings_sql()))
def duplicates_bookings(spark, sf):
    """Codes first; bookings of one product share its name key."""
    return found(spark, sf, inp.BOOKINGS).select(*_FINDING)


@query("duplicates_products", _check(inp.products_sql()))
def duplicates_products(spark, sf):
    return found(spark, sf, inp.PRODUCTS).select(*_FINDING)


@query("duplicates_qualifications", _check(inp.qualifications_sql()))
def duplicates_qualifications(spark, sf):
    return found(spark, sf, inp.QUALIFICATIONS).select(*_FINDING)


@query("exact_travelers", f"""
  SELECT record_id, concat(batch_id, ':0:', first) AS peer_record_id FROM
    (SELECT *, min(ord) OVER (PARTITION BY batch_id, key_email) AS first FROM ({inp.travelers_sql()})
     WHERE key_email IS NOT NULL) WHERE first < ord""")
def exact_travelers(spark, sf):
    rows = exact_match.annotate(inp.canonical(spark, sf, inp.TRAVELERS), one_key=True)
    return rows.filter("exact_kind is not null").select(
        "record_id", model.record_id(F.col("batch_id"), F.col("exact_peer_ord")).alias("peer_record_id"))


@query("exact_documents", """
  SELECT doc_id, first AS peer_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, lower(trim(text,
    chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '))) AS first FROM documents) WHERE first < doc_id""")
def exact_documents(spark, sf):
    """Whole texts as codes: every copy points at the first of its language."""
    from gridloom.functions.text import match_key

    rows = inp.table(spark, sf, "documents").select(
        F.col("lang").alias("batch_id"), F.col("doc_id").alias("row_ord"),
        F.lit("BOOKING").alias("entity_type"), F.lit(None).cast("string").alias("key_email"),
        match_key(F.col("text")).alias("key_code"))
    return exact_match.annotate(rows, one_key=True).filter("exact_kind is not null").select(
        F.col("row_ord").alias("doc_id"), F.col("exact_peer_ord").alias("peer_doc_id"))


def _names(rows: DataFrame) -> DataFrame:
    """earliest_similar over (batch_id, row_ord, key_name) rows of one entity type."""
    names = materialize(fuzzy_match.distinct_names(rows.withColumn("entity_type", F.lit("PRODUCT"))))
    return fuzzy_match.earliest_similar(names).filter("best_ord < first_ord").select(
        "batch_id", "name", "first_ord", "best_ord", "best_name")


def _names_check(rows: str) -> str:
    return f"""
      WITH n AS (SELECT batch_id, key_name AS name, min(row_ord) AS first_ord FROM ({rows}) GROUP BY ALL),
      p AS (SELECT a.batch_id, a.name, a.first_ord, min(b.first_ord) AS best_ord FROM n a JOIN n b
        ON a.batch_id = b.batch_id AND b.first_ord < a.first_ord
        AND 1.0::DOUBLE - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))
            >= {FUZZY_THRESHOLD}::DOUBLE GROUP BY ALL)
      SELECT p.*, n.name AS best_name FROM p JOIN n ON n.batch_id = p.batch_id AND n.first_ord = p.best_ord"""


_URLS = "SELECT 'all' AS batch_id, page_id AS row_ord, lower(url) AS key_name FROM pages"


@query("similar_addresses", _names_check(_URLS))
def similar_addresses(spark, sf):
    """All page addresses against each other, found by segments."""
    inp.table(spark, sf, "pages").createOrReplaceTempView("pages")
    return _names(spark.sql(_URLS))


_CUSTOMERS = "SELECT 'all' AS batch_id, c_custkey AS row_ord, lower(c_name) AS key_name FROM customer"


@query("similar_customers", _names_check(_CUSTOMERS))
def similar_customers(spark, sf):
    """Names that differ in a few digits only: the crowded case."""
    inp.table(spark, sf, "customer").createOrReplaceTempView("customer")
    return _names(spark.sql(_CUSTOMERS))


# The check's edit distance counts bytes, so every letter beyond ASCII is spelled by one capital of its own.
_SPELLED = "translate(lower(text), 'äöüßéèêçñóíáúàâîôûëïùœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"
_PASSAGES = (f"SELECT 'all' AS batch_id, item_id * 2 AS row_ord, {_SPELLED} AS key_name FROM benchmark"
             f" UNION ALL SELECT 'all', item_id * 2 + 1, concat(substr({_SPELLED}, 1, 20), 'zz',"
             f" substr({_SPELLED}, 25)) FROM benchmark")


@query("similar_passages", _names_check(_PASSAGES))
def similar_passages(spark, sf):
    """Whole passages next to edited copies: long texts, found by rare grams."""
    inp.table(spark, sf, "benchmark").createOrReplaceTempView("benchmark")
    return _names(spark.sql(_PASSAGES))


@query("similarity", """
  SELECT p_partkey, CASE WHEN p_name = a THEN 1.0::DOUBLE
    ELSE 1.0::DOUBLE - levenshtein(p_name, a) / greatest(length(p_name), length(a)) END AS score
  FROM (SELECT *, lower(concat(p_type, ' ', p_brand)) AS a FROM part)""")
def name_similarity(spark, sf):
    other = F.lower(F.concat_ws(" ", "p_type", "p_brand"))
    return inp.table(spark, sf, "part").select("p_partkey", similarity(F.col("p_name"), other).alias("score"))


@query("match_counts", f"""
  SELECT batch_id, count(*) AS match_candidates, count(*) FILTER (reason = 'DUPLICATE') AS duplicates,
    count(*) FILTER (reason = 'LOW_CONFIDENCE') AS low_confidence
  FROM ({inp.findings_sql(inp.guides_sql())}) GROUP BY batch_id""")
def match_counts(spark, sf):
    return findings.match_counts(found(spark, sf, inp.GUIDES))


@query("match_candidates", "SELECT candidate_id, record_id, target_kind, target_record_id, score, strategy, status"
       f" FROM ({inp.candidates_sql(inp.guides_sql())})")
def match_candidates(spark, sf):
    return findings.match_candidates(found(spark, sf, inp.GUIDES)).select(
        "candidate_id", "record_id", "target_kind", "target_record_id", "score", "strategy", "status")


@query("match_review_items", "SELECT review_item_id, record_id, reason, status, priority, explanation FROM"
       f" ({inp.items_sql(inp.guides_sql())}) WHERE reason <> 'VALIDATION_ERROR'")
def match_review_items(spark, sf):
    return findings.review_items(found(spark, sf, inp.GUIDES)).select(
        "review_item_id", "record_id", "reason", "status", "priority", "explanation")
