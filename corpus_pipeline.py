"""The corpus pipeline: documents to packed training sequences in five stages.

toxicity: documents the classifier chain rejects go. line_dedup: of alike lines over all documents
one stays; a document none of whose compared lines stays goes, as all it says stands elsewhere.
near_duplicates: of each group of documents linked by five-word shingles at a likeness of 0.8 or
more, the one with the smallest id stays. secrets: found secrets are masked. packing: every
remaining document becomes pieces placed in sequences of at most 4096 tokens.

Every stage but the last returns the columns of its input, whatever further columns there are, with
n_chars counted anew. A null text stays as it is and is packed as an empty one; null ids are kept;
repeated rows count as near duplicates of each other. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lineage import materialize
from gridloom.llm import fuzzy_lines, packing, parity_join, secrets, toxicity


def _counted(docs: DataFrame) -> DataFrame:
    """With n_chars of the text as it is now, if there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, labels, ["low_quality", "toxic"])
    return toxicity.score(docs, chain, into="_gl_toxicity").where("NOT _gl_toxicity.toxic").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = fuzzy_lines.dedup_lines(docs, into="_gl_removed")
    emptied = (F.size("_gl_removed") > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    return _counted(kept.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.first_of_groups(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs, materialize(secrets.scan(docs))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets), ("packing", pack),
]

#: Classifiers, SimHash groups and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
