import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.support import awkward

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "secrets", "packing"]
    odd = docs.unionByName(awkward(spark).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars")))
    odd = odd.withColumn("id", F.lit(1)).withColumn("component", F.lit("x"))
    before = odd.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        odd = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < odd.count() <= before
        before = odd.count()
    packed = corpus_pipeline.pack(spark, odd, SF)
    assert packed.where("piece = 0").count() == before
    assert odd.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).isEmpty()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
