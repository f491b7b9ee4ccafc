"""Cutting lineage with tables written to reliable shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    A folder of our own is made only for a local session that names none.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Compute a frame that several branches read once, as a table in the shared folder.

    Unlike a cache it outlives lost executors; unlike checkpoint() it runs the plan only once
    and reads back by column.
    """
    path = f"{shared_dir(df.sparkSession)}/gridloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
