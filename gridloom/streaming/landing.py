"""Files that arrive in a landing folder run through the pipeline as they come."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.text import source_kind
from gridloom.lineage import materialize
from gridloom.plans import pipeline
from gridloom.sources import csv_files, files, workbook
from gridloom.sources.store import Store

_FILE = "path string, modificationTime timestamp, length long, content binary"
_FAILURE = "batch_id string, source_file string, stage string, message string"
#: characters of an error kept with a failed batch
_MESSAGE = 500


def watch(
    spark: SparkSession, landing: str, store: Store, checkpoint: str,
    mappings: DataFrame | None = None, multi_line: bool = True, files_per_trigger: int = 10_000,
    glob: str | None = None,
) -> StreamingQuery:
    """Take in all new files of the folder and stop.

    The stream lists files, at most `files_per_trigger` at a time; contents are read by what a file's name
    says it is. A file of no known kind goes to the table of rejects. A file that cannot be read becomes a
    FAILED batch with the reason, and the others land: files whose quotes don't pair up are found before
    reading, any other reason by reading halves of the list again until the file stands alone.

    A file is one batch and matching stays within a batch, so no state is carried over. Every step is a
    change of the store that replaces its own batches: a micro-batch that runs again after a crash writes
    the same, and one that ended is not repeated.
    """
    def run(listed: DataFrame, _: int) -> None:
        kinds = listed.select("path", source_kind(F.col("path")).alias("kind")).collect()
        unknown = listed.filter(source_kind(F.col("path")).isNull())
        if any(r.kind is None for r in kinds):
            pipeline.reject(store, files.unsupported(unknown.select(
                csv_files.batch_of_file(F.col("path")).alias("batch_id"), "path", F.lit(None).alias("kind"))))
        texts = [r.path for r in kinds if r.kind == "CSV"]
        open_ended = unpaired(spark, texts)
        failures = [(path, "quote not closed") for path in texts if path in open_ended]
        failures += _each([p for p in texts if p not in open_ended], lambda paths: pipeline.ingest(
            csv_files.scan_csv(spark, paths, multi_line), store, mappings))
        failures += _each([r.path for r in kinds if r.kind == "XLSX"], lambda paths: _workbooks(spark, paths, store, mappings))
        if failures:
            rows = spark.createDataFrame([(None, p, "extract", m) for p, m in failures], _FAILURE)
            pipeline.fail(spark, store, rows.withColumn("batch_id", csv_files.batch_of_file(F.col("source_file"))))

    source = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_trigger)
    if glob is not None:
        source = source.option("pathGlobFilter", glob)
    return (
        source.load(landing).select("path").writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def watch_csv(
    spark: SparkSession, landing: str, store: Store, checkpoint: str,
    mappings: DataFrame | None = None, multi_line: bool = True, files_per_trigger: int = 10_000,
) -> StreamingQuery:
    """As `watch`, leaving alone whatever is no CSV file by its name."""
    return watch(spark, landing, store, checkpoint, mappings, multi_line, files_per_trigger, "*.[cC][sS][vV]")


def unpaired(spark: SparkSession, paths: list[str]) -> set[str]:
    """CSV files with an odd number of quotes: some cell's quote is never closed."""
    if not paths:
        return set()
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.length(F.regexp_replace("value", '[^"]', "")).alias("n"))
    odd = lines.groupBy("path").agg(F.sum("n").alias("n")).filter("n % 2 = 1")
    return {r.path for r in odd.select("path").collect()}


def _workbooks(spark: SparkSession, paths: list[str], store: Store, mappings: DataFrame | None) -> None:
    scan = materialize(workbook.read_workbooks(spark, paths))
    pipeline.ingest(workbook.data_rows(scan), store, mappings, workbook.sheet_list(scan))


def _each(paths: list[str], take: Callable[[list[str]], object]) -> list[tuple[str, str]]:
    """Take all files at once; where that fails, halves of them. Returns the files that fail alone, and why."""
    if not paths:
        return []
    try:
        take(paths)
    except (PySparkException, Py4JJavaError) as error:
        if len(paths) == 1:
            return [(paths[0], _reason(error))]
        half = len(paths) // 2
        return _each(paths[:half], take) + _each(paths[half:], take)
    return []


def _reason(error: Exception) -> str:
    """The line of an error that says what went wrong."""
    said = [line.strip() for line in str(error).splitlines() if line.strip() and not line.lstrip().startswith(("at ", "File "))]
    named = [line for line in said if "Error" in line or "Exception" in line]
    return (named or said or [type(error).__name__])[-1][:_MESSAGE]
