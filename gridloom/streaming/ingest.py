"""Resumable ingestion of downloaded chunks as a stream that drains and stops.

The file source's checkpoint remembers which files it has seen, so a second run adds only new
ones.  ``availableNow`` handles what is there in bounded micro-batches, then ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.parse import CHUNK_FILE, chunk_key, chunk_of_file
from gridloom.functions.predicates import tiff_intact
from gridloom.operators.chunks import updated

_FILES = "path string, modificationTime timestamp, length long, content binary"


def chunk_entries(files: DataFrame) -> DataFrame:
    """Ledger entries ``key, status, file`` of chunk files: damaged ones count as failed."""
    at = chunk_of_file(F.col("path"))
    status = F.when(tiff_intact(F.col("content"), F.col("length")), "downloaded").otherwise("failed")
    return files.where(F.col("path").rlike(CHUNK_FILE)).select(chunk_key(at["row"], at["col"]).alias("key"), status.alias("status"), F.col("path").alias("file"))


def ingest_chunks(spark: SparkSession, folder: str, ledger: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Append entries of new chunk files to the ledger table (Parquet)."""
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.tif").load(folder)
    return chunk_entries(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(ledger)


def ingest_rows(spark: SparkSession, schema: str, folder: str, ledger: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """The same for status rows in Parquet files (``key, status, file``), such as fetch tasks write."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.select("key", "status", "file").writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(ledger)


def current_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The latest state of each chunk in an appended ledger."""
    rows = spark.read.schema("key string, status string, file string").parquet(ledger)
    empty = spark.createDataFrame([], rows.schema)
    return updated(empty, rows)
