"""Streaming ingest: files that arrive become rows of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.sources.scan import ScanOptions, scan

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """A stream of arriving files as rows (doc_id, content)."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.load(path).select(F.col("path").alias("doc_id"), "content")


def stream_rows(spark: SparkSession, path: str, schema: str = "doc_id string, content binary") -> DataFrame:
    """A stream of Parquet tables of files."""
    return spark.readStream.schema(schema).parquet(path)


def ingest(files: DataFrame, table: str, target: str, checkpoint: str, options: ScanOptions | None = None) -> None:
    """Scan all files that are there into a Parquet table; later calls add what is new since."""
    rows = scan(files, table, options)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
