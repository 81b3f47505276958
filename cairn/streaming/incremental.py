"""Structured Streaming: files that appear are extracted as they come; events are counted with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.extract import python_source
from cairn.extract.run import extract


def new_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """A stream of (path, text, hash) of files that appear below root."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("hash"))


def stream_definitions(files: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Appends the definitions of all files that are there or came since the last run, then ends."""
    rows = extract(files, python_source.definitions, python_source.DEFINITIONS)
    return rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Counts per window and key; state of windows that ended before the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
