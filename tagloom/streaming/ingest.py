"""Incremental ingestion of a growing folder of audio files: an extension of the batch scan by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.sources import audio

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files below a path, at most per_trigger at a time, each once."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, glob: str = "*", per_trigger: int = 1000) -> StreamingQuery:
    """Parses new files and appends them to Parquet at target, exactly once, until all that is there is read."""
    parsed = audio.parse_audio(stream_files(spark, source, glob, per_trigger))
    return parsed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def arrivals(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and bytes of files by the window of their time; files later than the watermark allows don't count."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
