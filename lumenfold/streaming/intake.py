"""Streaming intake: files as they arrive, classified, each once, counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import expr


def read_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def classified(stream: DataFrame) -> DataFrame:
    """``stream`` with its extension and class; a projection, so it needs no state."""
    ext = expr.extension(F.col("source_path"))
    return stream.withColumns({"extension": ext, "classification": expr.classify(ext)})


def first_deliveries(stream: DataFrame, key: str = "media_id", time: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """Each key once within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str = "ingested_at", width: str = "1 day", late: str | None = "7 days") -> DataFrame:
    """(window_start, classification, n, bytes) of tumbling windows; rows later than the watermark are left out.

    ``late=None``: the stream has its watermark already, for instance from ``first_deliveries``.
    """
    marked = stream.withWatermark(time, late) if late else stream
    windowed = marked.groupBy(F.window(time, width).alias("w"), "classification").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    return windowed.select(F.col("w.start").alias("window_start"), "classification", "n", "bytes")


def device_sessions(stream: DataFrame, time: str = "modified_at", gap: str = "120 seconds", late: str = "1 day") -> DataFrame:
    """(device_id, session_start, session_end, files): files of one device no farther apart than the gap."""
    grouped = stream.withWatermark(time, late).groupBy("device_id", F.session_window(time, gap).alias("s")).agg(F.count("*").alias("files"))
    return grouped.select("device_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "files")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything a stream has now, through a memory table; for small results."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
