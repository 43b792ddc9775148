"""Trip days: distinct dates numbered from one, and every file's day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import expr


def day_map(*dated: DataFrame, date: str = "captured_on", by: list[str] | None = None, prefix: str = "day") -> DataFrame:
    """(by..., date, day_index, day_name): dates of all inputs, each once, in their order.

    Dates that occur only on artifacts take a number too. Rows without a date are left out.
    Only the distinct dates are ranked, not the files.
    """
    by = by or []
    dates = None
    for df in dated:
        own = df.where(F.col(date).isNotNull()).select(*by, date).distinct()
        dates = own if dates is None else dates.unionByName(own)
    order = Window.partitionBy(*by if by else [F.lit(0)]).orderBy(date)  # as many rows as there are days
    ranked = dates.distinct().withColumn("day_index", F.row_number().over(order))
    return ranked.withColumn("day_name", expr.day_name(F.col("day_index"), prefix))


def assign_days(files: DataFrame, days: DataFrame, date: str = "captured_on", by: list[str] | None = None) -> DataFrame:
    """``files`` with day_index and day_name; files without a date have no day and are left out."""
    return files.join(days.select(*(by or []), date, "day_index", "day_name"), [*(by or []), date])


def resolve_capture(photos: DataFrame, files: DataFrame, photo_id: str = "photo_id", file_id: str = "media_id") -> DataFrame:
    """``photos`` with resolved_at, resolved_on and resolved_source: the EXIF time, else the time of the file.

    Only the EXIF spelling counts here; the mixed spellings are ``operators.timestamps``.
    """
    times = files.groupBy(file_id).agg(F.max("modified_at").alias("__modified"))
    joined = photos.join(times, photos[photo_id] == times[file_id], "left").drop(file_id)
    at, source = expr.first_time((expr.exif_datetime(F.col("captured_at")), "exif"), (F.col("__modified").cast("timestamp_ntz"), "mtime"))
    return joined.withColumns({"resolved_at": at, "resolved_source": source}).withColumn("resolved_on", F.to_date("resolved_at")).drop("__modified")
