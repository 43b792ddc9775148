"""Listings of a root folder: its top-level files, its day folders and the accepted photos below a day."""

from __future__ import annotations

import os
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import expr
from lumenfold.settings import DAY_FOLDER, Settings

MEDIA = "source_path STRING, extension STRING, size_bytes BIGINT, classification STRING, modified_at TIMESTAMP"


def scan_root(spark: SparkSession, settings: Settings) -> DataFrame:
    """Top-level files of the root by lower-case name; folders are never entered.

    Only names, sizes and times are listed, on the driver, since the binary file source hides
    names that begin with a dot or an underscore.
    """
    root = Path(settings.root)
    if not root.is_dir():
        raise NotADirectoryError(f"no such folder: {root}")
    with os.scandir(root) as entries:
        files = [(e.path, e.stat().st_size, datetime.fromtimestamp(e.stat().st_mtime, timezone.utc)) for e in entries if e.is_file()]
    rows = spark.createDataFrame(files, "source_path STRING, size_bytes BIGINT, modified_at TIMESTAMP")
    ext = expr.extension(F.col("source_path"))
    listed = rows.select("source_path", ext.alias("extension"), "size_bytes", expr.classify(ext, settings).alias("classification"), "modified_at")
    return listed.orderBy(F.lower(expr.file_name(F.col("source_path"))), "source_path")


def listed_media(spark: SparkSession, folder: str, settings: Settings = Settings()) -> DataFrame:
    """The same from a distributed listing, for folders too large for one process; hidden names are not seen."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    ext = expr.extension(F.col("path"))
    return files.select(F.col("path").alias("source_path"), ext.alias("extension"), F.col("length").alias("size_bytes"), expr.classify(ext, settings).alias("classification"), F.col("modificationTime").alias("modified_at"))


def day_folders(settings: Settings) -> list[Path]:
    """Folders of the root named ``day`` and two digits, by name."""
    return sorted((p for p in Path(settings.root).iterdir() if p.is_dir() and DAY_FOLDER.fullmatch(p.name)), key=lambda p: p.name)


def accepted_files(spark: SparkSession, settings: Settings) -> DataFrame:
    """(day_name, source_path, relative_path, modified_at) of photos below day folders, without those in reserved folders."""
    kept = []
    reserved = set(vars(settings.folders).values())
    for day in day_folders(settings):
        for path in day.rglob("*"):
            inner = path.relative_to(day).parts
            if path.is_file() and not reserved & set(inner[:-1]) and path.suffix.lower().lstrip(".") in settings.photo_extensions:
                kept.append((day.name, str(path), str(path.relative_to(settings.root)), datetime.fromtimestamp(path.stat().st_mtime, timezone.utc)))
    rows = spark.createDataFrame(kept, "day_name STRING, source_path STRING, relative_path STRING, modified_at TIMESTAMP")
    return rows.orderBy("day_name", F.lower("relative_path"), "relative_path")
