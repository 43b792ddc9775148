"""The counters of a run as one row, and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The counters of a report in their order.
COUNTERS = (
    "total_items", "photo_items", "non_photo_items", "unsupported_items", "converted_heif_files", "deleted_original_heif_files", "accepted_photos", "rejected_photos", "day_count", "moved_files", "created_directories",
    "clustered_days", "burst_group_count", "final_cluster_count", "manifests_written", "duplicate_photos_rejected", "renamed_photos", "cleanup_manifests_rewritten", "categorized_days", "classified_clusters", "categorized_photos_moved", "categorization_manifests_rewritten",
)


def file_counts(files: DataFrame) -> DataFrame:
    """One row with the files of each class; unsupported ones are no non-photos."""
    is_a = lambda c: F.count_if(F.col("classification") == c).alias(f"{c}_items")
    return files.agg(F.count("*").alias("total_items"), is_a("photo"), is_a("non_photo"), is_a("unsupported"))


def quality_counts(assessed: DataFrame) -> DataFrame:
    """One row with the accepted and rejected photos."""
    return assessed.agg(F.count_if("is_accepted").alias("accepted_photos"), F.count_if(~F.col("is_accepted")).alias("rejected_photos"))


def manifest_counts(manifests: DataFrame) -> DataFrame:
    """One row with the sums of the manifests' summaries."""
    total = lambda f: F.coalesce(F.sum(f"summary.{f}"), F.lit(0))
    return manifests.agg(F.count("*").alias("clustered_days"), total("burst_group_count").alias("burst_group_count"), total("cluster_count").alias("final_cluster_count"), F.count("*").alias("manifests_written"))


def summary(parts: list[DataFrame]) -> DataFrame:
    """One row with all counters from one-row parts; a counter no part has is 0, of one in several the greatest counts."""
    long = None
    for part in parts:
        known = [c for c in part.columns if c in COUNTERS]
        own = part.select(*[F.col(c).cast("long").alias(c) for c in known]).unpivot([], known, "counter", "value")
        long = own if long is None else long.unionByName(own)
    return long.agg(*[F.coalesce(F.max(F.when(F.col("counter") == c, F.col("value"))), F.lit(0)).alias(c) for c in COUNTERS])


def as_rows(report: DataFrame) -> DataFrame:
    """(position, counter, value) of a one-row report."""
    long = report.unpivot([], list(COUNTERS), "counter", "value")
    return long.withColumn("position", F.array_position(F.array(*map(F.lit, COUNTERS)), F.col("counter")).cast("int")).select("position", "counter", "value")


def as_text(report: DataFrame, title: str = "Run summary") -> str:
    """A report as indented lines."""
    row = report.first()
    return "\n".join([title, *[f"  {c}: {row[c]}" for c in COUNTERS]])
