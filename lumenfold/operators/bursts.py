"""Burst groups: photos of one day that are close in time and look alike, also through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import expr
from lumenfold.operators.components import connected_components
from lumenfold.settings import BurstLimits

DAY = ["trip_id", "day_name"]


def distinct_photos(accepted: DataFrame, key: str = "photo_id") -> DataFrame:
    """One row for each photo: the rows of a photo are copies; of differing ones the greatest counts."""
    rest = [c for c in accepted.columns if c != key]
    return accepted.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("__r")).select(key, "__r.*")


def burst_edges(photos: DataFrame, limits: BurstLimits = BurstLimits(), by: list[str] = DAY) -> DataFrame:
    """(by..., x, y), x < y: photos of one day at most the gap apart whose hash or histogram is close.

    A band join without a native operator: time falls into buckets of the gap's width, each
    photo looks into its own and the next one, so the planner sees equal keys and skewed
    buckets can be split at run time. The cheap time test comes first. Photos without a
    time, or with neither hash nor histogram, have no links.
    """
    gap = limits.gap_seconds * 1_000_000
    at = F.unix_micros(F.col("captured_at").cast("timestamp"))
    rows = photos.where("captured_at is not null").select(*by, "photo_id", at.alias("at"), "perceptual_hash", "color_histogram").withColumn("bucket", F.floor(F.col("at") / gap))
    left = rows.select(*by, F.col("photo_id").alias("p"), F.col("at").alias("at_l"), F.col("perceptual_hash").alias("h_l"), F.col("color_histogram").alias("c_l"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(*by, F.col("photo_id").alias("q"), F.col("at").alias("at_r"), F.col("perceptual_hash").alias("h_r"), F.col("color_histogram").alias("c_r"), "bucket")
    later = (F.col("at_l") < F.col("at_r")) | ((F.col("at_l") == F.col("at_r")) & (F.col("p") < F.col("q")))
    alike = F.coalesce(expr.hamming(F.col("h_l"), F.col("h_r")) <= limits.hash_bits, F.lit(False)) | F.coalesce(expr.cosine(F.col("c_l"), F.col("c_r")) >= limits.histogram, F.lit(False))
    pairs = left.join(right, [*by, "bucket"]).where(later & (F.col("at_r") - F.col("at_l") <= gap) & alike)
    return pairs.select(*by, F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))


def linking_edges(photos: DataFrame, limits: BurstLimits = BurstLimits(), by: list[str] = DAY) -> DataFrame:
    """(by..., x, y) that connect what ``burst_edges`` connects, without all pairs of copies.

    Photos of one day with the same time, hash and histogram are linked with each other, so
    one of them stands for all in the band join and the others hang on it. Copies that
    nothing links (no hash, and no histogram or one of zeros) stay as they are.
    """
    same = ["captured_at", "perceptual_hash", "color_histogram"]
    linked = F.col("perceptual_hash").isNotNull() | F.coalesce(expr.norm(F.col("color_histogram")) > 0, F.lit(False))
    rows = photos.where("captured_at is not null").select(*by, "photo_id", *same)
    heads = rows.where(linked).groupBy(*by, *same).agg(F.min("photo_id").alias("photo_id"), F.count("*").alias("__n"))
    keys = [*by, *same]
    several = heads.where("__n > 1").select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("photo_id").alias("head"))
    standing = heads.drop("__n").unionByName(rows.where(~linked))
    hanging = rows.join(several, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]).where("photo_id != head").select(*by, F.col("head").alias("x"), F.col("photo_id").alias("y"))
    return burst_edges(standing, limits, by).unionByName(hanging)


def burst_groups(photos: DataFrame, limits: BurstLimits = BurstLimits(), by: list[str] = DAY) -> DataFrame:
    """``photos`` with burst_id, from one for each day in the order of (captured_at, relative_path) of its first member.

    A photo without links is a burst of its own; photos without a time come last.
    """
    linked = connected_components(linking_edges(photos, limits, by), by).select(F.col("node").alias("photo_id"), "label")
    marked = photos.join(linked, "photo_id", "left").withColumn("__group", F.coalesce("label", "photo_id")).drop("label")
    first = F.struct(F.col("captured_at").isNull(), F.col("captured_at"), F.col("relative_path"), F.col("photo_id"))
    heads = marked.groupBy(*by, "__group").agg(F.min(first).alias("__first"))
    numbered = heads.withColumn("burst_id", F.row_number().over(Window.partitionBy(*by).orderBy("__first"))).drop("__first")
    null_safe = [F.col(f"m.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]
    joined = marked.alias("m").join(numbered.select(F.col("__group").alias("__g"), *by, "burst_id").alias("n"), [F.col("m.__group") == F.col("n.__g"), *null_safe])
    return joined.select("m.*", "n.burst_id").drop("__group")


def best_first():
    """Sort key of the sharpest, earliest member; ends in the path, so it is total."""
    return F.struct(-F.coalesce("blur_score", F.lit(0.0)), F.col("captured_at").isNull(), F.col("captured_at"), F.col("relative_path"))


def burst_representatives(grouped: DataFrame, by: list[str] = DAY) -> DataFrame:
    """(by..., burst_id, representative_id, representative_path, member_count): sharpest, then earliest, then by path; a null sharpness counts as 0."""
    best = F.min(F.struct(best_first().alias("k"), F.col("photo_id"), F.col("relative_path"))).alias("b")
    return grouped.groupBy(*by, "burst_id").agg(best, F.count("*").alias("member_count")).select(*by, "burst_id", F.col("b.photo_id").alias("representative_id"), F.col("b.relative_path").alias("representative_path"), "member_count")
