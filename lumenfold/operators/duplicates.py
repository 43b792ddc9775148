"""Duplicates within a burst of a cluster, their winners and losers, and the names of the survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import expr
from lumenfold.operators.bursts import best_first
from lumenfold.operators.components import connected_components

SCOPE = ["trip_id", "day_name", "cluster_id", "burst_id"]


def duplicate_pairs(members: DataFrame, pixels: str = "pixels", least: float = 0.99, by: list[str] = SCOPE, key: str = "photo_id") -> DataFrame:
    """(by..., x, y, similarity), x < y: members of one scope whose pixels are at least so similar.

    The compare image is an array made once for each photo; the scope is an equi-join key.
    """
    left = members.select(*by, F.col(key).alias("x"), F.col(pixels).alias("__a"))
    right = members.select(*by, F.col(key).alias("y"), F.col(pixels).alias("__b"))
    pairs = left.join(right, by).where("x < y").withColumn("similarity", expr.pixel_similarity(F.col("__a"), F.col("__b")))
    return pairs.where(F.col("similarity") >= least).select(*by, "x", "y", "similarity")


def duplicate_sets(members: DataFrame, pairs: DataFrame, by: list[str] = SCOPE, key: str = "photo_id") -> DataFrame:
    """``members`` that are in a set of two or more, with set_id, the smallest key of the set."""
    found = connected_components(pairs, by).select(F.col("node").alias(key), F.col("label").alias("set_id"))
    return members.join(found, key)


def ranked_sets(sets: DataFrame, by: list[str], order: list[Column] | None = None) -> DataFrame:
    """``sets`` with place: the winner of each set has 1, the losers more; sharpest, then earliest, then by path."""
    keys = order if order is not None else [best_first()]
    return sets.withColumn("place", F.row_number().over(Window.partitionBy(*by, "set_id").orderBy(*keys)))


def winners(sets: DataFrame, by: list[str], order: list[Column] | None = None) -> DataFrame:
    """The best of each set."""
    return ranked_sets(sets, by, order).where("place = 1").drop("place")


def losers(sets: DataFrame, by: list[str], order: list[Column] | None = None) -> DataFrame:
    """All others of each set."""
    return ranked_sets(sets, by, order).where("place > 1").drop("place")


def survivors(members: DataFrame, lost: DataFrame, key: str = "photo_id") -> DataFrame:
    """``members`` without the losers."""
    return members.join(lost.select(key), key, "left_anti")


def survivor_names(members: DataFrame, by: list[str] = SCOPE) -> DataFrame:
    """``members`` with number and new_name: numbered in each burst by time and path, named c_b_n with their own suffix."""
    order = Window.partitionBy(*by).orderBy(F.col("captured_at").isNull(), "captured_at", "relative_path")
    numbered = members.withColumn("number", F.row_number().over(order))
    return numbered.withColumn("new_name", expr.survivor_name(F.col("cluster_id"), F.col("burst_id"), F.col("number"), F.col("relative_path")))


def fallback_representatives(alive: DataFrame, originals: DataFrame, by: list[str], key: str = "photo_id") -> DataFrame:
    """(by..., representative): the original if it is alive, else least distance, then sharpness, time and path.

    ``originals`` holds (by..., original); a missing distance counts as infinite.
    """
    distance = F.coalesce(F.col("cosine_distance_to_representative"), F.lit(float("inf"))) if "cosine_distance_to_representative" in alive.columns else F.lit(float("inf"))
    joined = alive.join(originals, by, "left")
    rank = F.struct(F.coalesce(F.col(key) != F.col("original"), F.lit(True)), distance, best_first())
    return joined.groupBy(*by).agg(F.min_by(key, rank).alias("representative"))
