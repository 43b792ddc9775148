"""The quality gate: metrics become reasons, reasons become a decision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import expr
from lumenfold.settings import QualityLimits


def assess(photos: DataFrame, limits: QualityLimits = QualityLimits(), corrupt: Column | None = None) -> DataFrame:
    """``photos`` (blur_score, brightness_mean, overexposed_ratio) with rejection_reasons and is_accepted."""
    reasons = expr.quality_reasons(F.col("blur_score"), F.col("brightness_mean"), F.col("overexposed_ratio"), corrupt, limits)
    return photos.withColumn("rejection_reasons", reasons).withColumn("is_accepted", F.size("rejection_reasons") == 0)


def grid_metrics(grids: DataFrame, pixels: str, rows: int, cols: int, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """``grids`` with laplacian_variance, brightness_mean and overexposed_ratio of a row-major pixel array."""
    p = F.col(pixels)
    n = F.size(p)
    bright = F.size(F.filter(p, lambda v: v >= limits.bright_pixel)) / n
    mean = F.aggregate(p, F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    return grids.withColumns({"laplacian_variance": expr.laplacian_variance(p, rows, cols), "brightness_mean": mean, "overexposed_ratio": bright})


def split_sizes(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of an uneven split: earlier parts are larger by one."""
    base, more = divmod(length, parts)
    sizes = [base + (i < more) for i in range(parts)]
    starts = [sum(sizes[:i]) for i in range(parts)]
    return list(zip(starts, sizes, strict=True))


def tile_blur(pixels: Column, rows: int, cols: int, limits: QualityLimits = QualityLimits()) -> Column:
    """Mean Laplacian variance of the sharpest share of the tiles of a grid."""
    tiles = [expr.laplacian_variance(expr.sub_grid(pixels, cols, top, left, h, w), h, w) for top, h in split_sizes(rows, limits.tile_rows) for left, w in split_sizes(cols, limits.tile_cols)]
    k = max(1, math.ceil(len(tiles) * limits.top_tiles))
    return expr.mean_of_top(F.array(*tiles), k)
