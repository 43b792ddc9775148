"""An album quota: at most so many photos a day and in total; what a day leaves over, later days may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def select_album(candidates: DataFrame, per_day: int, in_total: int, by: list[str], day: str, rank_by: list[Column]) -> DataFrame:
    """``candidates`` that are chosen, with their place in the day.

    Days take photos in their order. A day may use its own allowance and what earlier days
    left of theirs, until the total is used up. The days are few, so the running sums run
    over one row for each day; the photos are only ranked within their day.
    """
    sizes = candidates.groupBy(*by, day).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by if by else [F.lit(0)]).orderBy(day)
    listed = sizes.withColumn("__d", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # taken up to a day: all there is up to it, less the greatest excess over the allowance at any day before
    head = listed.withColumn("__sum", F.sum("__n").over(so_far))
    excess = F.max(F.col("__sum") - F.col("__d") * per_day).over(so_far)
    upto = F.least(F.lit(in_total), F.col("__sum") - F.greatest(F.lit(0), excess))
    taken = head.withColumn("__upto", upto).withColumn("__take", F.col("__upto") - F.coalesce(F.lag("__upto").over(order), F.lit(0)))
    ranked = candidates.withColumn("place", F.row_number().over(Window.partitionBy(*by, day).orderBy(*rank_by)))
    return ranked.join(taken.select(*by, day, "__take"), [*by, day]).where(F.col("place") <= F.col("__take")).drop("__take")
