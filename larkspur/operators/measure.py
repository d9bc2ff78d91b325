"""Percentiles of weighted measurements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_percentiles(rows: DataFrame, group: str, value: str, weight: str, shares: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """(group, p95, ...): nearest-rank percentiles, each value counted ``weight`` times.

    The rank is ``ceil(share * total weight)``, 1 at least.  Equal values are
    summed before the window, which then sees each value of a group once.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum(weight).cast("double").alias("_w"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_upto", F.sum("_w").over(upto)).withColumn("_all", F.sum("_w").over(Window.partitionBy(group)))
    rank = lambda s: F.greatest(F.ceil(F.col("_all") * F.lit(s)), F.lit(1))
    return sums.groupBy(group).agg(*[F.min(F.when(F.col("_upto") >= rank(s), F.col(value))).alias(f"p{math.floor(s * 100)}") for s in shares])
