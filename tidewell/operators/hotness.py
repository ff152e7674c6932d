"""Hotness scores and statistics of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import numbers


def with_hotness(items: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``hotness`` from signals, rank and age."""
    weight = numbers.engagement_weight(*[F.col(c) for c in ("upvotes", "comments", "views", "shares", "rank_position")])
    return items.withColumn("weight", weight).withColumn("hotness", numbers.hotness(F.col("weight"), F.col("hours_old")))


def coverage(items: DataFrame) -> DataFrame:
    """One row: items, scored ones, their share, and the spread of scores; one pass."""
    return items.agg(
        F.count(F.lit(1)).alias("total"), F.count("hotness").alias("scored"),
        numbers.percent(F.count("hotness"), F.count(F.lit(1))).alias("coverage"),
        F.round(F.avg("hotness"), 4).alias("mean"), F.round(F.min("hotness"), 4).alias("low"), F.round(F.max("hotness"), 4).alias("high"),
    )


def bands(items: DataFrame) -> DataFrame:
    return items.filter("hotness is not null").groupBy(numbers.band(F.col("hotness")).alias("band")).agg(F.count(F.lit(1)).alias("items"))


def histogram(items: DataFrame, bounds: tuple[float, ...] = (0, 50, 100, 200, 300, 500)) -> DataFrame:
    """Half-open ranges [low, next low), the last one open; empty ranges are absent."""
    low = None
    for b in reversed(bounds):
        low = F.when(F.col("hotness") >= b, F.lit(float(b))) if low is None else low.when(F.col("hotness") >= b, F.lit(float(b)))
    return items.withColumn("low", low).filter("low is not null").groupBy("low").agg(F.count(F.lit(1)).alias("items"))
