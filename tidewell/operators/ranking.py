"""Top rows of groups, cutoffs by rank, dominant values, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: str, n: int, order: list[Column], name: str = "rank_in_group") -> DataFrame:
    """The first ``n`` rows of every group. Spark prunes to n rows a task and group before
    the shuffle, so a hot group sends n rows a task, not all of its own."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def hottest(items: DataFrame, group: str = "platform", n: int = 200) -> DataFrame:
    return top_per_group(items, group, n, [F.col("hotness").desc_nulls_last(), F.col("id").asc()])


def pending_top(items: DataFrame, n: int) -> DataFrame:
    """Ids of the hottest pending rows of each platform; no score counts as 0, no platform as unknown."""
    known = items.select("id", F.coalesce("platform", F.lit("unknown")).alias("platform"), F.coalesce("hotness", F.lit(0.0)).alias("hotness"))
    return top_per_group(known, "platform", n, [F.col("hotness").desc(), F.col("id").asc()])


def cutoffs(items: DataFrame, percent: Column | int, group: str = "lang_group") -> DataFrame:
    """``cutoff`` of each group: the score at position max(1, trunc(count * percent / 100)).

    Approximate quantiles (off by a rank of a 20,000th at most) name a range of scores that holds the position.
    Rows above it are only counted, those inside are pre-aggregated to a row a score, and these are
    accumulated: some thousandths of a group, whatever the shape of its scores, and ties cost one row.
    """
    scored = items.filter(F.col("hotness").isNotNull() & F.col(group).isNotNull()).select(group, "hotness", (F.lit(percent) if isinstance(percent, int) else percent).alias("percent"))
    steps = 1000
    # a row a group (language, platform)
    held = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.first("percent").alias("percent"), F.percentile_approx("hotness", [i / steps for i in range(steps + 1)], 20_000).alias("q"))
    held = held.withColumn("k", F.greatest(F.lit(1), (F.col("n") * F.col("percent") / 100).cast("long")))
    at = F.floor((1 - F.col("k") / F.col("n")) * steps).cast("int")  # quantile just below the position
    low = F.element_at("q", F.greatest(at - 1, F.lit(1)))
    high = F.element_at("q", F.least(at + 4, F.lit(steps + 1)))
    bounds = held.select(group, "k", F.when(at <= 2, F.lit(float("-inf"))).otherwise(low).alias("low"), F.when(at >= steps - 4, F.lit(float("inf"))).otherwise(high).alias("high"))
    inside = scored.drop("percent").join(bounds, group).filter("hotness >= low")
    counts = inside.groupBy(group, "k", F.when(F.col("hotness") <= F.col("high"), F.col("hotness")).alias("score")).agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy(group).orderBy(F.col("score").desc_nulls_first()))
    return counts.withColumn("upto", upto).filter("upto >= k").groupBy(group).agg(F.max("score").alias("cutoff"))


def pool_sizes(items: DataFrame, cutoff: DataFrame, group: str = "lang_group") -> DataFrame:
    """Rows at or above their group's cutoff, beside all rows and their share."""
    return (
        items.filter(f"hotness is not null and {group} is not null")
        .join(cutoff, group)
        .groupBy(group)
        .agg(F.count_if(F.col("hotness") >= F.col("cutoff")).alias("pool"), F.count(F.lit(1)).alias("total"))
        .withColumn("pool_percent", F.round(100.0 * F.col("pool") / F.col("total"), 2))
    )


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; the smallest of equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(value))
    return counts.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select(group, value, "n")


def latest(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The last row of each group, by the given columns."""
    names = [c for c in df.columns if c != group]
    best = df.groupBy(group).agg(F.max(F.struct(*order, F.struct(*names).alias("row"))).alias("m"))
    return best.select(group, "m.row.*")
