"""Logical tables from the fixture tables. All mappings are arithmetic on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import AS_OF

BUCKETS = ("hot_now", "category_tech", "world_news", "category_ai", "rss", "search")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(AS_OF).cast("timestamp")


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 15 user groups: a row each."""
    kinds = {"views": "view", "upvotes": "click", "comments": "signup", "shares": "purchase"}
    events = read(spark, sf_dir, "events")
    return events.groupBy((F.col("user_id") % 15).alias("g")).agg(*[F.count_if(F.col("event_type") == k).alias(c) for c, k in kinds.items()])


SIGNALS = ("views", "upvotes", "comments", "shares")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with platform, region, times, statuses and engagement; the first line of a text is its title."""
    return engaged(spark, sf_dir, plain_items(spark, sf_dir))


def engaged(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Items with their signals: late, where few rows are left."""
    signals = F.broadcast(engagement(spark, sf_dir))  # 15 rows
    joined = rows.join(signals, F.col("id") % 15 == F.col("g"), "left")
    return joined.select(*rows.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SIGNALS])


def plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without engagement."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    k = F.substring("source", 4, 10).cast("int")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    bucket = F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), (F.col("k") % len(BUCKETS) + 1).cast("int"))
    base = docs.select(
        F.col("doc_id").alias("id"), title.alias("title"), F.substr("text", F.length(title) + 2).alias("description"),
        F.col("lang").alias("lang_group"), F.col("source").alias("surface_key"), k.alias("k"),
    )
    joined = base.join(labels, base["id"] == labels["doc_id"], "left")
    hours = (F.col("id") % 96).cast("int")
    return joined.select(
        "id", "title", "description", "lang_group", "surface_key", "k",
        F.concat(F.lit("p"), F.col("k") % 5).alias("platform"),
        (F.col("k") % 25).alias("region_id"),
        bucket.alias("bucket"),
        F.when(F.col("k") % 3 == 0, "rss_feed").otherwise("ranking").alias("surface_type"),
        hours.cast("double").alias("hours_old"),
        F.timestamp_seconds(F.unix_timestamp(now()) - hours * 3600).alias("collected_at"),
        F.timestamp_seconds(F.unix_timestamp(now()) - (hours + F.col("id") % 7) * 3600).alias("published_at"),
        (F.col("id") % 120 + 1).cast("int").alias("rank_position"),
        F.when(F.col("quality") == 1, "complete").when(F.col("quality") == 0, "failed").otherwise("pending").alias("summary_status"),
        F.when(F.col("toxic") == 1, "complete").when(F.col("toxic") == 0, "pending").alias("translation_status"),
    )


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with hotness; every tenth has none yet."""
    return scored(items(spark, sf_dir))


def scored(rows: DataFrame) -> DataFrame:
    from tidewell.operators.hotness import with_hotness

    return with_hotness(rows).withColumn("hotness", F.when(F.col("id") % 10 != 9, F.col("hotness")))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("region_key"), F.col("r_name").alias("region_name"),
        (F.col("n_nationkey") % 5 != 4).alias("enabled"),
    )


def surfaces(spark: SparkSession) -> DataFrame:
    """The 20 sources as surfaces with their allocation settings."""
    k = F.col("id").cast("int")
    return spark.range(20).select(
        k.alias("surface_id"), F.concat(F.lit("src"), k).alias("surface_key"), F.concat(F.lit("p"), k % 5).alias("platform"),
        (k % 25).alias("region_id"), (k % 7 != 6).alias("enabled"),
        F.when(k % 3 == 0, "rss_feed").otherwise("ranking").alias("surface_type"),
        F.when(k % 4 == 0, (k % 3 + 1) * 5).otherwise(0).alias("floor_percent"),
        F.when(k % 5 == 0, (k % 4) * 10).alias("cap_percent"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl runs: orders, with a line as a fetched item and returned ones as new."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    counts = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("l_returnflag") == "N").alias("stored"))
    joined = orders.join(counts, orders["o_orderkey"] == counts["l_orderkey"], "left")
    return joined.select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 20).cast("int").alias("surface_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"),
        F.coalesce("fetched", F.lit(0)).cast("long").alias("fetched"), F.coalesce("stored", F.lit(0)).cast("long").alias("stored"),
    ).withColumn("deduped", F.col("fetched") - F.col("stored"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: events as requests to 20 domains."""
    status = (
        F.when(F.col("event_type") == "error", 503)
        .when(F.col("event_type") == "signup", F.when(F.col("user_id") % 2 == 0, 404).otherwise(429))
        .otherwise(200)
    )
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("d"), F.col("user_id") % 20, F.lit(".example")).alias("domain"), status.alias("status"), F.col("value").alias("latency"),
    )


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as derived artefacts of items; several may share a key."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("item_id"), F.when(F.col("turn") % 3 == 0, "translation").when(F.col("turn") % 3 == 1, "summary").otherwise("embedding").alias("derivation_type"),
        F.col("role").alias("target_locale"), F.col("turn").alias("created_order"), F.col("text").alias("content"),
        F.when(F.length("text") % 4 == 0, "failed").otherwise("complete").alias("status"),
    )
