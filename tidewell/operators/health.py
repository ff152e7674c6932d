"""Roll-ups of runs, surfaces, providers, requests and queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.numbers import percent
from tidewell.operators.ranking import latest


def run_ratios(runs: DataFrame) -> DataFrame:
    """Adds the shares of stored and of duplicate items, 0 for an empty run."""
    return runs.withColumn("success_rate", percent(F.col("stored"), F.col("fetched"))).withColumn("dedup_rate", percent(F.col("deduped"), F.col("fetched")))


def latest_runs(surfaces: DataFrame, runs: DataFrame) -> DataFrame:
    """The last run of every enabled surface; surfaces without one are ``never_run``."""
    last = latest(runs.select("surface_id", "started_at", "run_id", "status", "fetched", "stored"), "surface_id", ["started_at", "run_id"])
    joined = surfaces.filter("enabled").join(last, "surface_id", "left")
    return joined.select("surface_id", "surface_key", F.coalesce("status", F.lit("never_run")).alias("status"), "run_id", "started_at", "fetched", "stored")


def health_label(enabled: Column, last_error: Column, last_success: Column, last_run: Column) -> Column:
    """Five states; the first that holds."""
    return (
        F.when(~enabled, "Disabled")
        .when(F.coalesce(last_error, F.lit("")) != "", "Error")
        .when(last_success.isNotNull(), "Healthy")
        .when(last_run.isNotNull(), "Running")
        .otherwise("Never run")
    )


def due(next_run: Column, now: Column) -> Column:
    return next_run.isNull() | (next_run <= now)


def stale(last_run: Column, now: Column) -> Column:
    return last_run.isNull() | (last_run < now - F.expr("INTERVAL 1 HOUR"))


def allocation_label(floor: Column, cap: Column) -> Column:
    parts = F.array_compact(F.array(F.when(floor > 0, F.concat(F.lit("floor="), floor, F.lit("%"))), F.when(cap.isNotNull(), F.concat(F.lit("cap="), cap, F.lit("%")))))
    return F.when(F.size(parts) > 0, F.array_join(parts, " / ")).otherwise("—")


def to_disable(surfaces: DataFrame, runs: DataFrame, since: Column) -> DataFrame:
    """Enabled surfaces with their verdict: ``healthy``, ``skip`` (no runs) or ``disable``."""
    recent = runs.filter(F.col("started_at") >= since)
    seen = recent.groupBy("surface_id").agg(F.count(F.lit(1)).alias("runs"), F.max("stored").alias("best"))
    verdict = F.when(F.col("best") > 0, "healthy").when(F.col("runs").isNull(), "skip").otherwise("disable")
    return surfaces.filter("enabled").join(seen, "surface_id", "left").select("surface_id", "surface_key", verdict.alias("verdict"))


def status_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: a count for each status, in one pass."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))


def pivot_with_totals(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts by two keys with row totals, and a last row ``total`` with column totals."""
    counts = [F.count_if(F.col(columns) == v).alias(v) for v in values]
    rolled = df.rollup(rows).agg(*counts, F.count(F.lit(1)).alias("total"), F.grouping(rows).alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "total").otherwise(F.col(rows)).alias(rows), *values, "total")


def by_platform(items: DataFrame) -> DataFrame:
    return items.groupBy("platform").agg(F.count(F.lit(1)).alias("items"))


def llm_budget(items: DataFrame, k: int) -> DataFrame:
    """What a cycle asks the external classifier at most: sum of min(count, k), and k a platform."""
    return by_platform(items).agg(F.sum(F.least("items", F.lit(k))).alias("wanted"), (F.count(F.lit(1)) * k).alias("ceiling"), F.count(F.lit(1)).alias("platforms"))


def duplicates(df: DataFrame, keys: list[str], filled: bool = False) -> DataFrame:
    """Keys with more than one row; with ``filled``, null and empty keys are left out."""
    if filled:
        df = df.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in keys]))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: how many rows have a, have b, have both, have b alone."""
    return df.agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & b).alias("both"), F.count_if(b & ~a).alias("b_only"))


def outside_list(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


#: Errors and the states they put a provider in.
HTTP_STATES = {
    401: "unavailable_auth", 403: "unavailable_auth", 429: "unavailable_rate_limit",
    500: "unavailable_transient", 502: "unavailable_transient", 503: "unavailable_transient", 504: "unavailable_transient",
}
QUOTA_CODES = ("insufficient_quota", "billing_hard_limit_reached", "billing_not_active", "quota_exceeded", "rate_limit_exceeded")


def provider_state(http_status: Column, error_code: Column) -> Column:
    by_status = F.try_element_at(F.create_map(*[F.lit(x) for kv in HTTP_STATES.items() for x in kv]), http_status)
    return F.when(error_code.isin(*QUOTA_CODES), "unavailable_funds").otherwise(F.coalesce(by_status, F.lit("unavailable_transient")))


def providers_rollup(providers: DataFrame) -> DataFrame:
    """One row: ok, degraded, or stopped when none is available (so, too, when there is none)."""
    up = F.count_if(F.col("state") == "available")
    total = F.count(F.lit(1))
    return providers.agg(total.alias("providers"), up.alias("available"), F.when(up == 0, "stopped").when(up < total, "degraded").otherwise("ok").alias("status"))


def domain_hours(requests: DataFrame) -> DataFrame:
    """Hourly counters of every domain; 3xx count as success, 429 and 403 also on their own."""
    s = F.col("status")
    return requests.groupBy("domain", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count_if((s >= 200) & (s < 400)).alias("requests_2xx"), F.count_if((s >= 400) & (s < 500)).alias("requests_4xx"), F.count_if(s >= 500).alias("requests_5xx"),
        F.count_if(s == 429).alias("requests_429"), F.count_if(s == 403).alias("requests_403"), F.avg("latency").alias("latency_mean"),
    )


def domain_report(hours: DataFrame, since: Column | None = None) -> DataFrame:
    """Sums and success rate of every domain over its hours."""
    rows = hours.filter(F.col("hour") >= since) if since is not None else hours
    names = ["requests_2xx", "requests_4xx", "requests_5xx", "requests_429", "requests_403"]
    summed = rows.groupBy("domain").agg(*[F.sum(c).alias(c) for c in names], F.floor(F.avg("latency_mean")).cast("long").alias("latency_mean"))
    total = F.col("requests_2xx") + F.col("requests_4xx") + F.col("requests_5xx")
    return summed.withColumn("total", total).withColumn("success_rate", percent(F.col("requests_2xx"), total))


def true_percentiles(requests: DataFrame) -> DataFrame:
    """Exact median and 95th percentile of the latency of each domain and hour."""
    return requests.groupBy("domain", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.percentile("latency", 0.5).alias("p50"), F.percentile("latency", 0.95).alias("p95"), F.count(F.lit(1)).alias("n")
    )


def merged_counters(stored: DataFrame, deltas: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Stored counters plus deltas, by key."""
    both = stored.select(*keys, *counters).unionByName(deltas.select(*keys, *counters))
    return both.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters])


def service_status(spark: SparkSession, now: Column) -> DataFrame:
    """One row: the constant answer of a service that runs."""
    return spark.range(1).select(F.lit("healthy").alias("status"), F.lit("tidewell").alias("service"), now.alias("timestamp"))


def translation_health(providers: DataFrame, translations: DataFrame) -> DataFrame:
    """One row: the providers' roll-up and how many translations are complete and failed."""
    done = translations.agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"))
    rate = percent(F.col("complete"), F.col("complete") + F.col("failed"))
    return providers_rollup(providers).crossJoin(F.broadcast(done)).withColumn("success_rate", rate)  # a row each
