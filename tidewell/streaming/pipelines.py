"""Structured Streaming forms: ingestion, dedup, counters, state machines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions.text import canonical_hash
from tidewell.operators.policy import breaker_start, breaker_step


def files(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A directory that payloads land in, as a stream."""
    return spark.readStream.schema(schema).format(kind).load(path)


def deduplicated(items: DataFrame, watermark: str | None = None, time: str = "collected_at") -> DataFrame:
    """Items whose identity was not seen before; with a watermark, within that time, so state stays bounded."""
    keyed = items.withColumn("canonical_hash", canonical_hash(F.col("title"), F.col("url")))
    if watermark is None:
        return keyed.dropDuplicates(["canonical_hash"])
    return keyed.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["canonical_hash"])


def hourly_counters(requests: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Counters of each domain and hour; rows that come later than the watermark are dropped."""
    s = F.col("status")
    windowed = requests.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour"), "domain")
    counts = windowed.agg(F.count_if((s >= 200) & (s < 400)).alias("requests_2xx"), F.count_if((s >= 400) & (s < 500)).alias("requests_4xx"), F.count_if(s >= 500).alias("requests_5xx"))
    return counts.select("domain", F.col("window.start").alias("hour"), "requests_2xx", "requests_4xx", "requests_5xx")


def breaker(requests: DataFrame, threshold: int = 5, cooldown: int = 300) -> DataFrame:
    """Circuit breakers of domains over a stream of (domain, seconds, request_id, outcome)."""
    step = breaker_step(threshold, cooldown)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ("circuit", "opened", "failures", "backoff")
        held = dict(zip(names, state.get, strict=True)) if state.exists else breaker_start()
        events = pd.concat(list(batches)).sort_values(["seconds", "request_id"])
        out = [{"domain": key[0], "seconds": e["seconds"], "request_id": e["request_id"], **step(held, e)} for e in events.to_dict("records")]
        state.update(tuple(held[n] for n in names))
        yield pd.DataFrame(out)

    return requests.groupBy("domain").applyInPandasWithState(
        run, "domain string, seconds long, request_id long, blocked boolean, circuit string, failures int, backoff double",
        "circuit string, opened long, failures int, backoff double", "append", GroupStateTimeout.NoTimeout,
    )


def each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], once: bool = True, every: str = "60 seconds"):
    """Run ``write(batch, batch_id)`` for each micro-batch; the offset moves only after it succeeds."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def idempotent(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that replaces the partition of its batch, so a repeated batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write
