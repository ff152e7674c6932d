"""Exactly-once ingestion with dedup over all history: the stored items are the index of what was seen.

State of a stream would grow with every key, or forget at a watermark. Here a micro-batch is held against the keys
of the stored table, of which Spark reads one column, pruned by a filter over the batch's own keys (a runtime Bloom filter
where it pays); what is new is appended, and the batch's number with it, in one commit. A batch that is
repeated after a restart finds its number committed and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import canonical_hash
from tidewell.lineage import scratch
from tidewell.sources import versions


def unseen(batch: DataFrame, stored: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """Rows of ``batch`` whose ``key`` is neither stored nor that of an earlier row (by ``order``) of the batch."""
    first = Window.partitionBy(key).orderBy(*order)
    once = batch.withColumn("__tw_rn", F.row_number().over(first)).filter("__tw_rn = 1").drop("__tw_rn")
    if stored is None:
        return once
    known = stored.select(key).join(batch.select(key).distinct(), key, "left_semi").distinct()
    return once.join(known, key, "left_anti")


def ingest(path: str, key: Column | None = None, order: tuple[str, ...] = ("collected_at",)) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends unseen items to the versioned table at ``path``, with their ``canonical_hash``.

    ``key``: by default the hash of title and address. Rows without a key are one within a batch, and never known from before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = versions.current(spark, path)
        if base.watermark is not None and base.watermark >= batch_id:
            return  # committed before the restart
        keyed = batch.withColumn("canonical_hash", canonical_hash(F.col("title"), F.col("url")) if key is None else key)
        with scratch(spark):
            versions.append(unseen(keyed, versions.read(spark, path), "canonical_hash", list(order)), path, batch_id, base)

    return write
