"""Sharding by proportional stratified interleaving. DataFrame functions only.

Rows of a source are put in a seeded random order; the r-th of n rows gets the fractional
rank (r - u) / n, where u in (0, 1] depends on seed and source, so that many small sources
spread out too. All rows are ordered by fractional rank and cut into runs of equal length: every run
then holds each source in its share of the whole, to within a row.

No group is ordered by one task. A seeded order is dealt into ranges of its leading digits,
fractional ranks into ranges of equal width; a range holds a bounded number of rows in
expectation, and the counts of the ranges before it give its first rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut

#: Rows of one range, in expectation.
RANGE_ROWS = 20_000


def _digest(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows in the ranges before each range; ``counts`` has a row a range."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("held").over(w), F.lit(0).cast("long"))).drop("held")


def shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``rows``: counts of shards are at most one apart, and slots of a shard run from
    0 without gaps. ``size``: UTF-8 bytes of the text plus 8. A null text counts as
    empty; a null source and an empty one are the same stratum; rows with equal or null doc_id
    are told apart by text checksum and size, and full repeats by chance, as they are the
    same. An empty table gives an empty result. ``grown_shard`` is null under this law.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        (F.octet_length(t) + 8).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        _digest(seed, F.col(key)).alias("h"),
    )
    per_source = cut(rows.select("source", F.substring("h", 1, 5).alias("b")).groupBy("source", "b").agg(F.count(F.lit(1)).alias("held")))
    n = per_source.agg(F.sum("held")).first()[0] or 0
    digits = min(5, max(1, math.ceil(math.log(max(n, 1) / RANGE_ROWS, 16)))) if n > RANGE_ROWS else 1
    bucket = F.substring("h", 1, digits)
    counts = per_source.groupBy("source", F.substring("b", 1, digits).alias("b")).agg(F.sum("held").alias("held"))
    of_source = per_source.groupBy("source").agg(F.sum("held").alias("n"))
    offsets = _before(counts, ["source"], "b").join(of_source, "source")
    order = ["h", "doc_id", "text_crc32", "size"]
    ranked = (
        rows.withColumn("b", bucket)
        .withColumn("rn", F.row_number().over(Window.partitionBy("source", "b").orderBy(*order)))
        .join(offsets, ["source", "b"])
    )
    u = (F.conv(F.substring(_digest(seed, F.col("source")), 1, 8), 16, 10).cast("double") + 1) / F.lit(2.0**32)
    ranges = 16**digits
    placed = cut(
        ranked.withColumn("frac", ((F.col("rn") + F.col("before")).cast("double") - u) / F.col("n").cast("double"))
        .withColumn("f", F.floor(F.col("frac") * ranges).cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "h", "frac", "f")
    )
    ahead = _before(placed.groupBy("f").agg(F.count(F.lit(1)).alias("held")), [], "f")
    by_rank = Window.partitionBy("f").orderBy("frac", "source", *order)
    positions = placed.withColumn("rn", F.row_number().over(by_rank)).join(ahead, "f").withColumn("p", F.col("rn") - 1 + F.col("before"))
    cut_at = positions.withColumn("shard", F.expr(f"(p * {n_shards}) div {max(n, 1)}"))
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return cut_at.select(
        "doc_id", "source", "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("p") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
