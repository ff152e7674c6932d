"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, join_grouped


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("held")).select("u", F.least("u", "m").alias("m"), "held")
    return join_grouped(both.filter("v > u"), least, "u", "held", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("held"))
    moved = join_grouped(edges, least, "u", "held", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node that has a link.

    ``links``: columns ``u``, ``v`` (long, not null), in any direction, repeats and loops
    allowed. Returns ``node``, ``root``; nodes without a link to another node are absent.
    Every round is two grouped minima and two joins on the remaining links, written to the
    checkpoint folder; nothing but a row count and a checksum comes to the driver. Centres of large
    stars are joined by broadcast (a thousand nodes at most), so no task gets all their links. A round
    at least halves the depth of every component's tree, so their number grows with the
    logarithm of a component's size. An empty link table gives an empty result.
    """
    state = cut(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    before = None
    for _ in range(max_rounds):
        now = state.agg(F.count(F.lit(1)).alias("n"), mark).first()
        if now["n"] == 0 or now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        large = _large_star(state, now["n"]).distinct()
        if now["n"] > 1_000_000:  # its two readers then share one result
            large = cut(large)
        state = cut(_small_star(large, now["n"]).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
