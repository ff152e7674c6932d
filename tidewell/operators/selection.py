"""Fair selection: floors, caps, competition by hotness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import Settings
from tidewell.functions.numbers import truncated_percent
from tidewell.lineage import cut
from tidewell.operators import ordered
from tidewell.operators.ranking import cutoffs, dominant, pool_sizes


def hot_percent(group: Column, settings: Settings) -> Column:
    """Percent of a language: its own, else the global one."""
    known = [F.lit(x) for pair in settings.hot_percent_by_locale.items() for x in pair]
    own = F.try_element_at(F.create_map(*known), group) if known else F.lit(None).cast("int")
    return F.coalesce(own, F.lit(settings.hot_percent))


def in_window(items: DataFrame, settings: Settings) -> DataFrame:
    return items.filter(F.col("hours_old") <= settings.window_hours)


def surface_limits(surfaces: DataFrame, items: DataFrame, settings: Settings) -> DataFrame:
    """``floor`` and ``cap`` in rows for surfaces that have such a percentage.

    A surface's language is its dominant one in the window; limits are percentages of that
    language's pool. Surfaces without recent rows or with an empty pool get no limits.
    """
    recent = in_window(items, settings)
    lang = dominant(recent, "surface_key", "lang_group").drop("n")
    pools = pool_sizes(recent, cutoffs(recent, hot_percent(F.col("lang_group"), settings))).select("lang_group", "pool")
    limited = surfaces.filter("enabled and (floor_percent > 0 or cap_percent is not null)")
    floor = F.when(F.col("floor_percent") > 0, F.greatest(F.lit(1), truncated_percent(F.col("pool"), F.col("floor_percent")))).otherwise(0)
    return limited.join(lang, "surface_key").join(pools, "lang_group").filter("pool > 0").select(
        "surface_key", "region_id", "floor_percent", "surface_type", floor.alias("floor"), truncated_percent(F.col("pool"), F.col("cap_percent")).alias("cap")
    )


def eligible(items: DataFrame, target_lang: str, done: DataFrame | None = None) -> DataFrame:
    """Scored, summarised rows in another language that are not translated yet (``done``: ids)."""
    rows = items.filter(F.col("hotness").isNotNull() & F.col("summary_status").isin("complete", "skipped"))
    rows = rows.filter(~F.col("lang_group").eqNullSafe(F.lit(target_lang)))
    return rows.join(done, "id", "left_anti") if done is not None else rows


def floor_pass(rows: DataFrame, limits: DataFrame, batch: int) -> DataFrame:
    """First pass: every surface with a floor takes its share, larger percentages first.

    What a surface wants is the least of floor, cap and its eligible rows; the batch is filled
    in order, so a surface's part is its want clamped to what earlier ones left. Feeds take their
    newest rows, others their hottest. Only ``batch`` rows a surface are ranked.
    """
    floors = limits.filter("floor_percent > 0")
    score = F.when(F.col("surface_type") == "rss_feed", F.unix_timestamp("published_at").cast("double")).otherwise(F.col("hotness"))
    own = rows.drop("surface_type").join(F.broadcast(floors.select("surface_key", "surface_type")), "surface_key")
    w = Window.partitionBy("surface_key").orderBy(score.desc(), F.col("id"))
    ranked = own.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= batch)
    have = ranked.groupBy("surface_key").agg(F.count(F.lit(1)).alias("have"))
    want = F.least("floor", F.coalesce("cap", "floor"), "have")
    before = Window.orderBy(F.col("floor_percent").desc(), "region_id", "surface_key").rowsBetween(Window.unboundedPreceding, -1)
    parts = floors.join(have, "surface_key").withColumn("want", want)  # a row a surface
    take = F.greatest(F.lit(0), F.least(F.col("want"), F.lit(batch) - F.coalesce(F.sum("want").over(before), F.lit(0))))
    parts = parts.withColumn("take", take).select("surface_key", "take")
    return ranked.join(parts, "surface_key").filter("rn <= take").select("id", "surface_key", "lang_group", "hotness")


def competition_pass(rows: DataFrame, first: DataFrame, limits: DataFrame, cutoff: DataFrame, batch: int, source_langs: tuple[str, ...] = (), extra: int | None = None) -> DataFrame:
    """Second pass: rows at or above their language's cutoff compete by hotness.

    The hottest ``remaining + extra`` candidates are looked at (``extra``: a batch by default); those of a surface that has
    reached its cap are skipped; the first ``remaining`` others are taken.
    """
    pool = rows.filter(F.col("lang_group").isin(*source_langs)) if source_langs else rows
    counts = first.groupBy("surface_key").agg(F.count(F.lit(1)).alias("had"))
    remaining = first.agg((F.lit(batch) - F.count(F.lit(1))).alias("remaining"))  # one row
    candidates = pool.join(cutoff, "lang_group").filter("hotness >= cutoff").join(first.select("id"), "id", "left_anti")
    extra = batch if extra is None else extra
    # the buffer is never larger, so that is all that is sorted
    order = [F.col("hotness").desc(), F.col("id")]
    buffer = candidates.orderBy(*order).limit(batch + extra).crossJoin(F.broadcast(remaining))
    seen = buffer.withColumn("at", F.row_number().over(Window.orderBy(*order))).filter(F.col("at") <= F.col("remaining") + extra)
    joined = seen.join(counts, "surface_key", "left").join(limits.select("surface_key", "cap"), "surface_key", "left")
    place = F.row_number().over(Window.partitionBy("surface_key").orderBy(*order)) + F.coalesce("had", F.lit(0))
    free = joined.withColumn("place", place).filter("cap is null or place <= cap")
    return free.withColumn("rn", F.row_number().over(Window.orderBy(*order))).filter("rn <= remaining").select("id", "surface_key", "lang_group", "hotness")


def select_batch(items: DataFrame, surfaces: DataFrame, target_lang: str, settings: Settings, done: DataFrame | None = None) -> DataFrame:
    """Both passes: ``id``, ``surface_key``, ``pass`` of at most a batch of rows."""
    # each step reads the scores and the steps before several times, so they stand on written rows, without texts
    items = cut(items.drop("title", "description"))
    rows = eligible(items, target_lang, done)
    limits = cut(surface_limits(surfaces, items, settings))
    cutoff = cut(cutoffs(in_window(items, settings), hot_percent(F.col("lang_group"), settings)))
    first = cut(floor_pass(rows, limits, settings.batch_size))
    second = competition_pass(rows, first, limits, cutoff, settings.batch_size, settings.source_langs)
    return first.select("id", "surface_key", F.lit(1).alias("pass")).unionByName(second.select("id", "surface_key", F.lit(2).alias("pass")))


def summary_preselect(items: DataFrame, surfaces: DataFrame, settings: Settings, langs: list[str], limit: int = 500, extra: int = 50) -> DataFrame:
    """Rows to queue for summaries: the floor pass, then language after language in order.

    How many rows a language may look at depends on how many were taken before it, so the pass over
    languages (about 20, the caller names them) is a sequence of competition passes.
    """
    pending = cut(items.filter("hotness is not null and summary_status = 'pending'"))
    limits = cut(surface_limits(surfaces, items, settings))
    cutoff = cut(cutoffs(in_window(items, settings), hot_percent(F.col("lang_group"), settings)))
    taken = cut(floor_pass(pending, limits, limit))
    for lang in sorted(langs):
        own = competition_pass(pending.filter(F.col("lang_group") == lang), taken, limits, cutoff, limit, settings.source_langs, extra)
        # a step reads what was taken so far several times, so it stands on written rows
        taken = cut(taken.unionByName(own))
    return taken


def bucket_cap(rows: DataFrame, percent: float = 40.0) -> DataFrame:
    """At most ``percent`` of all rows from one bucket, the hottest first; equal scores by id, rows without one last.

    Scores are counted first, which shows at which score a bucket's limit falls: rows above it stay, rows below go,
    and only those at that very score are ranked.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total")).first()["total"]
    limit = math.floor(total * percent / 100)
    score = F.coalesce("hotness", F.lit(-math.inf))
    each = ordered.in_runs(rows.groupBy("bucket", (-score).alias("cold")).agg(F.count(F.lit(1)).alias("held")), ["bucket", "cold"])
    sums = ordered.running_sums(each, "bucket", ["cold"], F.col("held"))
    edge = cut(sums.filter((F.col("sum_so_far") > limit) & (F.col("sum_so_far") - F.col("held") <= limit)).select("bucket", "cold", (F.lit(limit) - F.col("sum_so_far") + F.col("held")).alias("room")))
    marked = rows.withColumn("__cold", -score).join(F.broadcast(edge.withColumnRenamed("bucket", "__bucket")), F.col("bucket").eqNullSafe(F.col("__bucket")), "left")  # a row a bucket
    clear = marked.filter(F.col("cold").isNull() | (F.col("__cold") < F.col("cold"))).select(*rows.columns)
    at_edge = marked.filter(F.col("__cold") == F.col("cold"))
    ranked = at_edge.withColumn("__rn", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).filter("__rn <= room")
    return clear.unionByName(ranked.select(*rows.columns))


def quota_status(items: DataFrame, percent: int) -> DataFrame:
    """Target, done and missing rows of each language, and whether its quota is filled."""
    counts = items.filter("hotness is not null").groupBy("lang_group").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("summary_status") == "complete").alias("done"))
    target = F.greatest(F.lit(1), truncated_percent(F.col("total"), percent)).cast("long")
    return counts.withColumn("target", target).select(
        "lang_group", "total", "done", "target", F.greatest(F.lit(0).cast("long"), F.col("target") - F.col("done")).alias("needed"),
        F.when(F.col("done") >= F.col("target"), "filled").when(F.col("done") > 0, "partial").otherwise("empty").alias("status"),
    )


def within_tolerance(expected: Column, actual: Column, strict: bool = False) -> Column:
    """Whether a count is near what was expected: off by max(2, twice the expected) at most."""
    allowed = F.lit(0) if strict else F.greatest(F.lit(2), 2 * expected)
    return F.abs(actual - expected) <= allowed
