"""Queries over the fixture tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.config import Settings
from tidewell.functions import numbers, text, times, urls
from tidewell.functions.collections import batch_number
from tidewell.operators import automaton, feed, health, hotness, keywords, language_model, languages, ordered, policy, ranking, regions, segmentation, selection, statuses, tables, topics
from tidewell.plans import views
from tidewell.sources import adapters, html_sources
from tidewell.sources.adapters import now, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SETTINGS = Settings()
STATUSES = ["pending", "complete", "failed"]
#: Terms taken from the fixture texts, as their syllables hold no real keywords.
VOCABULARY = {"politics": ["the", "der"], "science": ["est", "de la"], "sports": ["ing", "oro"], "ai": ["thand", "wh"]}
REGION_TERMS = {"us": ["the"], "de": ["der ", "ung"], "fr": ["eau", "ent"], "es": ["ció"]}
REGION_SURFACES = {"src3": "jp", "src4": "kr"}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _stamp(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# Feed


@query(
    f"""WITH {views.SCORED}, {views.REGIONS}
SELECT id, title, platform, bucket, region_key, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at, round(hotness, 4) AS hotness
FROM scored JOIN regions USING (region_id) WHERE enabled AND summary_status IN ('complete', 'skipped') ORDER BY scored.collected_at DESC, id DESC LIMIT 51"""
)
def feed_page(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: scored items with their regions, ready ones, newest first, one more than a page."""
    items = adapters.plain_items(spark, sf).filter(F.col("summary_status").isin("complete", "skipped")).drop("description")
    joined = items.join(F.broadcast(adapters.regions(spark, sf).filter("enabled")), "region_id")
    rows = adapters.scored(adapters.engaged(spark, sf, feed.page(joined, 50)))  # the order needs no score: only the page's rows get signals and one
    return rows.select("id", "title", "platform", "bucket", "region_key", _stamp("collected_at").alias("collected_at"), F.round("hotness", 4).alias("hotness"))


@query(f"WITH {views.SCORED} SELECT id, round(hotness, 4) AS hotness FROM scored WHERE lang_group = 'en' ORDER BY (hotness IS NOT NULL) DESC, hotness DESC, collected_at DESC, id DESC LIMIT 40")
def feed_scored_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed.filtered(adapters.scored_items(spark, sf), lang_group="en", bucket="")
    return rows.orderBy(*feed.scored_first_order()).limit(40).select("id", F.round("hotness", 4).alias("hotness"))


@query(f"WITH {views.ITEMS} SELECT id, bucket FROM items WHERE bucket = 'category_tech' AND id < 500 ORDER BY collected_at DESC, id DESC LIMIT 21")
def feed_cursor_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed.filtered(adapters.items(spark, sf), bucket="category_tech")
    return feed.page(rows, 20, cursor="eyJpZCI6IDUwMCwgImxhbmciOiAiemgtSGFucyJ9").select("id", "bucket")


@query(f"WITH {views.ITEMS} SELECT id, platform FROM items WHERE collected_at < TIMESTAMP '2024-01-29 00:00:00' OR (collected_at = TIMESTAMP '2024-01-29 00:00:00' AND id < 300) ORDER BY collected_at DESC, id DESC LIMIT 30")
def feed_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return feed.keyset_page(adapters.items(spark, sf), 30, ("2024-01-29 00:00:00", 300)).select("id", "platform")


@query(
    f"""WITH {views.ITEMS}, first AS (SELECT *, row_number() OVER (ORDER BY collected_at DESC, id DESC) AS position FROM items)
SELECT id, position FROM first WHERE position <= 400 AND translation_status = 'complete' ORDER BY position LIMIT 25"""
)
def feed_bounded_scan(spark: SparkSession, sf: str) -> DataFrame:
    ready = feed.ready_flag(F.lit(False), F.col("translation_status"), F.col("title"), F.lit(False), F.lit(False))
    return feed.bounded_scan(adapters.items(spark, sf), ready, 25, cap=400).select("id", F.col("position").cast("long").alias("position"))


@query(
    f"""WITH {views.ITEMS}, {views.DERIVATIONS}, best AS (
  SELECT item_id, max(CASE WHEN target_locale = 'user' AND status = 'complete' THEN content END) AS derived,
         max(CASE WHEN target_locale = 'assistant' AND status = 'complete' THEN content END) AS legacy FROM derivations WHERE derivation_type = 'translation' GROUP BY 1)
SELECT id, CASE WHEN nullif(derived, '') IS NOT NULL THEN 'derived' WHEN nullif(legacy, '') IS NOT NULL THEN 'legacy' WHEN lang_group = 'en' THEN 'original' ELSE 'none' END AS shown_from,
  coalesce(nullif(derived, ''), nullif(legacy, ''), title) AS shown
FROM items LEFT JOIN best ON id = item_id"""
)
def feed_display(spark: SparkSession, sf: str) -> DataFrame:
    """Display titles: translations pre-aggregated to a row an item, joined once."""
    done = adapters.derivations(spark, sf).filter("derivation_type = 'translation' and status = 'complete'")
    best = done.groupBy("item_id").agg(F.max(F.when(F.col("target_locale") == "user", F.col("content"))).alias("derived"), F.max(F.when(F.col("target_locale") == "assistant", F.col("content"))).alias("legacy"))
    items = adapters.items(spark, sf)
    joined = items.join(best, items["id"] == best["item_id"], "left")
    same = F.col("lang_group") == "en"
    shown = feed.display_title(F.col("derived"), F.lit(None).cast("string"), F.col("legacy"), F.col("title"), F.col("title"), same)
    kind = F.when(F.nullif("derived", F.lit("")).isNotNull(), "derived").when(F.nullif("legacy", F.lit("")).isNotNull(), "legacy").when(same, "original").otherwise("none")
    return joined.select("id", kind.alias("shown_from"), shown.alias("shown"))


@query(f"WITH {views.ITEMS} SELECT id, to_base64(encode(CAST(id AS VARCHAR))) AS cursor FROM items WHERE surface_key = 'src4' ORDER BY collected_at DESC, id DESC LIMIT 15")
def recent_items(spark: SparkSession, sf: str) -> DataFrame:
    return feed.recent_of_surface(adapters.items(spark, sf), "src4", 15).select("id", feed.encode_cursor(F.col("id")).alias("cursor"))


@query(f"WITH {views.ITEMS} SELECT id FROM items WHERE lower(title) LIKE '%ing the%'")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return feed.searched(adapters.items(spark, sf), "ING the").select("id")


@query(f"WITH {views.ITEMS} SELECT id, translation_status FROM items WHERE translation_status IS DISTINCT FROM 'complete'")
def exclude_keeps_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return feed.excluding(adapters.items(spark, sf), "translation_status", "complete").select("id", "translation_status")


@query(f"WITH {views.ITEMS} SELECT strftime(date_trunc('day', collected_at), '%Y-%m-%d') AS period, count(*) AS items FROM items GROUP BY 1")
def drill_down(spark: SparkSession, sf: str) -> DataFrame:
    return feed.drill_down(adapters.items(spark, sf))


@query(f"WITH {views.REGIONS} SELECT region_key, region_name FROM regions WHERE enabled ORDER BY region_key")
def region_list(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.regions(spark, sf).filter("enabled").select("region_key", "region_name").orderBy("region_key")


@query(f"WITH {views.REGIONS}, {views.SURFACES} SELECT surface_key, s.platform, region_key FROM surfaces s JOIN regions r ON s.region_id = r.region_id WHERE s.enabled AND r.enabled")
def surface_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.surfaces(spark).filter("enabled").join(adapters.regions(spark, sf).filter("enabled").drop("enabled"), "region_id")
    return rows.select("surface_key", "platform", "region_key")


# Hotness


@query(f"WITH {views.SCORED} SELECT id, round(weight, 4) AS weight, round(score, 4) AS hotness FROM scored")
def hotness_score(spark: SparkSession, sf: str) -> DataFrame:
    return hotness.with_hotness(adapters.items(spark, sf)).select("id", F.round("weight", 4).alias("weight"), F.round("hotness", 4).alias("hotness"))


@query(
    f"""WITH {views.SCORED} SELECT CASE WHEN hotness >= 500 THEN 'Top 1%' WHEN hotness >= 300 THEN 'Top 5%' WHEN hotness >= 200 THEN 'Top 10%' WHEN hotness >= 100 THEN 'Top 25%'
  WHEN hotness >= 50 THEN 'Top 50%' ELSE 'Bottom 50%' END AS band, count(*) AS items FROM scored WHERE hotness IS NOT NULL GROUP BY 1"""
)
def hotness_bands(spark: SparkSession, sf: str) -> DataFrame:
    return hotness.bands(adapters.scored_items(spark, sf))


@query(
    f"""WITH {views.SCORED} SELECT count(*) AS total, count(hotness) AS scored, round(100.0 * count(hotness) / count(*), 2) AS coverage, round(avg(hotness), 4) AS mean,
  round(min(hotness), 4) AS low, round(max(hotness), 4) AS high FROM scored"""
)
def hotness_stats(spark: SparkSession, sf: str) -> DataFrame:
    return hotness.coverage(adapters.scored_items(spark, sf))


@query(
    f"""WITH {views.SCORED} SELECT CAST(CASE WHEN hotness >= 500 THEN 500 WHEN hotness >= 300 THEN 300 WHEN hotness >= 200 THEN 200 WHEN hotness >= 100 THEN 100 WHEN hotness >= 50 THEN 50 ELSE 0 END AS DOUBLE) AS low,
  count(*) AS items FROM scored WHERE hotness IS NOT NULL GROUP BY 1"""
)
def hotness_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return hotness.histogram(adapters.scored_items(spark, sf))


@query(
    f"""WITH {views.SCORED} SELECT id FROM scored WHERE hotness IS NULL OR id % 9 >= 6 OR (hours_old < 48 AND id % 9 >= 3)"""
)
def recompute_due(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.scored_items(spark, sf)
    return items.filter(numbers.needs_recompute(F.col("hotness"), (F.col("id") % 9).cast("double"), F.col("hours_old"))).select("id")


# Dedup and runs


@query(
    """WITH h AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) || '|' || lower(source)) AS hash FROM documents)
SELECT hash, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY 1"""
)
def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Identities of documents: the first holder and how many there are."""
    hashed = read(spark, sf, "documents").select("doc_id", text.canonical_hash(F.col("text"), F.col("source")).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return health.duplicates(read(spark, sf, "documents"), ["text"], filled=True)


@query(f"WITH {views.DERIVATIONS} SELECT item_id, target_locale, count(*) AS n FROM derivations GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return health.duplicates(adapters.derivations(spark, sf), ["item_id", "target_locale"])


@query(
    """WITH a AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents),
old AS (SELECT sha256(text) AS h FROM documents JOIN labels USING (doc_id))
SELECT doc_id FROM a WHERE rn = 1 AND h NOT IN (SELECT h FROM old)"""
)
def insert_new_only(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as incoming rows, labelled ones as history."""
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    history = docs.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return tables.new_rows(docs, history, "h", [F.col("doc_id")]).select("doc_id")


@query(f"WITH {views.RUNS} SELECT run_id, CASE WHEN fetched = 0 THEN 0.0 ELSE round(100.0 * stored / fetched, 2) END AS success_rate, CASE WHEN fetched = 0 THEN 0.0 ELSE round(100.0 * deduped / fetched, 2) END AS dedup_rate FROM runs")
def run_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return health.run_ratios(adapters.runs(spark, sf)).select("run_id", "success_rate", "dedup_rate")


@query(
    f"""WITH {views.RUNS}, {views.SURFACES}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY surface_id ORDER BY started_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1)
SELECT s.surface_id, s.surface_key, coalesce(status, 'never_run') AS status, run_id, fetched, stored FROM surfaces s LEFT JOIN last l ON s.surface_id = l.surface_id WHERE s.enabled"""
)
def crawl_health_latest(spark: SparkSession, sf: str) -> DataFrame:
    return health.latest_runs(adapters.surfaces(spark), adapters.runs(spark, sf)).drop("started_at")


@query(
    f"""WITH {views.RUNS}, {views.SURFACES}, bounds AS (SELECT max(started_at) - INTERVAL 1 DAY AS since FROM runs),
seen AS (SELECT surface_id, count(*) AS n, max(stored) AS best FROM runs, bounds WHERE started_at >= since GROUP BY 1)
SELECT s.surface_id, surface_key, CASE WHEN best > 0 THEN 'healthy' WHEN n IS NULL THEN 'skip' ELSE 'disable' END AS verdict FROM surfaces s LEFT JOIN seen USING (surface_id) WHERE enabled"""
)
def surface_disable(spark: SparkSession, sf: str) -> DataFrame:
    runs = adapters.runs(spark, sf)
    bound = runs.agg((F.max("started_at") - F.expr("INTERVAL 1 DAY")).alias("since"))
    recent = runs.crossJoin(F.broadcast(bound)).filter("started_at >= since")
    return health.to_disable(adapters.surfaces(spark), recent, F.lit("1900-01-01").cast("timestamp"))


@query(
    f"""WITH {views.RUNS}, m AS (SELECT *, sum(CASE WHEN stored > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY surface_id ORDER BY started_at, run_id) AS island FROM runs),
s AS (SELECT *, sum(CASE WHEN stored > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY surface_id, island ORDER BY started_at, run_id) AS streak FROM m)
SELECT surface_id, CAST(max(streak) AS BIGINT) AS longest, count(*) FILTER (streak >= 3) AS unhealthy_runs FROM s GROUP BY 1"""
)
def unhealthy_streak(spark: SparkSession, sf: str) -> DataFrame:
    runs = ordered.streaks(adapters.runs(spark, sf), "surface_id", ["started_at", "run_id"], F.col("stored") > 1)
    return runs.groupBy("surface_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") >= 3).alias("unhealthy_runs"))


# Roll-ups


@query(f"WITH {views.ITEMS} SELECT count(*) FILTER (summary_status = 'pending') AS pending, count(*) FILTER (summary_status = 'complete') AS complete, count(*) FILTER (summary_status = 'failed') AS failed, count(*) AS total FROM items")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return health.status_counts(adapters.items(spark, sf), "summary_status", STATUSES)


@query(
    f"""WITH {views.ITEMS} SELECT CASE WHEN grouping(platform) = 1 THEN 'total' ELSE platform END AS platform, count(*) FILTER (summary_status = 'pending') AS pending,
  count(*) FILTER (summary_status = 'complete') AS complete, count(*) FILTER (summary_status = 'failed') AS failed, count(*) AS total FROM items GROUP BY ROLLUP (platform)"""
)
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return health.pivot_with_totals(adapters.items(spark, sf), "platform", "summary_status", STATUSES)


@query(f"WITH {views.ITEMS}, {views.REGIONS} SELECT CASE WHEN grouping(region_name) = 1 THEN 'all' ELSE region_name END AS region_name, CASE WHEN grouping(lang_group) = 1 THEN 'all' ELSE lang_group END AS lang_group, count(*) AS items FROM items JOIN regions USING (region_id) GROUP BY ROLLUP (region_name, lang_group)")
def rollup_totals(spark: SparkSession, sf: str) -> DataFrame:
    joined = adapters.items(spark, sf).join(F.broadcast(adapters.regions(spark, sf)), "region_id")
    rows = joined.rollup("region_name", "lang_group").agg(F.count(F.lit(1)).alias("items"), F.grouping("region_name").alias("a"), F.grouping("lang_group").alias("b"))
    return rows.select(F.when(F.col("a") == 1, "all").otherwise(F.col("region_name")).alias("region_name"), F.when(F.col("b") == 1, "all").otherwise(F.col("lang_group")).alias("lang_group"), "items")


@query(f"WITH {views.ITEMS} SELECT platform, count(*) AS items FROM items WHERE summary_status = 'pending' GROUP BY 1 ORDER BY 2 DESC, 1")
def platform_backlog(spark: SparkSession, sf: str) -> DataFrame:
    return health.by_platform(adapters.items(spark, sf).filter("summary_status = 'pending'")).orderBy(F.col("items").desc(), "platform")


@query(f"WITH {views.ITEMS}, c AS (SELECT platform, count(*) AS n FROM items GROUP BY 1) SELECT CAST(sum(least(n, 50)) AS BIGINT) AS wanted, count(*) * 50 AS ceiling, count(*) AS platforms FROM c")
def llm_budget(spark: SparkSession, sf: str) -> DataFrame:
    return health.llm_budget(adapters.items(spark, sf), 50)


@query(f"WITH {views.ITEMS} SELECT platform, count(DISTINCT surface_key) AS surfaces, count(DISTINCT lang_group) AS langs FROM items GROUP BY 1")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.items(spark, sf).groupBy("platform").agg(F.countDistinct("surface_key").alias("surfaces"), F.countDistinct("lang_group").alias("langs"))


@query(f"WITH {views.ITEMS}, {views.REGIONS} SELECT region_key, count(*) AS items FROM items JOIN regions USING (region_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_regions(spark: SparkSession, sf: str) -> DataFrame:
    joined = adapters.items(spark, sf).join(F.broadcast(adapters.regions(spark, sf)), "region_id")
    return joined.groupBy("region_key").agg(F.count(F.lit(1)).alias("items")).orderBy(F.col("items").desc(), "region_key").limit(10)


@query(f"WITH {views.ITEMS} SELECT count(*) FILTER (summary_status = 'complete') AS a, count(*) FILTER (coalesce(translation_status = 'complete', FALSE)) AS b, count(*) FILTER (summary_status = 'complete' AND translation_status = 'complete') AS both, count(*) FILTER (translation_status = 'complete' AND summary_status <> 'complete') AS b_only FROM items")
def dual_write_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = F.coalesce(F.col("translation_status") == "complete", F.lit(False))
    return health.overlap(adapters.items(spark, sf), F.col("summary_status") == "complete", b)


@query(f"WITH {views.ITEMS} SELECT lang_group, count(*) AS n FROM items WHERE lang_group NOT IN ('en', 'fr') GROUP BY 1")
def outside_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    return health.outside_list(adapters.items(spark, sf), "lang_group", ["en", "fr"])


@query(f"WITH {views.DERIVATIONS} SELECT target_locale, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM derivations GROUP BY 1")
def locale_status(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.derivations(spark, sf)
    return d.groupBy("target_locale").agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))


@query(
    f"""WITH {views.RUNS}, s AS (SELECT 'provider' || (surface_id % 3) AS provider, CASE WHEN arg_max(status, started_at) IS NOT NULL AND surface_id % 3 = 0 THEN 'available' ELSE 'unavailable_auth' END AS state FROM runs GROUP BY surface_id)
SELECT count(*) AS providers, count(*) FILTER (state = 'available') AS available, CASE WHEN count(*) FILTER (state = 'available') = 0 THEN 'stopped' WHEN count(*) FILTER (state = 'available') < count(*) THEN 'degraded' ELSE 'ok' END AS status FROM s"""
)
def provider_rollup(spark: SparkSession, sf: str) -> DataFrame:
    states = adapters.runs(spark, sf).select("surface_id").distinct().select(F.when(F.col("surface_id") % 3 == 0, "available").otherwise("unavailable_auth").alias("state"))
    return health.providers_rollup(states)


# Ranking and selection


@query(f"WITH {views.SCORED} SELECT platform, id, rn AS rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY hotness DESC NULLS LAST, id) AS rn FROM scored) WHERE rn <= 20")
def topk_per_platform(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.hottest(adapters.scored_items(spark, sf), "platform", 20).select("platform", "id", F.col("rank_in_group").cast("long").alias("rank_in_group"))


@query(f"WITH {views.SCORED} SELECT platform, id FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY coalesce(hotness, 0) DESC, id) AS rn FROM scored WHERE summary_status = 'pending') WHERE rn <= 15")
def pending_top(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.pending_top(adapters.scored_items(spark, sf).filter("summary_status = 'pending'"), 15).select("platform", "id")


@query(f"WITH {views.CUTOFFS} SELECT lang_group, round(cutoff, 4) AS cutoff FROM cutoffs")
def pctl_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.cutoffs(selection.in_window(adapters.scored_items(spark, sf), SETTINGS), 10).select("lang_group", F.round("cutoff", 4).alias("cutoff"))


@query(f"WITH {views.CUTOFFS} SELECT lang_group, pool, total, round(100.0 * pool / total, 2) AS pool_percent FROM pools")
def pool_size(spark: SparkSession, sf: str) -> DataFrame:
    recent = selection.in_window(adapters.scored_items(spark, sf), SETTINGS)
    return ranking.pool_sizes(recent, ranking.cutoffs(recent, 10))


@query(f"WITH {views.CUTOFFS} SELECT surface_key, lang_group FROM langs")
def dominant_lang(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.dominant(selection.in_window(adapters.scored_items(spark, sf), SETTINGS), "surface_key", "lang_group").drop("n")


@query(f"WITH {views.CUTOFFS} SELECT surface_key, floor_rows AS floor, cap_rows AS cap FROM limits")
def surface_limits(spark: SparkSession, sf: str) -> DataFrame:
    return selection.surface_limits(adapters.surfaces(spark), adapters.scored_items(spark, sf), SETTINGS).select("surface_key", "floor", "cap")


@query(f"WITH {views.CUTOFFS} SELECT id, surface_key FROM pass1")
def select_floor(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.scored_items(spark, sf)
    limits = selection.surface_limits(adapters.surfaces(spark), items, SETTINGS)
    return selection.floor_pass(selection.eligible(items, "es"), limits, SETTINGS.batch_size).select("id", "surface_key")


@query(f"WITH {views.CUTOFFS} SELECT id, surface_key, 1 AS pass FROM pass1 UNION ALL SELECT id, surface_key, 2 AS pass FROM pass2")
def select_full(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_batch(adapters.scored_items(spark, sf), adapters.surfaces(spark), "es", SETTINGS)


@query(
    f"""WITH {views.SCORED}, c AS (SELECT lang_group, count(*) AS total, count(*) FILTER (summary_status = 'complete') AS done, greatest(1, CAST(floor(count(*) * 10 / 100.0) AS BIGINT)) AS target FROM scored WHERE hotness IS NOT NULL GROUP BY 1)
SELECT lang_group, total, done, target, greatest(0, target - done) AS needed, CASE WHEN done >= target THEN 'filled' WHEN done > 0 THEN 'partial' ELSE 'empty' END AS status FROM c"""
)
def quota_status(spark: SparkSession, sf: str) -> DataFrame:
    return selection.quota_status(adapters.scored_items(spark, sf), 10)


@query(f"WITH {views.SCORED}, r AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY hotness DESC NULLS LAST, id) AS rn, count(*) OVER () AS n FROM scored) SELECT id, bucket FROM r WHERE rn <= floor(n * 10 / 100.0)")
def bucket_cap(spark: SparkSession, sf: str) -> DataFrame:
    return selection.bucket_cap(adapters.scored_items(spark, sf), 10.0).select("id", "bucket")


@query()
def summary_preselect(spark: SparkSession, sf: str) -> DataFrame:
    found = selection.summary_preselect(adapters.scored_items(spark, sf), adapters.surfaces(spark), SETTINGS, ["en", "fr", "de", "es"], limit=60, extra=10)
    return found.select("id", "surface_key", "lang_group")


# Topics, regions, languages


_TOPIC_SQL = f"""WITH {views.SCORED}, t AS (SELECT *, regexp_replace(trim(title) || CASE WHEN description <> '' THEN ' ' || substr(description, 1, 300) ELSE '' END, '[^\\x00-\\x7F]', '0', 'g') AS body FROM scored),
k AS (SELECT *, CASE WHEN regexp_matches(body, '(?i)\\b(thand|wh)\\b') THEN 'ai' WHEN regexp_matches(body, '(?i)\\b(the|der)\\b') THEN 'politics'
  WHEN regexp_matches(body, '(?i)\\b(est|de la)\\b') THEN 'science' WHEN regexp_matches(body, '(?i)\\b(ing|oro)\\b') THEN 'sports' END AS kw FROM t),
w AS (SELECT *, CASE bucket WHEN 'category_tech' THEN 'technology' WHEN 'category_ai' THEN 'ai' WHEN 'world_news' THEN 'world' END AS by_bucket,
  CASE platform WHEN 'p3' THEN 'business' END AS by_platform FROM k),
c AS (SELECT *, coalesce(by_bucket, by_platform, kw) AS topic, CASE WHEN by_bucket IS NOT NULL THEN 'bucket' WHEN by_platform IS NOT NULL THEN 'platform' WHEN kw IS NOT NULL THEN 'keyword' END AS signal,
  CASE WHEN by_bucket IS NOT NULL OR by_platform IS NOT NULL THEN 'high' WHEN kw IS NOT NULL THEN 'medium' ELSE 'none' END AS tier FROM w)"""


@query(_TOPIC_SQL + " SELECT id, topic, signal, tier FROM c")
def topic_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return topics.waterfall(adapters.scored_items(spark, sf), VOCABULARY, platforms={"p3": "business"}).select("id", "topic", "signal", "tier")


@query(
    _TOPIC_SQL
    + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY hotness DESC NULLS LAST, id) AS rn FROM c WHERE summary_status = 'pending') WHERE rn <= 60),
a AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY coalesce(hotness, 0) DESC, id) <= 30 AS asked, CASE WHEN id % 2 = 0 THEN 'society' END AS answer FROM f),
l AS (SELECT *, tier IN ('low', 'none') AND asked AND answer IS NOT NULL AS by_llm FROM a)
SELECT id, CASE WHEN by_llm THEN answer ELSE topic END AS story_category, CASE WHEN by_llm THEN 'llm' ELSE signal END AS classified_by,
  CASE WHEN by_llm THEN 'llm_complete' WHEN topic IS NOT NULL THEN 'heuristic_complete' ELSE 'failed' END AS classification_state, CASE WHEN by_llm OR topic IS NOT NULL THEN 'v1:0' END AS classification_version FROM l"""
)
def topic_state_cycle(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.scored_items(spark, sf).withColumn("classification_state", F.col("summary_status"))
    answers = items.filter("id % 2 = 0").select("id", F.lit("society").alias("answer"))
    return topics.cycle(items, VOCABULARY, answers, "v1:0", top=60, llm_top=30, platforms={"p3": "business"})


@query(
    f"""WITH {views.ITEMS}, s AS (SELECT id, CASE WHEN id % 4 <> 0 THEN 'v' || (id % 3) END AS classification_version, CASE id % 5 WHEN 0 THEN 'llm' WHEN 1 THEN NULL ELSE 'keyword' END AS classified_by, summary_status AS state FROM items)
SELECT id, CASE WHEN classification_version IS DISTINCT FROM 'v1' AND classified_by IS DISTINCT FROM 'llm' AND state IS DISTINCT FROM 'pending' THEN 'pending' ELSE state END AS classification_state FROM s"""
)
def requeue_stale(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.items(spark, sf).select(
        "id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("v"), F.col("id") % 3)).alias("classification_version"),
        F.when(F.col("id") % 5 == 0, "llm").when(F.col("id") % 5 == 1, F.lit(None)).otherwise("keyword").alias("classified_by"), F.col("summary_status").alias("classification_state"),
    )
    return topics.requeue_stale(items, "v1").select("id", "classification_state")


@query(
    """WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'llm' END AS who, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['tech', 'ai'] WHEN 2 THEN ['health'] ELSE ['finance', 'sports'] END AS tags FROM documents),
c AS (SELECT *, CASE len(tags) WHEN 0 THEN NULL ELSE CASE tags[1] WHEN 'tech' THEN 'ai' WHEN 'health' THEN 'society' ELSE 'business' END END AS cat FROM s)
SELECT id, CASE WHEN who = 'llm' AND cat IS NOT NULL THEN 'llm_complete' WHEN who = 'llm' THEN 'failed' ELSE 'pending' END AS classification_state, CASE WHEN who = 'llm' THEN cat END AS story_category FROM c"""
)
def backfill_state(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    tags = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).when(F.col("id") % 4 == 1, F.array(F.lit("tech"), F.lit("ai"))).when(F.col("id") % 4 == 2, F.array(F.lit("health"))).otherwise(F.array(F.lit("finance"), F.lit("sports")))
    rows = ids.withColumn("topic_tags", tags).withColumn("classified_by", F.when(F.col("id") % 3 == 0, "llm"))
    return topics.backfill_state(rows)


_REGION_SQL = f"""WITH {views.SCORED}, r AS (SELECT *, list_sort(list_distinct(list_filter([CASE surface_key WHEN 'src3' THEN 'jp' WHEN 'src4' THEN 'kr' END,
  CASE WHEN regexp_matches(title, '(?i)the') THEN 'us' END, CASE WHEN regexp_matches(title, '(?i)der |ung') THEN 'de' END, CASE WHEN regexp_matches(title, '(?i)eau|ent') THEN 'fr' END,
  CASE WHEN regexp_matches(title, '(?i)ció') THEN 'es' END], lambda x: x IS NOT NULL))) AS found FROM scored)"""


@query(_REGION_SQL + " SELECT id, array_to_string(found, ',') AS content_regions, coalesce(list_filter(found, lambda x: x <> 'us')[1], found[1]) AS primary_region FROM r")
def region_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    rows = regions.classified(adapters.scored_items(spark, sf), REGION_TERMS, REGION_SURFACES)
    return rows.select("id", F.array_join("content_regions", ",").alias("content_regions"), "primary_region")


@query(
    _REGION_SQL
    + """, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY hotness DESC NULLS LAST, id) AS rn FROM r) WHERE rn <= 80),
o AS (SELECT *, CASE WHEN len(found) = 0 THEN row_number() OVER (PARTITION BY platform, len(found) = 0 ORDER BY hotness DESC NULLS LAST, id) END AS place FROM t)
SELECT id, CASE WHEN len(found) > 0 THEN array_to_string(found, ',') WHEN place <= 5 AND id % 2 = 0 THEN 'br,us' ELSE '' END AS content_regions, CASE WHEN len(found) > 0 THEN 'heuristic' WHEN place <= 5 AND id % 2 = 0 THEN 'llm' ELSE 'skipped' END AS method FROM o"""
)
def region_cycle(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.scored_items(spark, sf)
    answers = items.filter("id % 2 = 0").select("id", F.array(F.lit("us"), F.lit("br")).alias("regions"))
    found = regions.cycle(items, answers, top=80, llm_top=5, terms=REGION_TERMS, surfaces=REGION_SURFACES)
    return found.select("id", F.array_join("content_regions", ",").alias("content_regions"), "method")


@query(
    """WITH l AS (SELECT doc_id, lang || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_us' ELSE '-Latn-XX' END AS locale FROM documents)
SELECT doc_id, CASE WHEN lower(replace(locale, '_', '-')) = 'en' THEN 'en-US' WHEN doc_id % 3 = 1 THEN split_part(locale, '_', 1) || '-US' ELSE locale END AS locale, split_part(replace(locale, '_', '-'), '-', 1) AS lang_group FROM l"""
)
def locale_group(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "_us").otherwise("-Latn-XX")
    rows = read(spark, sf, "documents").select("doc_id", F.concat("lang", suffix).alias("raw"))
    return rows.select("doc_id", languages.normalized_locale(F.col("raw")).alias("locale"), languages.lang_group(F.col("raw")).alias("lang_group"))


_GRAMS = """letters AS (SELECT doc_id AS id, lang, string_split(trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')), ' ') AS ws FROM documents),
pairs AS (SELECT id, lang, unnest(ws) AS w, unnest(list_concat(ws[2:], [''])) AS following FROM letters),
pieces AS (SELECT id, lang, ' ' || w || ' ' || substr(following, 1, 1) AS t FROM pairs WHERE w <> ''),
grams AS (SELECT id, lang, substr(t, p, 3) AS gram FROM (SELECT *, unnest(range(1, length(t) - 1)) AS p FROM pieces)),
known AS (SELECT lang, gram, count(*) AS n FROM grams WHERE id % 3 <> 1 AND lang IS NOT NULL GROUP BY 1, 2),
chosen AS (SELECT gram FROM known GROUP BY 1 ORDER BY sum(n) DESC, gram LIMIT 50000),
sums AS (SELECT lang, sum(n) AS total, (SELECT count(*) FROM chosen) AS v FROM known JOIN chosen USING (gram) GROUP BY 1),
shares AS (SELECT lang, count(*) / (SELECT count(*) FROM documents WHERE doc_id % 3 <> 1 AND lang IS NOT NULL) AS share FROM documents WHERE doc_id % 3 <> 1 AND lang IS NOT NULL GROUP BY 1),
found AS (SELECT id, gram, count(*) AS times FROM grams JOIN chosen USING (gram) GROUP BY 1, 2),
scored AS (SELECT f.id, s.lang AS code, sum(times * ln((coalesce(k.n, 0) + 0.5) / (total + 0.5 * v))) + max(ln(share)) AS score
  FROM found f CROSS JOIN sums s LEFT JOIN known k ON k.gram = f.gram AND k.lang = s.lang JOIN shares h ON h.lang = s.lang GROUP BY 1, 2),
detected AS (SELECT id, code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS rn FROM scored) WHERE rn = 1)"""


def _language_model(spark: SparkSession, sf: str) -> language_model.Model:
    """Fitted on the documents whose id leaves no remainder of 1 by 3; the others are held out."""
    return language_model.fit(read(spark, sf, "documents").filter("doc_id % 3 <> 1"))


@query(
    f"""WITH {_GRAMS} SELECT d.doc_id AS id, coalesce(code, 'en') AS base_lang, CASE coalesce(code, 'en') WHEN 'en' THEN 'en-US' WHEN 'de' THEN 'de-DE' WHEN 'fr' THEN 'fr-FR' WHEN 'es' THEN 'es-ES' WHEN 'zh' THEN 'zh-Hans' ELSE code || '-' || upper(code) END AS locale, coalesce(code, 'en') AS lang_group
FROM documents d LEFT JOIN detected ON d.doc_id = detected.id"""
)
def language_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Base language, locale and group of every item, by the trigram model; texts without letters have the region's language."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    found = language_model.detected(docs, _language_model(spark, sf), F.col("text"))
    # texts end here: the join is one of ids
    items = docs.select("id").withColumns({"original_locale": F.lit(None).cast("string"), "default_locale": F.lit("en-US")})
    joined = items.join(found, "id", "left")
    return languages.classified(joined, F.coalesce("detected", F.lit("en"))).select("id", "base_lang", "locale", "lang_group")


@query(
    f"""WITH {_GRAMS} SELECT d.lang, count(*) AS n, count(*) FILTER (code = d.lang) AS n_right, round(count(*) FILTER (code = d.lang) / count(*), 6) AS accuracy
FROM documents d LEFT JOIN detected ON d.doc_id = detected.id WHERE d.doc_id % 3 = 1 AND d.lang IS NOT NULL GROUP BY 1"""
)
def language_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out accuracy of the trigram model by language."""
    docs = read(spark, sf, "documents").filter("doc_id % 3 = 1 and lang is not null")
    found = language_model.detected(docs, _language_model(spark, sf), F.col("text"), "doc_id")
    right = F.count_if(F.col("detected") == F.col("lang"))
    n = F.count(F.lit(1))
    return docs.select("doc_id", "lang").join(found, "doc_id", "left").groupBy("lang").agg(n.alias("n"), right.alias("n_right"), F.round(right / n, 6).alias("accuracy"))


@query(
    f"""WITH {views.REQUESTS}, r AS (SELECT request_id, request_id % 7 AS k, ts FROM requests), e AS (SELECT event_id % 7 AS k, ts AS validated_at, max({{'x': ts + to_hours(1 + CAST(event_id % 5 AS INTEGER)), 'tag': CASE WHEN event_id % 3 > 0 THEN 'e' || event_id END}}) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT request_id, CASE WHEN e.k IS NULL THEN 'miss' WHEN m.x > r.ts THEN 'fresh' WHEN m.tag IS NOT NULL THEN 'revalidate' ELSE 'miss' END AS cache FROM r ASOF LEFT JOIN e ON r.k = e.k AND r.ts >= e.validated_at"""
)
def cache_states(spark: SparkSession, sf: str) -> DataFrame:
    """What the cache held of a request's page at its time: the last validation at or before it."""
    requests = adapters.requests(spark, sf).select("request_id", (F.col("request_id") % 7).alias("url_hash"), "ts")
    i = F.col("event_id")
    bought = read(spark, sf, "events").filter("event_type = 'purchase'")
    hours = F.make_dt_interval(hours=(1 + i % 5).cast("int"))
    held = bought.select((i % 7).alias("url_hash"), F.col("ts").alias("validated_at"), (F.col("ts") + hours).alias("expires_at"), F.when(i % 3 > 0, F.concat(F.lit("e"), i)).alias("etag"))
    return policy.cached_response(requests, held).select("request_id", "cache")


@query(
    """WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '0', 'g') AS b FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(b, '(?i)\\b(the|der)\\b') THEN 'politics' END, CASE WHEN regexp_matches(b, '(?i)\\b(est|de la)\\b') THEN 'science' END,
  CASE WHEN regexp_matches(b, '(?i)\\b(ing|oro)\\b') THEN 'sports' END, CASE WHEN regexp_matches(b, '(?i)\\b(thand|wh)\\b') THEN 'ai' END], lambda x: x IS NOT NULL), ',') AS topics FROM t"""
)
def automaton_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Categories whose keywords occur anywhere in a text, all found in one pass."""
    found = automaton.matched(read(spark, sf, "documents").select("doc_id", "text"), F.col("text"), VOCABULARY)
    return found.select("doc_id", F.array_join("topics", ",").alias("topics"))


@query(
    f"""WITH {views.ITEMS}, t AS (SELECT id, k, CASE summary_status WHEN 'complete' THEN 'llm' WHEN 'failed' THEN 'heuristic' END AS classified_by, id % 5 > 0 AS at_some_time, id % 96 + id % 7 AS waited FROM items)
SELECT id, CASE k % 4 WHEN 0 THEN 'ai' WHEN 1 THEN 'society' END AS category,
  CASE WHEN classified_by = 'llm' THEN 'llm_complete' WHEN NOT at_some_time THEN 'pending' WHEN classified_by = 'heuristic' THEN CASE WHEN k % 4 < 2 THEN 'heuristic_complete' ELSE 'failed' END ELSE 'heuristic_complete' END AS state, waited >= 1 AS due FROM t"""
)
def state_rules(spark: SparkSession, sf: str) -> DataFrame:
    """States that backfilling gives first, categories of tags, and whether a retry is due."""
    some = F.array(F.lit("tech"), F.lit("unknown"), F.lit("ai"))
    tags = F.when(F.col("k") % 4 == 0, some).when(F.col("k") % 4 == 1, F.array(F.lit("health"))).when(F.col("k") % 4 == 2, F.array().cast("array<string>"))
    items = adapters.items(spark, sf).withColumns({
        "topic_tags": tags, "classified_by": F.when(F.col("summary_status") == "complete", "llm").when(F.col("summary_status") == "failed", "heuristic"), "topic_classified_at": F.when(F.col("id") % 5 > 0, F.col("collected_at")),
    })
    return items.select("id", topics.tag_category(F.col("topic_tags")).alias("category"), topics.heuristic_state(items).alias("state"), statuses.retry_due(F.col("published_at"), now()).alias("due"))


@query(
    """SELECT source AS topic, CASE WHEN doc_id % 3 = 2 THEN 'é' ELSE '' END || 'term ' || doc_id AS term, CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN lang ELSE 'zh' END AS lang,
  CASE WHEN doc_id % 3 = 1 THEN doc_id ELSE 1 END AS score, CASE WHEN doc_id % 3 = 2 THEN '2024-01-05' ELSE '2024-01-31' END AS last_seen FROM documents"""
)
def keyword_file(spark: SparkSession, sf: str) -> DataFrame:
    """Records of keyword files in their three shapes, read, written as a file has them, and read again."""
    i = F.col("doc_id")
    term = F.concat(F.when(i % 3 == 2, "é").otherwise(""), F.lit("term "), i)
    plain = F.concat(F.lit('"'), term, F.lit('"'))
    entry = F.when(i % 3 == 0, plain).when(i % 3 == 1, F.to_json(F.struct(term.alias("keyword"), "lang", i.alias("score")))).otherwise(F.to_json(F.struct(term.alias("term"), F.lit("2024-01-05").alias("last_seen"))))
    rows = keywords.learned(read(spark, sf, "documents").select(F.col("source").alias("topic"), entry.alias("entry")), F.to_date(now()))
    again = keywords.grouped_file(rows).select("topic", F.explode("keywords").alias("k")).select("topic", F.to_json("k").alias("entry"))
    return keywords.learned(again, F.to_date(now())).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


# Segmentation


#: Letters of a text in lower case, without anything between them: the fixture's texts as a script without spaces.
_LETTERS = r"\p{Ll}+"


def _unspaced(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"\P{Ll}+", "").alias("text"))


@query()
def learned_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents' letters without spaces, by cohesion and branching entropy."""
    return segmentation.learn(_unspaced(spark, sf), pattern=_LETTERS).select("word", "n", F.round("cohesion", 6).alias("cohesion"), F.round("entropy", 6).alias("entropy"))


@query()
def segmented_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest words of every text without spaces: their number, and the different ones of two letters or more."""
    docs = _unspaced(spark, sf)
    found = segmentation.segmented(docs, segmentation.learn(docs, pattern=_LETTERS), key="doc_id", pattern=_LETTERS)
    return found.select("doc_id", F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("split_sha256"), F.size(segmentation.entities(F.col("words"))).cast("long").alias("n_entities"))


# Entities and keywords


_ENTITY_SQL = """WITH t AS (SELECT doc_id AS id, regexp_replace(text, '[^\\x00-\\x7F]', '0', 'g') AS title, source FROM documents),
e AS (SELECT id, source, unnest(list_distinct(list_concat(regexp_extract_all(title, '\\b[A-Z]{2,6}\\b'), regexp_extract_all(title, '\\b(?:[A-Z][a-z]+\\s){1,3}[A-Z][a-z]+\\b'),
  regexp_extract_all(title, '\\b([A-Z][a-z]*(?:[A-Z][a-z]*)*[a-z]+)\\s+(?:said|announced|reported|reports|unveiled|banned|launched|warned|pledged|signed|approved|filed|sued|wins|loses|beats|misses|cuts|raises|faces)\\b', 1),
  regexp_extract_all(title, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b')))) AS term FROM t),
f AS (SELECT * FROM e WHERE length(term) >= 2 AND term NOT IN (%s))""" % ", ".join(f"'{w}'" for w in keywords.ENGLISH_STOP)


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """English rules over whole texts; the SQL has a digit for every other letter, as its \\b knows ASCII alone."""
    docs = read(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.lit("en").alias("lang"), keywords.english_entities(F.col("text")).alias("entities"))


@query(_ENTITY_SQL + " SELECT id, term FROM f")
def entity_english(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf).select("id", F.explode("entities").alias("term"))


@query(
    _ENTITY_SQL
    + """, c AS (SELECT term, source AS topic, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY term) AS total, row_number() OVER (PARTITION BY term ORDER BY n DESC, topic) AS rn FROM c)
SELECT term, topic, CAST(total AS BIGINT) AS total, round(n / total, 3) AS purity FROM r WHERE rn = 1 AND total >= 2 AND n / total >= 0.5"""
)
def keyword_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.candidates(_entities(spark, sf), 2, 0.5).select("term", "topic", "total", "purity")


@query(
    _ENTITY_SQL
    + f""", c AS (SELECT term, count(*) AS n FROM f GROUP BY 1) SELECT term, length(term) >= 3 AND n >= 2 AND lower(term) NOT IN ({", ".join(f"'{w}'" for w in keywords.KEYWORD_STOP)})
  AND regexp_matches(term, '(^| )[A-Z]') AS ok FROM c"""
)
def keyword_valid(spark: SparkSession, sf: str) -> DataFrame:
    counts = _entities(spark, sf).select(F.explode("entities").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("term", keywords.valid(F.col("term"), F.col("n"), F.lit("en")).alias("ok"))


_KEYWORD_TABLES = """WITH old AS (SELECT source AS topic, lang AS term, 'en' AS lang, count(*) AS score, DATE '2024-01-31' - CAST(min(doc_id) % 97 AS INTEGER) AS last_seen FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1, 2),
new AS (SELECT source AS topic, lang AS term, 'en' AS lang, count(*) AS score FROM documents ANTI JOIN labels USING (doc_id) GROUP BY 1, 2)"""


def _keyword_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf, "documents").select(F.col("source").alias("topic"), F.col("lang").alias("term"), F.lit("en").alias("lang"), "doc_id")
    labels = read(spark, sf, "labels").select("doc_id")
    old = docs.join(labels, "doc_id", "left_semi").groupBy("topic", "term", "lang").agg(F.count(F.lit(1)).alias("score"), F.date_sub(F.lit("2024-01-31").cast("date"), (F.min("doc_id") % 97).cast("int")).alias("last_seen"))
    new = docs.join(labels, "doc_id", "left_anti").groupBy("topic", "term", "lang").agg(F.count(F.lit(1)).alias("score"))
    return old, new


@query(
    _KEYWORD_TABLES
    + """, m AS (SELECT topic, term, coalesce(o.score, 0) + coalesce(n.score, 0) AS score, CASE WHEN n.score IS NOT NULL THEN DATE '2024-01-31' ELSE last_seen END AS seen FROM old o FULL OUTER JOIN new n USING (topic, term, lang))
SELECT topic, term, score, strftime(seen, '%Y-%m-%d') AS last_seen FROM m WHERE date_diff('day', seen, DATE '2024-01-31') <= CASE WHEN score >= 10 THEN 90 ELSE 30 END"""
)
def keyword_merge_expire(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _keyword_tables(spark, sf)
    out = keywords.merged(old, new, F.lit("2024-01-31").cast("date"))
    return out.select("topic", "term", "score", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


@query(
    _KEYWORD_TABLES
    + """, d AS (SELECT topic, term, o.score AS old_score, n.score AS new_score, CASE WHEN o.score IS NULL THEN 'added' WHEN n.score IS NULL THEN 'removed' WHEN o.score <> n.score THEN 'changed' END AS change FROM old o FULL OUTER JOIN new n USING (topic, term, lang))
SELECT topic, term, old_score, new_score, change FROM d WHERE change IS NOT NULL"""
)
def keyword_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _keyword_tables(spark, sf)
    return keywords.diff(old, new).drop("lang")


# URLs, HTML, scalars


@query("SELECT page_id, split_part(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), ':', 1) AS domain FROM pages")
def url_domain(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query(
    """WITH u AS (SELECT page_id, url || '?b=2&utm_source=x&a=' || page_id || '&B=#top' AS url FROM pages)
SELECT page_id, sha256(lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) || '?B=&a=' || page_id || '&b=2') AS hash FROM u"""
)
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("?b=2&utm_source=x&a="), F.col("page_id"), F.lit("&B=#top"))
    return read(spark, sf, "pages").select("page_id", urls.url_hash(tail).alias("hash"))


def _undressed_sql(c: str) -> str:
    """Text without tags, scripts and comments, in SQL: entities as characters, & last."""
    c = f"regexp_replace(coalesce({c}, ''), '(?s)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<[^>]+>', ' ', 'g')"
    for entity, char in [*((e, x) for e, x in text.COMMENT_ENTITIES.items() if e != "&amp;"), ("&#39;", "'"), ("&amp;", "&")]:
        c = "replace({}, '{}', '{}')".format(c, entity, char.replace("'", "''"))
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_ANCHOR_SQL = """'(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>'"""


@query(
    f"""SELECT page_id, CAST(p AS INTEGER) AS pos, href, {_undressed_sql('inner_html')} AS text FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {_ANCHOR_SQL}, 1)) AS href, unnest(regexp_extract_all(html, {_ANCHOR_SQL}, 2)) AS inner_html, unnest(range(0, len(regexp_extract_all(html, {_ANCHOR_SQL}, 1)))) AS p FROM pages)"""
)
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return html_sources.links(read(spark, sf, "pages"))


@query(f"""SELECT page_id, {_undressed_sql('html')} AS text, {_undressed_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages""")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", text.without_tags(F.col("html")).alias("text"), html_sources.page_title(F.col("html")).alias("title"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace('<p>' || text || '</p>&gt;x', '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS raw FROM conversations".replace("AS raw", "AS cleaned").replace("trim(", "replace(trim(").replace("'g'))", "'g')), '&gt;', '>')"))
def comment_strip(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>&gt;x"))
    return read(spark, sf, "conversations").select("conv_id", "turn", text.comment_text(raw).alias("cleaned"))


@query(
    """SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN doc_id * 10000 WHEN 1 THEN doc_id * 100000000 ELSE doc_id END AS BIGINT) AS score, CASE WHEN doc_id % 2 = 0 THEN doc_id * 1000 ELSE doc_id END AS stars FROM documents"""
)
def cjk_number(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.when(F.col("doc_id") % 3 == 0, "万").when(F.col("doc_id") % 3 == 1, "亿").otherwise("热度")
    return read(spark, sf, "documents").select(
        "doc_id", numbers.cjk_number(F.concat("doc_id", unit)).alias("score"),
        numbers.abbreviated_number(F.concat(F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "k").otherwise(" stars today"))).alias("stars"),
    )


@query(
    f"""WITH {views.ITEMS} SELECT id, CASE WHEN views * 1000 >= 1000000 THEN printf('%.1fM', views * 1000 / 1000000.0) WHEN views * 1000 >= 1000 THEN printf('%.1fK', views * 1000 / 1000.0) ELSE CAST(views * 1000 AS VARCHAR) END AS shown,
  CASE WHEN length(title) > 50 THEN substr(title, 1, 50) || '...' ELSE title END AS snippet, strftime(date_trunc('hour', collected_at), '%Y-%m-%d-%H') AS hour_key, CAST(id // 20 AS INTEGER) AS batch FROM items"""
)
def labels_and_keys(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.items(spark, sf)
    return items.select("id", text.short_number(F.col("views") * 1000).alias("shown"), text.snippet(F.col("title"), 50).alias("snippet"), times.hour_key(F.col("collected_at")).alias("hour_key"), batch_number(F.col("id") + 1, 20).alias("batch"))


# Requests, policy


@query(f"WITH {views.HOURS} SELECT domain, strftime(hour, '%Y-%m-%d-%H') AS hour, requests_2xx, requests_4xx, requests_5xx, requests_429, requests_403, round(latency_mean, 6) AS latency_mean FROM hours")
def domain_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return health.domain_hours(adapters.requests(spark, sf)).withColumn("hour", times.hour_key(F.col("hour"))).withColumn("latency_mean", F.round("latency_mean", 6))


@query(
    f"""WITH {views.HOURS}, s AS (SELECT domain, CAST(sum(requests_2xx) AS BIGINT) AS requests_2xx, CAST(sum(requests_4xx) AS BIGINT) AS requests_4xx, CAST(sum(requests_5xx) AS BIGINT) AS requests_5xx, CAST(sum(requests_429) AS BIGINT) AS requests_429,
  CAST(sum(requests_403) AS BIGINT) AS requests_403, CAST(floor(avg(latency_mean)) AS BIGINT) AS latency_mean FROM hours WHERE hour >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1)
SELECT *, requests_2xx + requests_4xx + requests_5xx AS total, round(100.0 * requests_2xx / (requests_2xx + requests_4xx + requests_5xx), 2) AS success_rate FROM s"""
)
def domain_report(spark: SparkSession, sf: str) -> DataFrame:
    return health.domain_report(health.domain_hours(adapters.requests(spark, sf)), F.lit("2024-01-24 00:00:00").cast("timestamp"))


@query(f"WITH {views.REQUESTS} SELECT domain, strftime(date_trunc('hour', ts), '%Y-%m-%d-%H') AS hour, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, count(*) AS n FROM requests GROUP BY 1, 2")
def latency_true_pctl(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.true_percentiles(adapters.requests(spark, sf))
    return rows.select("domain", times.hour_key(F.col("hour")).alias("hour"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


@query(
    f"""WITH {views.REQUESTS}, w AS (SELECT request_id, domain, count(*) OVER (PARTITION BY domain ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM requests)
SELECT request_id, domain, in_window FROM w WHERE in_window > 2"""
)
def rate_violations(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.sliding_counts(adapters.requests(spark, sf), "domain", "ts", 3600).filter("in_window > 2").select("request_id", "domain", "in_window")


@query(f"WITH {views.REQUESTS} SELECT domain, strftime(max(ts) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS hits FROM requests WHERE status IN (429, 403) GROUP BY 1")
def penalty_windows(spark: SparkSession, sf: str) -> DataFrame:
    return policy.penalties(adapters.requests(spark, sf)).withColumn("until", _stamp("until"))


@query(
    f"""WITH {views.REQUESTS}, a AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY request_id) % 4 + 1 AS attempt FROM requests)
SELECT request_id, CASE WHEN status >= 200 AND status < 400 THEN 'done' WHEN status = 429 OR status >= 500 THEN CASE WHEN attempt < 3 THEN 'retry' ELSE 'give_up' END ELSE 'stop' END AS action FROM a"""
)
def retry_replay(spark: SparkSession, sf: str) -> DataFrame:
    attempt = F.row_number().over(Window.partitionBy("domain").orderBy("request_id")) % 4 + 1
    return policy.retry_action(adapters.requests(spark, sf).withColumn("attempt", attempt)).select("request_id", "action")


@query()
def circuit_replay(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("status") == 200, "success").when(F.col("status") == 429, "rate_limit").otherwise("other")
    log = adapters.requests(spark, sf).select("domain", F.unix_timestamp("ts").alias("seconds"), "request_id", outcome.alias("outcome"))
    return policy.replay_breaker(log, threshold=2, cooldown=3600)


@query()
def budget_replay(spark: SparkSession, sf: str) -> DataFrame:
    log = adapters.requests(spark, sf).select("domain", times.hour_key(F.col("ts")).alias("hour"), "request_id", (F.col("request_id") % 2 == 0).alias("simulated"))
    return policy.replay_budget(log, base=1)


@query(
    f"""WITH {views.REQUESTS}, r AS (SELECT domain, request_id, {{'n': CAST(1 AS BIGINT), 'm': CAST(floor(latency) AS BIGINT)}} AS x FROM requests),
l AS (SELECT domain, request_id, list(x) OVER (PARTITION BY domain ORDER BY request_id ROWS UNBOUNDED PRECEDING) AS xs FROM r),
f AS (SELECT domain, request_id, list_reduce(xs, lambda a, b: {{'n': a.n + 1, 'm': (a.m * a.n + b.m) // (a.n + 1)}}) AS s FROM l)
SELECT domain, request_id, s.n AS n, s.m AS mean FROM f"""
)
def latency_running_mean(spark: SparkSession, sf: str) -> DataFrame:
    log = adapters.requests(spark, sf).select("domain", "request_id", F.floor("latency").alias("latency"))
    return policy.running_mean(log, "domain", ["request_id"], "latency")


@query(
    f"""WITH {views.REQUESTS} SELECT request_id, CASE status WHEN 429 THEN 'unavailable_rate_limit' WHEN 503 THEN CASE WHEN request_id % 2 = 0 THEN 'unavailable_funds' ELSE 'unavailable_transient' END ELSE 'unavailable_transient' END AS state FROM requests WHERE status <> 200"""
)
def provider_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.requests(spark, sf).filter("status <> 200")
    code = F.when((F.col("status") == 503) & (F.col("request_id") % 2 == 0), "insufficient_quota")
    return rows.select("request_id", health.provider_state(F.col("status"), code).alias("state"))


# Tables and vectors


@query(f"WITH {views.ITEMS} SELECT (SELECT count(*) FROM items WHERE collected_at < TIMESTAMP '2024-01-29 00:00:00') AS items, (SELECT count(*) FROM conversations JOIN items ON conv_id = id WHERE collected_at < TIMESTAMP '2024-01-29 00:00:00') AS derivations")
def retention_split(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.items(spark, sf)
    return tables.retention_counts(items, {"derivations": (adapters.derivations(spark, sf), "item_id")}, "collected_at", now(), 2)


@query(
    f"""WITH {views.DERIVATIONS}, c AS (SELECT item_id, derivation_type, target_locale, status, created_order, row_number() OVER (PARTITION BY item_id, derivation_type, target_locale ORDER BY created_order DESC) AS rn FROM derivations)
SELECT item_id, derivation_type, target_locale, created_order, status FROM c WHERE rn = 1"""
)
def upsert_derivation(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.derivations(spark, sf).select("item_id", "derivation_type", "target_locale", "created_order", "status")
    keys = ["item_id", "derivation_type", "target_locale"]
    first = d.filter("created_order < 3")
    current = ranking.top_per_group(first.withColumn("k", F.concat_ws("|", *keys)), "k", 1, [F.col("created_order").desc()]).drop("k", "rank_in_group")
    return tables.upserted(current, d.filter("created_order >= 3"), keys, "created_order")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def anti_needing_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return tables.missing_child(read(spark, sf, "documents").select(F.col("doc_id").alias("id")), read(spark, sf, "embeddings"), "vec_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def l2_norm(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.round(tables.norm(F.col("embedding")), 6).alias("norm"))


@query(
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: (v.e[i] / v.n) * (q.e[i] / q.n))), 6) AS cosine FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10"""
)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    return tables.cosine_top(vectors, vectors.filter("vec_id % 50 = 0"), 10)


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'b' WHEN b.id IS NULL THEN 'a' ELSE 'both' END AS side FROM (SELECT doc_id AS id FROM labels) a FULL OUTER JOIN (SELECT DISTINCT conv_id AS id FROM conversations) b ON a.id = b.id")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return tables.full_diff(read(spark, sf, "labels").select(F.col("doc_id").alias("id")), read(spark, sf, "conversations").select(F.col("conv_id").alias("id")), "id")


@query(f"WITH {views.ITEMS} SELECT id FROM items WHERE id > 123 ORDER BY id LIMIT 40")
def keyset_batch(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keyset_batch(adapters.items(spark, sf), 123, 40).select("id")
