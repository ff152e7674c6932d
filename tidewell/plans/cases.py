"""Queries over tables of cases: rules of texts, URLs, times, numbers, arrays, locales, statuses and collectors.

Cases are made from the fixture tables by arithmetic on ids, so that every rule meets all of its
branches; the SQL states each result on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import collections, numbers, text, times, urls
from tidewell.lineage import cut
from tidewell.operators import feed, health, keywords, languages, latent, selection, statuses, tables, topics
from tidewell.plans import views
from tidewell.plans.catalogue import query
from tidewell.sources import adapters, sinks
from tidewell.sources.adapters import now, read

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _pick(key: str, *values) -> F.Column:
    """One of the values, by a column's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql_pick(key: str, *values) -> str:
    shown = ", ".join("NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{shown}][{key} % {len(values)} + 1]"


@query(
    """SELECT doc_id, substr(text, 1, 200) AS head, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed,
  CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS snip,
  sha256(substr(text, 1, 40) || '|' || '' || '|' || 'title' || '|' || lang) AS cache_key,
  'In ' || lang || ' from ' || source || ': ' || substr(text, 1, 10) || '/' AS filled FROM documents"""
)
def text_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    filled = text.template("In {lang} from {source}: {start}/{none}", {"lang": F.col("lang"), "source": F.col("source"), "start": F.substring(t, 1, 10), "none": F.lit(None)})
    key = text.translation_key(F.substring(t, 1, 40), F.lit(None).cast("string"), F.lit("title"), F.col("lang"))
    return read(spark, sf, "documents").select(
        "doc_id", text.truncated(t, 200).alias("head"), text.squeeze(t).alias("squeezed"), text.snippet(t, 50).alias("snip"), key.alias("cache_key"), filled.alias("filled")
    )


@query(
    """WITH n AS (SELECT doc_id, doc_id * 7919 % 10000019 // 100 * 100 + 3 AS n, doc_id % 90 * 1000 AS s FROM documents), l AS (
  SELECT *, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0) ELSE CAST(n AS VARCHAR) END AS short FROM n)
SELECT doc_id, short, CASE WHEN doc_id % 2 = 0 THEN '🎬 ' || short || ' views · ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '🔥 ' ELSE '' END || short || CASE WHEN doc_id % 3 = 0 THEN ' pts' ELSE ' 👍' END AS line,
  CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago,
  CASE WHEN doc_id % 5 = 0 THEN '-' WHEN n < 1000 THEN n || 'ms' WHEN n < 60000 THEN printf('%.1fs', n / 1000.0) ELSE printf('%.1fm', n / 60000.0) END AS took,
  CASE doc_id % 3 WHEN 0 THEN '(not set)' WHEN 1 THEN '***' ELSE 'sk-abcd...' || right(CAST(1000 + doc_id % 9000 AS VARCHAR), 4) END AS masked,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 4000 AS INTEGER) END AS max_age FROM l"""
)
def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    n = F.floor((i * 7919) % 10000019 / 100) * 100 + 3
    upvotes, score = F.when(i % 3 != 0, n), F.when(i % 3 == 0, n)
    line = text.engagement_line(F.when(i % 2 == 0, n), upvotes, score, F.lit(0), F.lit(None).cast("long"))
    secret = F.when(i % 3 == 0, "").when(i % 3 == 1, "short-key").otherwise(F.concat(F.lit("sk-abcdefgh"), (F.lit(1000) + i % 9000).cast("string")))
    header = F.when(i % 2 == 0, F.concat(F.lit("public, max-age="), i % 4000)).otherwise("no-store")
    return read(spark, sf, "documents").select(
        "doc_id", text.short_number(n).alias("short"), line.alias("line"), text.ago_label(i % 90 * 1000).alias("ago"), text.duration_label(F.when(i % 5 != 0, n)).alias("took"),
        text.masked_secret(secret).alias("masked"), text.max_age(header).alias("max_age"),
    )


@query(
    """SELECT conv_id, count(*) AS n, string_agg(rn || '. ' || substr(text, 1, 30), chr(10) ORDER BY turn) AS listed,
  substr(max(CASE WHEN rn = 1 THEN text END), 1, 200) || ' [comments: ' || string_agg(substr(text, 1, 150), ' | ' ORDER BY turn) FILTER (rn <= 5) || ']' AS embed
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE text <> '') GROUP BY 1"""
)
def comment_lists(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").filter("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = F.transform("t", lambda x: x["text"])
    listed = text.numbered_list(F.transform(said, lambda x: F.substring(x, 1, 30)))
    embed = text.embedding_text(F.get(said, F.lit(0)), F.lit(None).cast("string"), said)
    return turns.select("conv_id", F.size("t").cast("long").alias("n"), listed.alias("listed"), embed.alias("embed"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[{"id": ' || doc_id || '}]' END AS salvaged,
  CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS parts, 'first ' || doc_id AS one, CASE WHEN doc_id % 3 <> 0 THEN 'second' END AS two FROM documents"""
)
def reply_parsing(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('```json\n[{"id": '), i, F.lit("}]\n``` done"))).otherwise("no list here")
    numbered = F.concat(F.lit("[1] first "), i, F.when(F.col("doc_id") % 3 != 0, "\n[2] second ").otherwise("\n[2]  "))
    parts = text.numbered_parts(numbered)
    return read(spark, sf, "documents").select(
        "doc_id", text.salvaged_array(reply).alias("salvaged"), F.size(parts).alias("parts"), F.try_element_at(parts, F.lit(1)).alias("one"), F.try_element_at(parts, F.lit(2)).alias("two")
    )


_HOSTS = ("a.example", "A.example", "b.example:8080", "")
_DATES = ("/2024-01-31/x", "/2024/02/29/", "/20231201", "/2023-02-30/", "/none")


@query(
    f"""WITH u AS (SELECT page_id, 'https://' || {_sql_pick("page_id", *_HOSTS)} || {_sql_pick("page_id", *_DATES)} AS url, url AS own FROM pages)
SELECT page_id, {_sql_pick("page_id", "a.example", "A.example", "b.example", "")} = 'a.example' AS same, 'https://' || {_sql_pick("page_id", *_HOSTS)} || '/' AS home,
  regexp_extract(own, '^([a-z]+://[^/]*)', 1) || '/favicon.ico' AS favicon,
  CAST({_sql_pick("page_id", "2024-01-31", "2024-02-29", "2023-12-01", None, None)} AS VARCHAR) AS day FROM u"""
)
def url_rules(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://"), _pick("page_id", *_HOSTS), _pick("page_id", *_DATES))
    return read(spark, sf, "pages").select(
        "page_id", urls.same_domain(url, F.lit("http://a.example/other")).alias("same"), urls.homepage(url).alias("home"), urls.favicon(F.col("url")).alias("favicon"),
        times.url_date(url).cast("string").alias("day"),
    )


@query(
    """WITH t AS (SELECT doc_id, TIMESTAMP '2024-01-31 00:00:00' - to_seconds(CAST(doc_id * 37 AS BIGINT)) AS t0 FROM documents)
SELECT doc_id, strftime(t0, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(t0, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(t0 - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS zoned, strftime(date_trunc('hour', t0), '%Y-%m-%d %H:%M:%S') AS hour,
  strftime(make_timestamp(doc_id * 86413 * 1000000), '%Y-%m-%d %H:%M:%S') AS epoch, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE date_diff('day', CAST(t0 AS DATE), DATE '2024-01-31') END AS age,
  doc_id % 5 = 0 OR epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(t0) >= 3600 AS over FROM t"""
)
def time_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    at = F.timestamp_seconds(F.unix_timestamp(now()) - i * 37)
    shown = times.iso(at)
    day = F.when(i % 4 == 0, "not a day").otherwise(F.date_format(at, "yyyy-MM-dd"))
    rows = read(spark, sf, "documents")
    stamp = lambda c: F.date_format(c, _STAMP)
    return rows.select(
        "doc_id", shown.alias("iso"), stamp(times.parsed_iso(shown)).alias("parsed"), stamp(times.parsed_iso(F.replace(shown, F.lit("Z"), F.lit("+02:00")))).alias("zoned"),
        stamp(times.parsed_hour_key(times.hour_key(at))).alias("hour"), stamp(times.from_epoch(i * 86413)).alias("epoch"),
        times.age_days(day, F.to_date(now())).cast("long").alias("age"), times.elapsed(F.when(i % 5 != 0, at), now(), F.lit(3600)).alias("over"),
    )


@query(
    """SELECT doc_id, least(pow(2.0, doc_id % 9), 60.0) AS delay, round(least(pow(2.0, doc_id % 9), 60.0) * (0.7 + doc_id % 100 / 100.0 * 0.6), 6) AS jittered,
  CAST(greatest(floor(doc_id * 0.30), 5) AS BIGINT) AS cap, CAST(CASE WHEN n < 20 THEN least(n, greatest(2, least(5, greatest(1, n * 30 // 100)))) ELSE greatest(1, n * 30 // 100) END AS BIGINT) AS target,
  doc_id % 777 * 100 // 777 AS part, round(greatest(0.5, least(exp(ln(2.0) + 0.5 * (doc_id % 13 - 6)), 8.0)), 6) AS pause, abs(n - e) <= greatest(2, 2 * e) AS near, n = e AS exact
FROM (SELECT doc_id, doc_id % 60 AS n, doc_id % 7 AS e FROM documents)"""
)
def number_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    n, e, delay = i % 60, i % 7, numbers.backoff_delay(i % 9)
    return read(spark, sf, "documents").select(
        "doc_id", delay.alias("delay"), F.round(numbers.jittered(delay, i % 100 / 100.0), 6).alias("jittered"), numbers.budget_cap(i, 5).cast("long").alias("cap"),
        numbers.quota_target(n, 30).cast("long").alias("target"), numbers.whole_percent(i % 777, F.lit(777)).alias("part"),
        F.round(numbers.lognormal_delay(F.lit(2.0), i % 13 - 6, 0.5, 8.0), 6).alias("pause"), selection.within_tolerance(e, n).alias("near"), selection.within_tolerance(e, n, strict=True).alias("exact"),
    )


@query(
    """WITH l AS (SELECT conv_id, list(role || turn % 3 ORDER BY turn) AS given FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string([x for x in given if x IN ('user0', 'assistant1')], ',') AS allowed, len([x for x in given if x NOT IN ('user0', 'user1', 'user2', 'assistant0', 'assistant1', 'assistant2')]) = 0 AS subset,
  len(given) = conv_id % 4 AS zipped, CAST(conv_id % 3 > 0 AS INTEGER) + CAST(conv_id % 5 > 1 AS INTEGER) AS positive, len(list_distinct(given || ['user0', 'extra'])) AS merged FROM l"""
)
def array_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    given = F.transform("t", lambda x: F.concat(x["role"], (x["turn"] % 3).cast("string")))
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t")).select("conv_id", given.alias("given"))
    signals = F.create_map(F.lit("a"), c % 3, F.lit("b"), c % 5 - 1)
    return rows.select(
        "conv_id", F.array_join(F.filter("given", lambda x: F.array_contains(collections.allowed(F.col("given"), ["user0", "assistant1"]), x)), ",").alias("allowed"),
        collections.is_subset(F.col("given"), ["user0", "user1", "user2", "assistant0", "assistant1", "assistant2"]).alias("subset"),
        collections.zipped(F.col("given"), F.when(c % 4 > 0, F.sequence(F.lit(1).cast("long"), c % 4)).otherwise(F.array().cast("array<bigint>"))).isNotNull().alias("zipped"),
        F.size(collections.positive_entries(signals)).alias("positive"), F.size(collections.merged_in_order(F.col("given"), F.array(F.lit("user0"), F.lit("extra")))).cast("long").alias("merged"),
    )


_SOURCES, _TARGETS = ("en-US", "zh_cn", "fr-FR", "ja", "en-GB"), ("en-US", "zh-Hans", "de-DE")
_GROUPS = {"en-US": "en", "zh_cn": "zh", "fr-FR": "fr", "ja": "ja", "en-GB": "en", "zh-Hans": "zh", "de-DE": "de"}


@query(
    f"""WITH p AS (SELECT doc_id, {_sql_pick("doc_id", *_SOURCES)} AS s, {_sql_pick("(doc_id // 5)", *_TARGETS)} AS t, doc_id % 4 AS up FROM documents)
SELECT doc_id, {_sql_pick("doc_id", *[_GROUPS[x] for x in _SOURCES])} = {_sql_pick("(doc_id // 5)", *[_GROUPS[x] for x in _TARGETS])} AS family, s = t OR lower(substr(s, 1, 2)) = lower(substr(t, 1, 2)) AS skip,
  CASE WHEN doc_id % 6 > 0 THEN '[' || t || '] item ' || doc_id END AS translated,
  CASE up WHEN 0 THEN '' WHEN 1 THEN 'b,c' WHEN 2 THEN 'a' ELSE 'a,b,c' END AS engines FROM p"""
)
def translation_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    rows = read(spark, sf, "documents").withColumn("s", _pick("doc_id", *_SOURCES)).withColumn("fifth", F.floor(i / 5)).withColumn("t", _pick("fifth", *_TARGETS))
    title = F.when(i % 6 > 0, F.concat(F.lit("item "), i)).otherwise(" ")
    none = F.array().cast("array<string>")
    healthy = F.when(i % 4 == 0, none).when(i % 4 == 1, F.array(F.lit("b"), F.lit("c"))).when(i % 4 == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("c"), F.lit("a"), F.lit("b")))
    engines = languages.engine_order(F.lit("a"), F.array(F.lit("b"), F.lit("a"), F.lit("c")), healthy)
    return rows.select(
        "doc_id", languages.same_family(F.col("s"), F.col("t")).alias("family"), languages.translation_skip(F.col("s"), F.col("t")).alias("skip"),
        languages.test_translation(title, F.col("t")).alias("translated"), F.array_join(engines, ",").alias("engines"),
    )


@query(
    f"""WITH {views.SURFACES}, {views.RUNS}, {views.REGIONS}, l AS (SELECT surface_id, max(started_at) AS last_run, max(CASE WHEN status = 'success' THEN started_at END) AS last_success FROM runs WHERE surface_id % 6 <> 5 GROUP BY 1)
SELECT s.surface_key, r.region_key, CASE WHEN NOT s.enabled THEN 'Disabled' WHEN surface_id % 8 = 3 THEN 'Error' WHEN surface_id % 4 = 1 AND last_run IS NOT NULL THEN 'Running' WHEN last_success IS NOT NULL THEN 'Healthy' WHEN last_run IS NOT NULL THEN 'Running' ELSE 'Never run' END AS health,
  last_run IS NULL OR last_run <= TIMESTAMP '1998-07-31 00:00:00' AS due, last_run IS NULL OR last_run < TIMESTAMP '1998-07-30 23:00:00' AS stale,
  CASE WHEN floor_percent > 0 AND cap_percent IS NOT NULL THEN 'floor=' || floor_percent || '% / cap=' || cap_percent || '%' WHEN floor_percent > 0 THEN 'floor=' || floor_percent || '%' WHEN cap_percent IS NOT NULL THEN 'cap=' || cap_percent || '%' ELSE '—' END AS allocation
FROM surfaces s JOIN regions r USING (region_id) LEFT JOIN l USING (surface_id)"""
)
def surface_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Health, due and stale flags and allocation labels of surfaces, over two joins to their regions and runs."""
    ok = F.max(F.when(F.col("status") == "success", F.col("started_at")))
    last = adapters.runs(spark, sf).filter("surface_id % 6 <> 5").groupBy("surface_id").agg(F.max("started_at").alias("last_run"), ok.alias("last_success"))
    rows = adapters.surfaces(spark).join(F.broadcast(adapters.regions(spark, sf).drop("enabled")), "region_id").join(last, "surface_id", "left")
    k, at = F.col("surface_id"), F.lit("1998-07-31").cast("timestamp")
    shown = health.health_label(F.col("enabled"), F.when(k % 8 == 3, "timeout"), F.when(k % 4 != 1, F.col("last_success")), F.col("last_run"))
    return rows.select("surface_key", "region_key", shown.alias("health"), health.due(F.col("last_run"), at).alias("due"), health.stale(F.col("last_run"), at).alias("stale"), health.allocation_label(F.col("floor_percent"), F.col("cap_percent")).alias("allocation"))


_PLATFORMS = ("twitter", "YouTube", "reddit", "bbc", "yahoo_jp_ranking", "hackernews")
_ERRORS = ("You hit your usage limit", "timeout", "429 Too Many Requests", None)


@query(
    f"""WITH p AS (SELECT id, {_sql_pick("id", *_PLATFORMS)} AS platform, {_sql_pick("id", *_ERRORS)} AS error, CASE WHEN id % 2 = 0 THEN repeat('d', CAST(id % 50 AS INTEGER)) END AS d, id % 3 = 0 AS has FROM (SELECT doc_id AS id FROM documents))
SELECT id, CASE WHEN id % 6 IN (0, 4) THEN 'skip' WHEN id % 6 = 1 THEN 'youtube' WHEN coalesce(length(d), 0) > 30 THEN CASE WHEN id % 6 IN (2, 5) THEN 'discussion' ELSE 'news_article' END WHEN has THEN 'signals_only' ELSE 'skip' END AS strategy,
  id % 4 IN (0, 2) AS quota FROM p"""
)
def summary_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    described = F.when(F.col("id") % 2 == 0, F.repeat(F.lit("d"), (F.col("id") % 50).cast("int")))
    return rows.select("id", topics.summary_strategy(_pick("id", *_PLATFORMS), described, F.col("id") % 3 == 0).alias("strategy"), topics.quota_error(_pick("id", *_ERRORS)).alias("quota"))


_ENGINES = ("deepl", "system_stopped", "none_available", "google", "test")


@query(
    f"""WITH i AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'complete' ELSE 'pending' END AS status, doc_id % 7 > 0 AS has, {_sql_pick("doc_id", *_ENGINES)} AS engine, doc_id % 2 = 0 AS ok FROM documents)
SELECT id, CASE WHEN status = 'complete' THEN 'complete' WHEN NOT has THEN 'failed' WHEN engine IN ('system_stopped', 'none_available') THEN 'pending' WHEN ok THEN 'complete' ELSE 'failed' END AS status FROM i"""
)
def outcome_statuses(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "complete").otherwise("pending").alias("status"))
    outcomes = rows.filter("id % 7 > 0").select("id", _pick("id", *_ENGINES).alias("engine"), (F.col("id") % 2 == 0).alias("success"))
    return statuses.with_outcomes(rows, outcomes)


@query(
    f"""WITH {views.ITEMS}, c AS (SELECT id, title, summary_status, lang_group, {_sql_pick("id", "en-US", "zh-Hans", "fr-FR", None)} AS locale, {_sql_pick("(id // 4)", "pending", "failed", "complete")} AS canonical FROM items)
SELECT id, CASE WHEN canonical = 'pending' AND locale = 'en-US' THEN 'skipped' WHEN canonical = 'failed' THEN 'pending' ELSE canonical END AS canonical_status,
  CASE WHEN canonical = 'pending' AND locale = 'en-US' THEN title WHEN canonical = 'failed' THEN NULL ELSE 'old' END AS canonical_title, CASE WHEN canonical = 'pending' AND locale = 'en-US' THEN 'none' ELSE 'engine' END AS canonical_engine,
  CASE WHEN summary_status = 'failed' THEN CASE WHEN id % 4 = 1 THEN 'pending' ELSE 'queued' END ELSE summary_status END AS summary_status FROM c"""
)
def skips_and_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Native items are skipped, then failed rows start anew; a Chinese language group is given by the id."""
    rows = adapters.items(spark, sf).select("id", "title", "summary_status", _pick("id", "en-US", "zh-Hans", "fr-FR", None).alias("original_locale"))
    rows = rows.withColumn("lang_group", F.when(F.col("id") % 4 == 1, "zh").when(F.col("id") % 4 != 3, "xx")).withColumn("quarter", F.floor(F.col("id") / 4))
    rows = rows.select("*", _pick("quarter", "pending", "failed", "complete").alias("canonical_status"), F.lit("old").alias("canonical_title"), F.lit("old").alias("canonical_description"), F.lit("e").alias("canonical_error"), F.lit("engine").alias("canonical_engine"))
    out = statuses.skip_native(rows, "canonical_status", "en-", {"canonical_title": "title"}, "canonical_engine")
    out = statuses.retry_failed_summaries(statuses.retry_failed_translations(out))
    return out.select("id", "canonical_status", "canonical_title", "canonical_engine", "summary_status")


@query(
    f"""WITH {views.ITEMS} SELECT id, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at FROM items
WHERE collected_at > TIMESTAMP '2024-01-29 00:00:00' AND collected_at <= TIMESTAMP '2024-01-30 00:00:00' AND id % 3 = 0 AND id % 5 > 0"""
)
def harvest_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.items(spark, sf).withColumn("classified_by", F.when(F.col("id") % 3 == 0, "llm").when(F.col("id") % 3 == 1, "heuristic")).withColumn("story_category", F.when(F.col("id") % 5 > 0, "ai"))
    found = statuses.learnable(rows, F.lit("2024-01-29").cast("timestamp"), F.lit("2024-01-30").cast("timestamp"))
    return found.select("id", F.date_format("collected_at", _STAMP).alias("collected_at"))


@query("SELECT max(doc_id) AS max_id, max(doc_id) FILTER (doc_id < 0) AS none FROM documents")
def high_water_mark(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return statuses.high_water(rows).crossJoin(F.broadcast(statuses.high_water(rows.filter("id < 0")).withColumnRenamed("max_id", "none")))  # a row each


@query(f"WITH {views.ITEMS} SELECT id, title FROM items ORDER BY collected_at DESC, id DESC LIMIT 25 OFFSET 50")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return feed.offset_page(adapters.items(spark, sf), 25, 50).select("id", "title")


@query("SELECT 'healthy' AS status, 'tidewell' AS service")
def service_health(spark: SparkSession, sf: str) -> DataFrame:
    return health.service_status(spark, now()).drop("timestamp")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'https://img.example/' || doc_id END AS thumbnail_url FROM documents")
def thumbnails(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    payload = F.when(i % 3 == 0, F.to_json(F.struct(F.concat(F.lit("https://img.example/"), i).alias("_thumbnail_url"), i.alias("other")))).when(i % 3 == 1, F.to_json(F.struct(i.alias("other"))))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id")).select("id", feed.thumbnail(payload).alias("thumbnail_url"))


@query(
    f"""WITH {views.DERIVATIONS}, p AS (SELECT 'p' || s_suppkey % 4 AS provider, s_suppkey % 4 <> 3 AS up FROM supplier GROUP BY ALL), d AS (
  SELECT count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed FROM derivations WHERE derivation_type = 'translation')
SELECT CASE WHEN bool_and(up) THEN 'ok' WHEN bool_or(up) THEN 'degraded' ELSE 'stopped' END AS status, count(*) AS providers, count(*) FILTER (up) AS available, any_value(complete) AS complete, any_value(failed) AS failed,
  round(100.0 * any_value(complete) / (any_value(complete) + any_value(failed)), 2) AS success_rate FROM p, d"""
)
def translation_health(spark: SparkSession, sf: str) -> DataFrame:
    """The health of translation as one answer: providers and what they finished."""
    s = F.col("s_suppkey")
    providers = read(spark, sf, "supplier").select(F.concat(F.lit("p"), s % 4).alias("provider"), F.when(s % 4 != 3, "available").otherwise("unavailable_auth").alias("state")).distinct()
    return health.translation_health(providers, adapters.derivations(spark, sf).filter("derivation_type = 'translation'"))


@query(
    """SELECT d.doc_id AS id, CASE WHEN d.doc_id % 10 = 0 THEN 'new' ELSE 'old' END AS state, d.n_chars + coalesce(l.quality, 0) AS total
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def updated_and_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Selected columns set anew, and counters grown by their deltas."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("old").alias("state"), F.col("n_chars").cast("long").alias("total"))
    deltas = read(spark, sf, "labels").join(docs.select(F.col("id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("total"))
    merged = health.merged_counters(docs, deltas, ["id"], ["total"])
    return tables.updated(docs.drop("total").join(merged, "id"), F.col("id") % 10 == 0, {"state": F.lit("new")})


@query(
    """SELECT (SELECT count(*) FROM documents) AS fetched, (SELECT count(DISTINCT text) FROM documents) AS stored, (SELECT count(*) - count(DISTINCT text) FROM documents) AS deduped"""
)
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    stored = tables.new_rows(docs, docs.limit(0), "text", [F.col("doc_id")])
    return tables.run_counts(docs, stored)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT range, 'seed' || range FROM range(20, 40) WHERE range NOT IN (SELECT n_nationkey FROM nation)")
def seeded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Seed rows are created where their key is new; a second time they change nothing."""
    have = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    seeds = spark.range(20, 40).select("id", F.concat(F.lit("seed"), F.col("id")).alias("name"))
    return sinks.seeded(seeds, sinks.seeded(seeds, have, "id"), "id")


@query(
    """SELECT user_id % 20 AS d, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) FILTER (event_type <> 'view') AS direct_requests, count(*) FILTER (event_type = 'view') AS simulated_requests
FROM events GROUP BY 1, 2"""
)
def counter_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Named counters, a row a domain, hour and counter, parsed and pivoted."""
    events = read(spark, sf, "events").withColumn("hour", times.hour_key(F.col("ts").cast("timestamp")))
    kind = F.when(F.col("event_type") == "view", "simulated_requests").otherwise("direct_requests")
    name = F.concat_ws(":", F.lit("app"), F.lit("metrics"), (F.col("user_id") % 20).cast("string"), "hour", kind)
    parsed = sinks.parsed_counters(events.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("value")))
    return parsed.select(F.col("domain").cast("long").alias("d"), F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("direct_requests", "simulated_requests")])


@query(
    """SELECT 't' || doc_id % 50 AS term, lang, any_value('ai') AS topic, count(*) AS score FROM documents WHERE doc_id % 50 % 3 = 0 GROUP BY 1, 2"""
)
def confirmed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose topic an outside check confirms; answers outside the vocabulary or off the topic don't count."""
    found = read(spark, sf, "documents").groupBy(F.concat(F.lit("t"), F.col("doc_id") % 50).alias("term"), "lang").agg(F.lit("ai").alias("topic"), F.count(F.lit(1)).alias("score"))
    n = F.substring("term", 2, 9).cast("int")
    answers = found.select("term", "lang", F.when(n % 3 == 0, "ai").when(n % 3 == 1, "sports").otherwise("nonsense").alias("answer"))
    return keywords.confirmed(found, answers, ["ai", "sports"])


_ARABIC, _HINDI = ("الكتاب كتاب قلم", "سلام"), ("भारत में चुनाव भारत", "क")


@query(
    f"""SELECT doc_id, {_sql_pick("doc_id", "الكتاب,قلم", "سلام")} AS arabic, {_sql_pick("doc_id", "भारत,में,चुनाव", "")} AS hindi FROM documents"""
)
def entity_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(
        "doc_id", F.array_join(keywords.arabic_entities(_pick("doc_id", *_ARABIC)), ",").alias("arabic"), F.array_join(keywords.hindi_entities(_pick("doc_id", *_HINDI)), ",").alias("hindi")
    )


@query()
def provider_probes(spark: SparkSession, sf: str) -> DataFrame:
    """A state machine without an SQL form; tests hold it against plain cases."""
    events = read(spark, sf, "events").select(F.concat(F.lit("p"), F.col("user_id") % 40).alias("provider"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), F.when(F.col("event_type") != "error", F.col("event_id") % 2 == 0).alias("up"))
    return statuses.replay_probes(events)


@query()
def quota_backoff(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select(F.concat(F.lit("w"), F.col("user_id") % 40).alias("worker"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), (F.col("event_type") == "error").alias("quota_error"))
    return statuses.replay_quota_backoff(events)


@query()
def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of whole texts by the latent model of all texts; a caller may bring another embedder."""
    model, rows = latent.fit(read(spark, sf, "documents").select("doc_id", "text"), key="doc_id")
    return latent.vectors(rows, model, "doc_id")


@query()
def latent_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest texts of every text whose id 50 divides, by latent vectors."""
    vectors = cut(embedded_texts(spark, sf).filter("embedding is not null").withColumnRenamed("doc_id", "vec_id"))
    return tables.cosine_top(vectors, vectors.filter("vec_id % 50 = 0"), 5)

