"""The logical tables of ``sources.adapters`` in SQL, as common table expressions."""

ENGAGEMENT = """engagement AS (
  SELECT user_id % 15 AS g, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS upvotes,
         count(*) FILTER (event_type = 'signup') AS comments, count(*) FILTER (event_type = 'purchase') AS shares
  FROM events GROUP BY 1)"""

ITEMS = ENGAGEMENT + """, base AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description, lang AS lang_group, source AS surface_key,
         CAST(substr(source, 4) AS INTEGER) AS k FROM documents),
items AS (
  SELECT b.*, 'p' || (k % 5) AS platform, k % 25 AS region_id,
    ['hot_now', 'category_tech', 'world_news', 'category_ai', 'rss', 'search'][k % 6 + 1] AS bucket,
    CASE WHEN k % 3 = 0 THEN 'rss_feed' ELSE 'ranking' END AS surface_type,
    CAST(id % 96 AS DOUBLE) AS hours_old,
    TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(id % 96 AS INTEGER)) AS collected_at,
    TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(id % 96 + id % 7 AS INTEGER)) AS published_at,
    CAST(id % 120 + 1 AS INTEGER) AS rank_position,
    coalesce(views, 0) AS views, coalesce(upvotes, 0) AS upvotes, coalesce(comments, 0) AS comments, coalesce(shares, 0) AS shares,
    CASE WHEN quality = 1 THEN 'complete' WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS summary_status,
    CASE WHEN toxic = 1 THEN 'complete' WHEN toxic = 0 THEN 'pending' END AS translation_status
  FROM base b LEFT JOIN labels l ON b.id = l.doc_id LEFT JOIN engagement e ON b.id % 15 = e.g)"""

SCORED = ITEMS + """, weighted AS (
  SELECT *, greatest(0.0, upvotes * 1.0 + comments * 2.0 + views * 0.1 + shares * 3.0 + greatest(0.0, 100.0 - rank_position) * 10.0) AS weight FROM items),
all_scored AS (SELECT *, exp(-0.05 * hours_old) * log10(1.0 + weight) * 100.0 AS score FROM weighted),
scored AS (SELECT *, CASE WHEN id % 10 <> 9 THEN score END AS hotness FROM all_scored)"""

REGIONS = """regions AS (
  SELECT n_nationkey AS region_id, n_name AS region_key, r_name AS region_name, n_nationkey % 5 <> 4 AS enabled
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

SURFACES = """surfaces AS (
  SELECT k AS surface_id, 'src' || k AS surface_key, 'p' || (k % 5) AS platform, k % 25 AS region_id, k % 7 <> 6 AS enabled,
    CASE WHEN k % 3 = 0 THEN 'rss_feed' ELSE 'ranking' END AS surface_type,
    CASE WHEN k % 4 = 0 THEN (k % 3 + 1) * 5 ELSE 0 END AS floor_percent, CASE WHEN k % 5 = 0 THEN (k % 4) * 10 END AS cap_percent
  FROM (SELECT CAST(range AS INTEGER) AS k FROM range(20)))"""

RUNS = """runs AS (
  SELECT o_orderkey AS run_id, CAST(o_custkey % 20 AS INTEGER) AS surface_id, o_orderdate AS started_at,
    CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status, coalesce(fetched, 0) AS fetched, coalesce(stored, 0) AS stored,
    coalesce(fetched, 0) - coalesce(stored, 0) AS deduped
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS fetched, count(*) FILTER (l_returnflag = 'N') AS stored FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""

REQUESTS = """requests AS (
  SELECT event_id AS request_id, ts, 'd' || (user_id % 20) || '.example' AS domain, value AS latency,
    CASE WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 404 ELSE 429 END ELSE 200 END AS status
  FROM events)"""

DERIVATIONS = """derivations AS (
  SELECT conv_id AS item_id, CASE turn % 3 WHEN 0 THEN 'translation' WHEN 1 THEN 'summary' ELSE 'embedding' END AS derivation_type,
    role AS target_locale, turn AS created_order, text AS content, CASE WHEN length(text) % 4 = 0 THEN 'failed' ELSE 'complete' END AS status
  FROM conversations)"""

HOURS = REQUESTS + """, hours AS (
  SELECT domain, date_trunc('hour', ts) AS hour, count(*) FILTER (status >= 200 AND status < 400) AS requests_2xx,
    count(*) FILTER (status >= 400 AND status < 500) AS requests_4xx, count(*) FILTER (status >= 500) AS requests_5xx,
    count(*) FILTER (status = 429) AS requests_429, count(*) FILTER (status = 403) AS requests_403, avg(latency) AS latency_mean
  FROM requests GROUP BY 1, 2)"""

#: Cutoffs of the last 24 hours at 10 %, and the limits that follow for surfaces.
CUTOFFS = SCORED + ", " + SURFACES + """,
recent AS (SELECT * FROM scored WHERE hours_old <= 24),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang_group ORDER BY hotness DESC) AS rn, count(*) OVER (PARTITION BY lang_group) AS n
           FROM recent WHERE hotness IS NOT NULL AND lang_group IS NOT NULL),
cutoffs AS (SELECT lang_group, hotness AS cutoff FROM placed WHERE rn = greatest(1, CAST(floor(n * 10 / 100.0) AS BIGINT))),
pools AS (SELECT lang_group, count(*) FILTER (hotness >= cutoff) AS pool, count(*) AS total FROM recent JOIN cutoffs USING (lang_group)
          WHERE hotness IS NOT NULL GROUP BY 1),
langs AS (SELECT surface_key, lang_group FROM (
  SELECT surface_key, lang_group, row_number() OVER (PARTITION BY surface_key ORDER BY count(*) DESC, lang_group) AS rn FROM recent GROUP BY 1, 2) WHERE rn = 1),
limits AS (
  SELECT surface_key, region_id, floor_percent, surface_type,
    CASE WHEN floor_percent > 0 THEN greatest(1, CAST(floor(pool * floor_percent / 100.0) AS INTEGER)) ELSE 0 END AS floor_rows,
    CAST(floor(pool * cap_percent / 100.0) AS INTEGER) AS cap_rows
  FROM surfaces JOIN langs USING (surface_key) JOIN pools USING (lang_group)
  WHERE enabled AND (floor_percent > 0 OR cap_percent IS NOT NULL) AND pool > 0),
eligible AS (SELECT * FROM scored WHERE hotness IS NOT NULL AND summary_status IN ('complete', 'skipped') AND lang_group IS DISTINCT FROM 'es'),
floor_ranked AS (
  SELECT e.*, l.floor_percent, l.region_id AS r, l.floor_rows, l.cap_rows,
    row_number() OVER (PARTITION BY e.surface_key ORDER BY CASE WHEN l.surface_type = 'rss_feed' THEN CAST(epoch(published_at) AS DOUBLE) ELSE hotness END DESC, e.id) AS rn
  FROM eligible e JOIN limits l ON e.surface_key = l.surface_key WHERE l.floor_percent > 0),
wants AS (
  SELECT surface_key, floor_percent, r, least(min(floor_rows), coalesce(min(cap_rows), min(floor_rows)), count(*) FILTER (rn <= 50)) AS want
  FROM floor_ranked GROUP BY 1, 2, 3),
takes AS (
  SELECT surface_key, greatest(0, least(want, 50 - coalesce(sum(want) OVER (ORDER BY floor_percent DESC, r, surface_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM wants),
pass1 AS (SELECT f.id, f.surface_key, f.lang_group, f.hotness FROM floor_ranked f JOIN takes t ON f.surface_key = t.surface_key WHERE rn <= take),
left_over AS (SELECT 50 - count(*) AS remaining FROM pass1),
candidates AS (
  SELECT e.*, row_number() OVER (ORDER BY hotness DESC, id) AS pos FROM eligible e JOIN cutoffs USING (lang_group)
  WHERE hotness >= cutoff AND id NOT IN (SELECT id FROM pass1)),
capped AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.surface_key ORDER BY c.hotness DESC, c.id) + coalesce(had, 0) AS place, cap_rows
  FROM (SELECT c0.*, remaining FROM candidates c0, left_over WHERE pos <= remaining + 50) c
  LEFT JOIN (SELECT surface_key, count(*) AS had FROM pass1 GROUP BY 1) h ON c.surface_key = h.surface_key
  LEFT JOIN limits l ON c.surface_key = l.surface_key),
pass2 AS (
  SELECT id, surface_key, lang_group, hotness FROM (
    SELECT *, row_number() OVER (ORDER BY hotness DESC, id) AS rn2 FROM capped WHERE cap_rows IS NULL OR place <= cap_rows), left_over l2 WHERE rn2 <= l2.remaining)"""
