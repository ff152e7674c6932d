"""Operators against plain loops and tables of cases."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewell.config import Settings
from tidewell.operators import feed, health, keywords, languages, ordered, policy, ranking, regions, selection, tables, topics


def items(spark, n=300, seed=0, langs=("en", "fr", "de")):
    r = random.Random(seed)
    rows = [
        (i, r.choice(langs), f"s{r.randrange(6)}", r.choice([None, *[float(r.randrange(60)) for _ in range(6)]]), float(r.randrange(40)), datetime(2024, 1, 30, r.randrange(24)), r.choice(["complete", "skipped", "pending", "failed"]), r.choice(["ranking", "rss_feed"]))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id long, lang_group string, surface_key string, hotness double, hours_old double, published_at timestamp, summary_status string, surface_type string")


SURFACES = [("s0", True, 10, None, "ranking", 0), ("s1", True, 30, 20, "rss_feed", 1), ("s2", True, 0, 0, "ranking", 2), ("s3", True, 0, 40, "ranking", 3), ("s4", False, 50, 50, "ranking", 4), ("s5", True, 30, None, "ranking", 5)]


def greedy(rows, settings, target, batch):
    """The two passes as a plain loop over sorted lists."""
    recent = [r for r in rows if r[4] <= settings.window_hours]
    scored = lambda lang: sorted((r[3] for r in recent if r[1] == lang and r[3] is not None), reverse=True)
    cutoff = {lang: s[max(1, int(len(s) * settings.hot_percent / 100)) - 1] for lang in {r[1] for r in rows} if (s := scored(lang))}
    floor, cap = {}, {}
    for key, enabled, f, c, *_ in SURFACES:
        own = [r[1] for r in recent if r[2] == key]
        if not enabled or (f == 0 and c is None) or not own:
            continue
        lang = min(set(own), key=lambda x: (-own.count(x), x))
        pool = sum(h >= cutoff[lang] for h in scored(lang)) if lang in cutoff else 0
        if pool:
            floor[key] = max(1, int(pool * f / 100)) if f else 0
            cap[key] = None if c is None else int(pool * c / 100)
    fit = [r for r in rows if r[3] is not None and r[6] in ("complete", "skipped") and r[1] != target]
    chosen, counts = [], {}
    for key, _, f, _, kind, region in sorted((s for s in SURFACES if s[2] > 0 and s[0] in floor), key=lambda s: (-s[2], s[5], s[0])):
        want = min(floor[key], batch - len(chosen), *([cap[key]] if cap[key] is not None else []))
        order = (lambda r: (-r[5].timestamp(), r[0])) if kind == "rss_feed" else (lambda r: (-r[3], r[0]))
        got = sorted((r for r in fit if r[2] == key), key=order)[: max(0, want)]
        chosen += [r[0] for r in got]
        counts[key] = len(got)
    first = list(chosen)
    remaining = batch - len(chosen)
    candidates = sorted((r for r in fit if r[1] in cutoff and r[3] >= cutoff[r[1]] and r[0] not in first), key=lambda r: (-r[3], r[0]))[: remaining + batch]
    for r in candidates:
        if len(chosen) >= batch:
            break
        if cap.get(r[2]) is not None and counts.get(r[2], 0) >= cap[r[2]]:
            continue
        chosen.append(r[0])
        counts[r[2]] = counts.get(r[2], 0) + 1
    return first, chosen


@pytest.mark.parametrize(("seed", "batch", "percent"), [(1, 20, 30), (2, 6, 60), (3, 50, 90), (4, 3, 100)])
def test_selection_equals_the_greedy_loop(spark, seed, batch, percent):
    rows, df = items(spark, seed=seed)
    surfaces = spark.createDataFrame([(k, e, f, c, t, r) for k, e, f, c, t, r in SURFACES], "surface_key string, enabled boolean, floor_percent int, cap_percent int, surface_type string, region_id int")
    conf = Settings(batch_size=batch, hot_percent=percent)
    got = selection.select_batch(df, surfaces, "de", conf).collect()
    first, chosen = greedy(rows, conf, "de", batch)
    assert sorted(r.id for r in got if r["pass"] == 1) == sorted(first)
    assert sorted(r.id for r in got) == sorted(chosen)


def test_cutoffs_equal_sorting(spark):
    rows, df = items(spark, 500, seed=9)
    for percent in (1, 10, 37, 100):
        got = {r[0]: r[1] for r in ranking.cutoffs(df, percent).collect()}
        for lang in got:
            s = sorted((r[3] for r in rows if r[1] == lang and r[3] is not None), reverse=True)
            assert got[lang] == s[max(1, int(len(s) * percent / 100)) - 1]


def test_feed_orders_and_cursors(spark):
    at = lambda d, h=0: datetime(2024, 1, 10 + d, h)
    df = spark.createDataFrame([(1, at(0), None), (2, at(-1), 100.0), (3, at(0), 50.0)], "id long, collected_at timestamp, hotness double")
    assert [r.id for r in df.orderBy(*feed.scored_first_order()).collect()] == [2, 3, 1]
    assert [r.id for r in feed.page(df, 1).collect()] == [3, 1]
    assert [r.id for r in feed.page(df, 5, "Mw==").collect()] == [1, 2]
    assert feed.decode_cursor("MTI=") == 12 and feed.decode_cursor("eyJpZCI6MTIsImxhbmciOiJ6aC1IYW5zIn0=") == 12
    assert feed.decode_cursor("12") == 12 and feed.decode_cursor("MA==") is None and feed.decode_cursor("!!") is None and feed.decode_cursor(None) is None
    rows, many = items(spark, 100)
    many = many.withColumnRenamed("published_at", "collected_at")
    seen, last = [], None
    while page := feed.keyset_page(many, 17, last).collect():
        seen += [r.id for r in page]
        last = (str(page[-1].collected_at), page[-1].id)
    assert seen == [r.id for r in many.orderBy(*feed.recency_order()).collect()]


def test_topic_waterfall(spark):
    vocabulary = {"ai": ["AGI", "AI chip"], "politics": ["senate"], "crypto": ["bitcoin"], "business": ["ETF"], "science": ["政治"]}
    rows = [
        (1, "category_tech", "x", "en", "senate", ""), (2, "b", "devto", "en", "senate", ""), (3, "b", "x", "en", "Bitcoin ETF", ""), (4, "b", "x", "en", "Magic show", ""),
        (5, "b", "bilibili", "zh", "none", None), (6, "b", "x", "en", "t", "y" * 300 + " senate"), (7, "b", "x", "en", "AGI in the Senate", ""), (8, "b", "x", "zh", "中国政治改革", ""), (9, "b", "x", "zh", "政治 改革", ""), (10, "b", "x", "en", None, None),
    ]
    df = spark.createDataFrame([(*r, "s") for r in rows], "id long, bucket string, platform string, lang_group string, title string, description string, surface_key string")
    got = {r.id: (r.topic, r.signal, r.tier) for r in topics.waterfall(df, vocabulary).collect()}
    none = (None, None, "none")
    assert got == {
        1: ("technology", "bucket", "high"), 2: ("technology", "platform", "high"), 3: ("crypto", "keyword", "medium"), 4: none, 5: ("entertainment", "locale", "low"),
        6: none, 7: ("ai", "keyword", "medium"), 8: none, 9: ("science", "keyword", "medium"), 10: none,
    }


def test_topic_cycle_truth_table(spark):
    rows = [(1, "category_ai", "x", "en", 9.0), (2, "b", "bilibili", "zh", 9.0), (3, "b", "bilibili", "zh", 1.0), (4, "b", "bilibili", "zh", 8.0), (5, "b", "y", "en", 9.0), (6, "b", "y", "en", 8.0), (7, "b", "y", "en", 1.0)]
    df = spark.createDataFrame([(*r, "t", None, "s", "pending") for r in rows], "id long, bucket string, platform string, lang_group string, hotness double, title string, description string, surface_key string, classification_state string")
    answers = spark.createDataFrame([(1, "sports"), (2, "sports"), (3, "sports"), (4, None), (5, "world"), (6, None), (7, "world")], "id long, answer string")
    got = {r.id: tuple(r)[1:] for r in topics.cycle(df, {"ai": ["zzz"]}, answers, "v", llm_top=2).collect()}
    assert got == {
        1: ("ai", "bucket", "heuristic_complete", "v"), 2: ("sports", "llm", "llm_complete", "v"), 3: ("entertainment", "locale", "heuristic_complete", "v"),
        4: ("entertainment", "locale", "heuristic_complete", "v"), 5: ("world", "llm", "llm_complete", "v"), 6: (None, None, "failed", None), 7: (None, None, "failed", None),
    }
    off = {r.id: r.classification_state for r in topics.cycle(df, {"ai": ["zzz"]}, answers, "v", llm=False).collect()}
    assert off[2] == "heuristic_complete" and off[5] == "failed"


def test_regions(spark):
    rows = [(1, "zh", "weibo", "x", "Trump visits"), (2, "en", "x", "x", "U.S. votes"), (3, "zh", "x", "wenxuecity_news", "none"), (4, "en", "reddit", "reddit_mexico", "x"), (5, "en", "x", "36kr_rss", "THAILAND and hk"), (6, "en", "x", "x", None)]
    df = spark.createDataFrame(rows, "id long, lang_group string, platform string, surface_key string, title string")
    got = {r.id: (r.content_regions, r.primary_region) for r in regions.classified(df).collect()}
    assert got == {1: (["cn", "us"], "cn"), 2: (["us"], "us"), 3: ([], None), 4: (["es"], "es"), 5: (["cn", "hk", "th"], "cn"), 6: ([], None)}


def test_locales(spark):
    raw = ["zh_hans", "zh-TW", "en", "ja", "en_us", "pt-br", "zh-Hant-HK", "xx", "nb-no"]
    df = spark.createDataFrame([(r,) for r in raw], "l string")
    got = df.select(languages.normalized_locale(F.col("l")), languages.lang_group(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("zh-Hans", "zh"), ("zh-Hant", "zh"), ("en-US", "en"), ("ja-JP", "ja"), ("en-US", "en"), ("pt-BR", "pt"), ("zh-Hant-HK", "zh"), ("xx", "xx"), ("nb-NO", "no")]
    rows = spark.createDataFrame([("der und die", None, "en-US"), ("x", "zh-TW", "en-US"), ("", None, "fr-FR"), ("новости", None, "en-US")], "t string, original_locale string, default_locale string")
    detected = languages.detector(lambda t, fallback: {"der und die": "de", "новости": "ru"}.get(t, fallback))(F.col("t"), F.substring("default_locale", 1, 2))
    assert [(r.base_lang, r.locale, r.lang_group) for r in languages.classified(rows, detected).collect()] == [("de", "de-DE", "de"), ("zh", "zh-Hans", "zh"), ("fr", "fr-FR", "fr"), ("ru", "ru-RU", "ru")]


def test_entities(spark):
    cases = [
        ("TSMC reports record earnings", "en", {"TSMC"}), ("South China Sea tensions rise", "en", {"South China Sea"}), ("ByteDance faces new US restrictions", "en", {"ByteDance"}),
        ("Macron announced new energy policy", "en", {"Macron"}), ("The New policy announced today", "en", {"The New"}), ("Путин объявил новую политику в Москве", "ru", set()),
        ("Macron annonce une réforme à Paris", "fr", set()), ("Ein Mann aus Berlin besucht Berlin", "de", set()), ("Pedro Sánchez visitó Madrid", "es", {"Pedro Sánchez"}),
        ("Modi visits New Delhi", "hi", set()), ("दिल्ली और दिल्ली में बैठक", "hi", {"दिल्ली", "और", "में", "बैठक"}), ("الرياض رياض", "ar", {"الرياض"}), ("", "zh", set()), (None, "en", set()),
    ]
    df = spark.createDataFrame([(t, lang) for t, lang, _ in cases], "t string, l string")
    got = df.select("l", keywords.entities(F.col("t"), F.col("l")).alias("e")).collect()
    for (title, lang, expected), r in zip(cases, got, strict=True):
        assert (expected <= set(r.e) if lang == "en" and expected else set(r.e) == expected), title


def test_keyword_rules(spark):
    cases = [("II", 5, "en", False), ("U.S.", 5, "en", True), ("...", 5, "en", False), ("iPhone", 5, "en", False), ("警方", 5, "zh", True), ("NASA", 5, "en", True), ("into", 5, "en", False), ("NASA", 1, "en", False), ("  New   Mexico ", 2, "en", True), ("The", 9, "en", False)]
    df = spark.createDataFrame(cases, "t string, s int, l string, ok boolean")
    assert all(r.got == r.ok for r in df.withColumn("got", keywords.valid(F.col("t"), F.col("s"), F.col("l"))).collect())
    rows = [("a", "ai")] * 4 + [("a", "tech")] + [("b", "ai")] * 79 + [("b", "tech")] * 21 + [("c", "x"), ("c", "w")]
    df = spark.createDataFrame([([t], "en", topic) for t, topic in rows], "entities array<string>, lang string, topic string")
    assert [(r.term, r.topic, r.total, r.purity) for r in keywords.candidates(df).collect()] == [("a", "ai", 5, 0.8)]
    assert {r.term: r.topic for r in keywords.candidates(df, 2, 0.5).collect()}["c"] == "w"
    today = date(2024, 4, 1)
    day = lambda n: date.fromordinal(today.toordinal() - n)
    old = spark.createDataFrame([("t", f"k{s}_{n}", "en", s, day(n)) for s in (9, 10) for n in (30, 31, 90, 91)], "topic string, term string, lang string, score long, last_seen date")
    new = spark.createDataFrame([("t", "k9_91", "en", 1), ("t", "fresh", "en", 2)], "topic string, term string, lang string, score long")
    got = {r.term: r.score for r in keywords.merged(old, new, F.lit(today)).collect()}
    assert got == {"k9_30": 9, "k10_30": 10, "k10_31": 10, "k10_90": 10, "k9_91": 10, "fresh": 2}


def test_streaks_and_health(spark):
    runs = spark.createDataFrame([(s, i, n) for s, seq in ((1, [0, 0, 0]), (2, [0, 0, 5, 0])) for i, n in enumerate(seq)], "surface_id int, run_id int, stored int")
    last = {r.surface_id: r.streak for r in ordered.streaks(runs, "surface_id", ["run_id"], F.col("stored") > 0).orderBy("run_id").collect()}
    assert last == {1: 3, 2: 1}
    states = spark.createDataFrame([("available",), ("unavailable_auth",)], "state string")
    assert health.providers_rollup(states).first().status == "degraded"
    assert health.providers_rollup(states.limit(0)).first().status == "stopped"
    log = spark.createDataFrame([(401, None), (403, None), (429, None), (500, None), (418, None), (200, "quota_exceeded")], "s int, c string")
    assert [r[0] for r in log.select(health.provider_state(F.col("s"), F.col("c"))).collect()] == ["unavailable_auth", "unavailable_auth", "unavailable_rate_limit", "unavailable_transient", "unavailable_transient", "unavailable_funds"]


def test_breaker_and_budget(spark):
    events = [("d", s, s, o) for s, o in ((0, "forbidden"), (10, "rate_limit"), (20, "other"), (30, "success"), (90, "success"), (95, "success"))]
    got = policy.replay_breaker(spark.createDataFrame(events, "domain string, seconds long, request_id long, outcome string"), threshold=3, cooldown=60).orderBy("seconds").collect()
    assert [r.circuit for r in got] == ["closed", "closed", "open", "open", "closed", "closed"]
    assert [r.blocked for r in got] == [False, False, False, True, False, False]
    assert [r.backoff for r in got] == [1.5, 2.25, 2.25, 2.25, 2.15, 2.05]
    log = [("d", "h", i, False) for i in range(100)] + [("d", "h", 100 + i, True) for i in range(40)]
    allowed = policy.replay_budget(spark.createDataFrame(log, "domain string, hour string, request_id long, simulated boolean"), base=1).filter("request_id >= 100 and allowed").count()
    assert allowed == 31
    means = policy.running_mean(spark.createDataFrame([("d", i, v) for i, v in enumerate((10, 21, 30))], "domain string, i long, v long"), "domain", ["i"], "v").orderBy("i").collect()
    assert [r["mean"] for r in means] == [10, 15, 20]
    providers = [("p", i, o) for i, o in enumerate(("unavailable_auth", "success", "probe_ok", "unavailable_funds", "unavailable_funds"))]
    got = policy.replay_providers(spark.createDataFrame(providers, "provider string, seq long, outcome string")).orderBy("seq").collect()
    assert [(r.state, r.failures) for r in got] == [("unavailable_auth", 1), ("unavailable_auth", 1), ("available", 0), ("unavailable_funds", 1), ("unavailable_funds", 2)]
    attempts = spark.createDataFrame([(304, 1), (200, 1), (429, 1), (503, 3), (404, 1), (0, 2)], "status int, attempt int")
    assert [r.action for r in policy.retry_action(attempts).collect()] == ["cached", "done", "retry", "give_up", "stop", "retry"]


def test_tables(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    changes = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, tables.upserted(cur, changes, ["k"], "seq").collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    new = tables.new_rows(changes, cur, "k", [F.col("seq")])
    assert [r.k for r in new.collect()] == [3]
    assert [r[0] for r in feed.excluding(spark.createDataFrame([("a",), (None,)], "x string"), "x", "a").collect()] == [None]
    unit = tables.normalized(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "vec_id int, embedding array<float>")).orderBy("vec_id").collect()
    assert unit[0].embedding == pytest.approx([0.6, 0.8]) and unit[1].embedding == [0.0, 0.0]


def test_latin_entities_equal_unicode_patterns(spark):
    """Against the same patterns in an engine with Unicode boundaries; German terms twice in the title."""
    import regex
    from pyspark.sql import functions as F

    from tidewell.operators import keywords

    titles = ["Élodie Dupont à Paris avec ÉDF et l'ONU", "İstanbul Büyük Şehir", "Москва Сити и РФ", "Müller trifft Olaf Scholz und Olaf Scholz", "McDonald iPhone GitHub", "eONU ONUs ÀB", "", None]
    for lang in ("fr", "de"):
        df = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
        got = {r.i: r.e for r in df.select("i", keywords.latin_entities(F.col("t"), F.lit(lang)).alias("e")).collect()}
        for i, t in enumerate(titles):
            patterns = (r"\b\p{Lu}{2,6}\b", r"\b(?:\p{Lu}\p{Ll}+\s){1,3}\p{Lu}\p{Ll}+\b", r"\b\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)+\b")
            want = list(dict.fromkeys(m for p in patterns for m in regex.findall(p, t or "")))
            assert got[i] == [w for w in want if lang != "de" or (t or "").count(w) >= 2], t
