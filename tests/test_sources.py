"""Parsers of payloads, sinks and streams."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewell.operators.policy import replay_breaker
from tidewell.sources import feeds, html_sources, json_sources, records, sinks
from tidewell.streaming import pipelines

RSS = """<rss><channel>
<item><title>First &amp; best</title><link>https://e.com/1</link><guid>g1</guid><description>&lt;p&gt;Hello &lt;b&gt;you&lt;/b&gt;&lt;/p&gt;</description><pubDate>Wed, 31 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title></title><link>https://e.com/2</link></item>
<item><title>Third</title><link>https://e.com/3</link></item></channel></rss>"""
ATOM = '<feed><entry><title>A</title><link href="https://e.com/a"/><id>urn:a</id><updated>2024-01-31T10:00:00Z</updated></entry></feed>'


def body(spark, payload):
    return spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload),)], "body string")


def test_feeds(spark):
    rows = feeds.parsed(spark.createDataFrame([("f", RSS)], "feed string, body string")).orderBy("rank_position").collect()
    assert [(r.external_id, r.title, r.description, r.rank_position) for r in rows] == [("g1", "First & best", "Hello you", 1), ("https://e.com/3", "Third", "", 3)]
    assert rows[0].published_at == datetime(2024, 1, 31, 10) and rows[1].published_at is None
    atom = feeds.parsed(spark.createDataFrame([("f", ATOM)], "feed string, body string")).collect()
    assert [(r.external_id, r.url, r.published_at) for r in atom] == [("urn:a", "https://e.com/a", datetime(2024, 1, 31, 10))]
    both = [feeds.parsed(spark.createDataFrame([("f", RSS)], "feed string, body string")) for _ in range(2)]
    two = both[0].withColumn("feed_no", F.lit(0)).unionByName(both[1].withColumn("feed_no", F.lit(1)))
    assert [(r.url, r.rank_position) for r in feeds.combined(two, 30, 2).orderBy("rank_position").collect()] == [("https://e.com/1", 1), ("https://e.com/3", 2)]
    assert feeds.cursors(both[0].withColumn("feed", F.lit("f"))).first().cursor == "g1"
    assert feeds.unless_unchanged(both[0], "e", "e").count() == 0


def test_json_sources(spark):
    post = lambda i, **kw: {"kind": "t3", "data": {"id": str(i), "title": f"t{i}", "permalink": f"/r/x/{i}", "url": "https://e.com/p", "score": 100, "upvote_ratio": 0.75, "num_comments": 3, **kw}}
    reddit = {"data": {"after": "c", "children": [post(1), post(2, over_18=True), {"kind": "t1", "data": {"id": "9"}}, post(4, is_self=True)]}}
    rows = json_sources.parsed(body(spark, reddit), "reddit").collect()
    assert [(r.external_id, r.rank_position, r.url) for r in rows] == [("1", 1, "https://e.com/p"), ("4", 4, "https://www.reddit.com/r/x/4")]
    assert rows[0].signals == {"score": 100.0, "upvotes": 200.0, "comments": 3.0}
    hn = {"items": [{"id": 1, "title": "a", "score": 5, "time": 0}, {"id": 2}, {"id": 3, "title": "c", "url": "u", "text": "<p>x"}]}
    rows = json_sources.parsed(body(spark, hn), "hackernews").collect()
    assert [(r.external_id, r.url, r.rank_position) for r in rows] == [("1", "https://news.ycombinator.com/item?id=1", 1), ("3", "u", 3)]
    wiki = {"items": [{"articles": [{"article": "Main_Page", "views": 9}, {"article": "Real_One", "views": 8}, {"article": "Special:Search", "views": 7}, {"article": "Two", "views": 6}]}]}
    assert [(r.title, r.rank_position) for r in json_sources.parsed(body(spark, wiki), "wikipedia").collect()] == [("Real One", 1), ("Two", 2)]
    metrics = lambda n: {"like_count": n, "retweet_count": 0, "reply_count": 0, "quote_count": 1}
    tweets = {"data": [{"id": "1", "text": "x" * 250, "author_id": "7", "public_metrics": metrics(99)}, {"id": "2", "text": "y", "public_metrics": metrics(98)}]}
    rows = json_sources.parsed(body(spark, tweets), "twitter")
    users = spark.createDataFrame([("7", "name")], "id string, username string")
    got = json_sources.with_authors(rows, users).collect()
    assert [(r.external_id, len(r.title), len(r.description), r.username) for r in got] == [("1", 200, 250, "name")]
    yt = {"items": [{"id": "a", "snippet": {"title": "t", "publishedAt": "2024-01-31T00:00:00Z"}, "statistics": {"viewCount": "10", "likeCount": "x"}}]}
    rows = json_sources.parsed(body(spark, yt), "youtube")
    assert rows.first().signals == {"views": 10.0}
    assert [r.rank_position for r in json_sources.joined_modes(rows, rows, 4).orderBy("rank_position").collect()] == [1, 2]
    assert json_sources.parsed(body(spark, "not json"), "devto").count() == 0
    zh = {"data": [{"target": {"id": "5", "title": "q"}, "detail_text": "3856万"}, {"target": {"id": "6"}}]}
    assert json_sources.parsed(body(spark, zh), "zhihu").first().signals == {"hot_score": 38_560_000.0}
    so = {"items": [{"question_id": 1, "title": "t", "link": "l"}]}
    assert json_sources.parsed(body(spark, so), "stackoverflow", as_of=F.lit("2024-01-31").cast("timestamp")).first().published_at == datetime(2024, 1, 31)
    said = spark.createDataFrame([(1, ["[deleted]", "<p>a&gt;b</p>", "", "c"])], "post_id int, comments array<string>")
    assert json_sources.comments(said, "comments", 1).first().comments == ["a>b"]


def test_every_json_source_parses_its_schema(spark):
    for name in json_sources.SOURCES:
        assert json_sources.parsed(body(spark, "{}"), name).count() == 0


def test_html_sources(spark):
    html = '<a href="/2024/01/31/12345678/">12 Some long headline</a><a class=x href=\'/2024/01/31/12345678/\'>again, the same</a><a href="/x">no</a>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rules = html_sources.LinkRules("t", href=r"/\d{7,}/", min_title=4, base="https://n.com/list", strip_rank=True)
    got = html_sources.extracted(pages, rules).collect()
    assert [(r.title, r.url, r.rank_position, r.external_id, r.published_at) for r in got] == [("Some long headline", "https://n.com/2024/01/31/12345678/", 1, "12345678", datetime(2024, 1, 31))]
    assert html_sources.synthetic_ranking(spark).count() == 20
    assert spark.range(1).select(html_sources.naive_score(F.lit("1.2万"))).first()[0] == 120000


def test_records(spark):
    one = spark.range(1)
    assert one.select(records.default_locale(F.lit("fr"))).first()[0] == "fr-FR" and one.select(records.default_locale(F.lit("xx"))).first()[0] == "xx-XX"
    base, extra = F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(9), F.lit("b"), F.lit(2))
    assert one.select(records.merged_extras(base, extra)).first()[0] == {"a": 1, "b": 2}


def test_sinks_are_idempotent(spark, tmp_path):
    rows = [("t", "u", datetime(2024, 1, 1), "1"), ("T ", "u", datetime(2024, 1, 2), "2"), ("x", "u", datetime(2024, 1, 2), "3")]
    df = spark.createDataFrame(rows, "title string, url string, collected_at timestamp, external_id string")
    path = str(tmp_path / "items")
    sinks.append_new(df, path)
    sinks.append_new(df, path)
    assert spark.read.parquet(path).count() == 2
    counters = spark.createDataFrame([("app:metrics:example.com:2026-02-18-15:direct_requests", 10), ("app:metrics:example.com:2026-02-18-15:budget_blocked", 2), ("bad", 1)], "name string, value long")
    got = sinks.parsed_counters(counters).collect()
    assert [(r.domain, r.direct_requests, r.budget_blocked) for r in got] == [("example.com", 10, 2)]


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    rows = [("d", datetime(2024, 1, 1, 0, m), s) for m, s in ((1, 200), (2, 302), (3, 429), (59, 500))] + [("d", datetime(2024, 1, 1, 5), 200)]
    spark.createDataFrame(rows, "domain string, ts timestamp, status int").write.parquet(str(tmp_path / "log"))
    stream = pipelines.files(spark, str(tmp_path / "log"), "domain string, ts timestamp, status int")
    _drain(pipelines.hourly_counters(stream).writeStream.format("memory").queryName("hours").outputMode("update").start())
    got = {r.hour.hour: (r.requests_2xx, r.requests_4xx, r.requests_5xx) for r in spark.table("hours").collect()}
    assert got == {0: (2, 1, 1), 5: (1, 0, 0)}

    items = [("t", "u", datetime(2024, 1, 1)), (" T", "u", datetime(2024, 1, 1)), ("x", "u", datetime(2024, 1, 1))]
    spark.createDataFrame(items, "title string, url string, collected_at timestamp").write.parquet(str(tmp_path / "items"))
    stream = pipelines.files(spark, str(tmp_path / "items"), "title string, url string, collected_at timestamp")
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    pipelines.each_batch(pipelines.deduplicated(stream), at, pipelines.idempotent(out)).awaitTermination()
    pipelines.each_batch(pipelines.deduplicated(stream), at, pipelines.idempotent(out)).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_streamed_breaker_equals_replay(spark, tmp_path):
    events = [(f"d{i % 3}", i * 20, i, "success" if i % 7 == 0 else "other") for i in range(90)]
    df = spark.createDataFrame(events, "domain string, seconds long, request_id long, outcome string")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = pipelines.files(spark, str(tmp_path / "e"), "domain string, seconds long, request_id long, outcome string")
    _drain(pipelines.breaker(stream, 3, 100).writeStream.format("memory").queryName("breaker").outputMode("append").start())
    assert sorted(map(tuple, spark.table("breaker").collect())) == sorted(map(tuple, replay_breaker(df, 3, 100).collect()))
