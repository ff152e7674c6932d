"""Queries of the collectors: payloads made from ``documents``, parsed by each source's rules; the SQL goes without payloads.

Twenty documents in a row, by id, are one response. Each source has entries that its rules leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.catalogue import query
from tidewell.sources import feeds, html_sources, json_sources, records
from tidewell.sources.adapters import now, read

#: Source: an entry in Spark SQL over ``i`` (the document's id) and ``t`` (a title), and what surrounds the list of entries.
ENTRIES = {
    "reddit": ("named_struct('kind', if(i % 9 = 0, 't5', 't3'), 'data', named_struct('id', concat('r', i), 'title', t, 'permalink', concat('/r/x/', i), 'url', if(i % 4 = 0, 'https://i.redd.it/a.png', concat('https://e.example/', i)),"
               " 'is_self', i % 5 = 0, 'over_18', i % 11 = 0, 'score', i, 'upvote_ratio', 1.0, 'num_comments', i % 7))", '{"data": {"children": %s}}'),
    "hackernews": ("named_struct('id', i, 'title', if(i % 9 = 0, '', t), 'url', if(i % 3 = 0, '', concat('https://e.example/', i)), 'score', i % 50, 'descendants', i % 6, 'time', i * 1000)", '{"items": %s}'),
    "youtube": ("named_struct('id', if(i % 9 = 0, '', concat('v', i)), 'snippet', named_struct('title', t, 'publishedAt', '2024-01-05T00:00:00Z'), 'statistics', named_struct('viewCount', cast(i * 3 as string), 'likeCount', 'none'))", '{"items": %s}'),
    "twitter": ("named_struct('id', cast(i as string), 'text', t, 'created_at', '2024-01-05T00:00:00Z', 'public_metrics', named_struct('like_count', i % 200, 'retweet_count', 1, 'reply_count', 2, 'quote_count', 3))", '{"data": %s}'),
    "wikipedia": ("named_struct('article', if(i % 9 = 0, 'Main_Page', concat('Page_', i)), 'views', i)", '{"items": [{"articles": %s}]}'),
    "sina": ("named_struct('oid', concat('s', i), 'title', if(i % 9 = 0, ' ', t), 'url', if(i % 2 = 0, concat('http://n.example/2024-01-05/', i), ''), 'wapurl', concat('http://w.example/', i))", '{"result": {"data": %s}}'),
    "nyt": ("named_struct('uri', concat('u', i), 'title', t, 'url', if(i % 9 = 0, '', concat('https://e.example/', i)))", '{"section": "world", "results": %s}'),
    "bilibili": ("named_struct('bvid', concat('BV', i), 'title', t, 'pubdate', i * 1000, 'stat', named_struct('view', i, 'like', 0, 'reply', 4))", '{"data": {"list": %s}}'),
    "weibo": ("named_struct('word', if(i % 9 = 0, '', concat('w', i)), 'note', concat('note ', i), 'num', cast(i as string))", '{"ok": 1, "data": {"realtime": %s}}'),
    "zhihu": ("named_struct('target', named_struct('id', concat('q', i), 'title', if(i % 9 = 0, '', t)), 'detail_text', concat(i, ' 万热度'))", '{"data": %s}'),
    "devto": ("named_struct('id', i, 'title', if(i % 9 = 0, '', t), 'url', concat('https://dev.example/', i), 'positive_reactions_count', i % 30, 'comments_count', 0, 'published_at', '2024-01-05T00:00:00Z')", '{"items": %s}'),
    "lobsters": ("named_struct('short_id', concat('l', i), 'title', if(i % 9 = 0, '', t), 'url', if(i % 3 = 0, '', concat('https://e.example/', i)), 'comments_url', concat('https://l.example/s/', i), 'score', i % 40, 'comment_count', 2)", '{"items": %s}'),
    "niconico": ("named_struct('id', concat('sm', i), 'title', t, 'count', named_struct('view', i, 'comment', 1))", '{"data": {"items": %s}}'),
    "stackoverflow": ("named_struct('question_id', i, 'title', t, 'link', concat('https://s.example/q/', i), 'score', i % 5, 'view_count', i, 'answer_count', 1, 'creation_date', i * 1000)", '{"items": %s}'),
    "v2ex": ("named_struct('id', i, 'title', if(i % 9 = 0, '', t), 'url', concat('https://v.example/t/', i), 'replies', i % 8, 'created', i * 1000)", '{"items": %s}'),
    "producthunt": ("named_struct('node', named_struct('id', concat('p', i), 'name', concat('P', i), 'tagline', if(i % 3 = 0, '', 'does things'), 'url', concat('https://p.example/', i), 'votesCount', i % 100))", '{"data": {"posts": {"edges": %s}}}'),
    "google_trends": ("named_struct('title', if(i % 9 = 0, '', t), 'link', if(i % 2 = 0, concat('https://e.example/', i), ''), 'traffic', '200+', 'pubDate', '')", '{"items": %s}'),
}
#: Source: what its rules give in SQL: filter, id, title, url, one signal's name and value.
EXPECTED = {
    "reddit": ("i % 9 > 0 AND i % 11 > 0", "'r' || i", "t", "CASE WHEN i % 5 = 0 OR i % 4 = 0 THEN 'https://www.reddit.com/r/x/' || i ELSE 'https://e.example/' || i END", "upvotes", "i"),
    "hackernews": ("i % 9 > 0", "CAST(i AS VARCHAR)", "t", "CASE WHEN i % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || i ELSE 'https://e.example/' || i END", "score", "i % 50"),
    "youtube": ("i % 9 > 0", "'v' || i", "t", "'https://www.youtube.com/watch?v=v' || i", "views", "i * 3"),
    "twitter": ("i % 200 + 6 >= 100", "CAST(i AS VARCHAR)", "t", "'https://twitter.com/i/web/status/' || i", "upvotes", "i % 200"),
    "wikipedia": ("i % 9 > 0", "'Page_' || i", "'Page ' || i", "'https://en.wikipedia.org/wiki/Page_' || i", "views", "i"),
    "sina": ("i % 9 > 0", "'s' || i", "t", "CASE WHEN i % 2 = 0 THEN 'https://n.example/2024-01-05/' || i ELSE 'https://w.example/' || i END", "views", "0"),
    "nyt": ("i % 9 > 0", "'world_u' || i", "t", "'https://e.example/' || i", "views", "0"),
    "bilibili": ("true", "'BV' || i", "t", "'https://www.bilibili.com/video/BV' || i", "views", "i"),
    "weibo": ("i % 9 > 0", "'w' || i", "'note ' || i", "'https://s.weibo.com/weibo?q=w' || i", "hot_score", "i"),
    "zhihu": ("i % 9 > 0", "'q' || i", "t", "'https://www.zhihu.com/question/q' || i", "hot_score", "i * 10000"),
    "devto": ("i % 9 > 0", "CAST(i AS VARCHAR)", "t", "'https://dev.example/' || i", "upvotes", "i % 30"),
    "lobsters": ("i % 9 > 0", "'l' || i", "t", "CASE WHEN i % 3 = 0 THEN 'https://l.example/s/' || i ELSE 'https://e.example/' || i END", "score", "i % 40"),
    "niconico": ("true", "'sm' || i", "t", "'https://www.nicovideo.jp/watch/sm' || i", "views", "i"),
    "stackoverflow": ("true", "CAST(i AS VARCHAR)", "t", "'https://s.example/q/' || i", "views", "i"),
    "v2ex": ("i % 9 > 0", "CAST(i AS VARCHAR)", "t", "'https://v.example/t/' || i", "comments", "i % 8"),
    "producthunt": ("true", "'p' || i", "'P' || i || CASE WHEN i % 3 = 0 THEN '' ELSE ' — does things' END", "'https://p.example/' || i", "upvotes", "i % 100"),
    "google_trends": ("i % 9 > 0", "t", "t", "CASE WHEN i % 2 = 0 THEN 'https://e.example/' || i ELSE 'https://www.google.com/search?q=' || replace(t, ' ', '+') END", "views", "0"),
}
_TITLED = "titled AS (SELECT doc_id AS i, lang || ' title ' || doc_id AS t, doc_id // 20 AS feed, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS pos FROM documents)"


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and titles with the number of their response."""
    docs = read(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("i"), F.concat("lang", F.lit(" title "), "doc_id").alias("t"), F.floor(F.col("doc_id") / 20).alias("response"))


def _payloads(rows: DataFrame, entry: str, around: str) -> DataFrame:
    """Responses: a JSON list of up to 20 entries in the order of ids, with what surrounds it."""
    entries = rows.groupBy("response").agg(F.array_sort(F.collect_list(F.struct("i", F.expr(entry).alias("e")))).alias("l"))
    before, after = around.split("%s")
    return entries.select("response", F.concat(F.lit(before), F.to_json(F.transform("l", lambda x: x["e"])), F.lit(after)).alias("body"))


def _items_sql(source: str) -> str:
    keep, key, title, url, signal, value = EXPECTED[source]
    gaps = json_sources.SOURCES[source].gaps
    place = "pos + 1" if gaps else "row_number() OVER (PARTITION BY feed ORDER BY pos)"
    return (
        f"WITH {_TITLED} SELECT {key} AS external_id, {title} AS title, {url} AS url, CAST({place} AS INTEGER) AS rank_position, "
        f"CASE WHEN {value} > 0 THEN CAST({value} AS DOUBLE) END AS {signal} FROM titled WHERE {keep}"
    )


def _register(source: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        items = json_sources.parsed(_payloads(_titled(spark, sf), *ENTRIES[source]), source)
        signal = EXPECTED[source][4]
        return items.select("external_id", "title", "url", "rank_position", F.try_element_at("signals", F.lit(signal)).alias(signal))

    run.__name__, run.__doc__ = f"source_{source}", f"Items of the source {source}."
    query(_items_sql(source))(run)


for _name in ENTRIES:
    _register(_name)


def _feed_body(rows: DataFrame) -> DataFrame:
    """RSS documents of 20 entries, each titled with markup; every ninth has no link."""
    i = F.col("i")
    link = F.when(i % 9 > 0, F.concat(F.lit("<link>https://e.example/"), i, F.lit("</link>"))).otherwise("")
    guid = F.when(i % 2 == 0, F.concat(F.lit("<guid>g"), i, F.lit("</guid>"))).otherwise("")
    at = F.lit("<pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate>")
    item = F.concat(F.lit("<item><title>"), F.col("t"), F.lit("</title>"), link, guid, F.lit("<description>&lt;p&gt;about "), i, F.lit("&lt;/p&gt;</description>"), at, F.lit("</item>"))
    grouped = rows.groupBy(F.col("response").alias("feed")).agg(F.array_sort(F.collect_list(F.struct("i", item.alias("x")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["x"]), "")
    return grouped.select("feed", F.concat(F.lit("<rss><channel>"), body, F.lit("</channel></rss>")).alias("body"))


@query(
    f"""WITH {_TITLED} SELECT CASE WHEN i % 2 = 0 THEN 'g' || i ELSE 'https://e.example/' || i END AS external_id, t AS title, 'about ' || i AS description, 'https://e.example/' || i AS url,
  CAST(pos + 1 AS INTEGER) AS rank_position, '2024-01-05 10:00:00' AS published_at FROM titled WHERE i % 9 > 0"""
)
def source_rss(spark: SparkSession, sf: str) -> DataFrame:
    """Feed entries with title and link; the ten thin collectors differ from this one by their address alone."""
    items = feeds.parsed(_feed_body(_titled(spark, sf)), "bbc")
    return items.select("external_id", "title", "description", "url", "rank_position", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query(
    f"""WITH {_TITLED}, e AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'g' || i ELSE 'https://e.example/' || i END AS external_id FROM titled WHERE i % 9 > 0)
SELECT feed, arg_min(external_id, pos) AS cursor, 0 AS unchanged, CAST(count(*) AS INTEGER) AS changed FROM e GROUP BY 1"""
)
def rss_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """The cursor of every feed is its first entry's id; an unchanged tag gives no items."""
    items = feeds.parsed(_feed_body(_titled(spark, sf)), keep=("feed",))
    tagged = feeds.unless_unchanged(items, "tag", "tag").withColumn("same", F.lit(1)).unionByName(feeds.unless_unchanged(items, "tag", "older").withColumn("same", F.lit(0)))
    counts = tagged.groupBy("feed").agg(F.sum("same").cast("int").alias("unchanged"), F.sum(1 - F.col("same")).cast("int").alias("changed"))
    return feeds.cursors(items).join(counts, "feed")


@query(
    f"""WITH {_TITLED}, f AS (SELECT i, feed // 3 AS page, feed % 3 AS nth, pos FROM titled WHERE i % 9 > 0 AND pos < 13), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY nth, pos) AS rank_position FROM f)
SELECT page, 'https://e.example/' || i AS url, CAST(rank_position AS INTEGER) AS rank_position FROM r WHERE rank_position <= 40"""
)
def rss_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Every three feeds in a row as one, the first given twice: a third of the limit each, an address once, ranked anew."""
    items = feeds.parsed(_feed_body(_titled(spark, sf)), keep=("feed",)).withColumn("page", F.floor(F.col("feed") / 3))
    return feeds.combined(items.withColumn("feed_no", F.col("feed") % 3), 40, 3, ("page",)).select("page", "url", "rank_position")


@query("SELECT n AS id, 'Ranking item ' || n AS title, CAST(n AS INTEGER) AS rank_position, 10000.0 - n * 100 AS views, 500.0 - n * 10 AS comments FROM (SELECT unnest(range(1, 21)) AS n)")
def source_stub(spark: SparkSession, sf: str) -> DataFrame:
    rows = html_sources.synthetic_ranking(spark)
    return rows.select(F.regexp_extract("external_id", r"(\d+)$", 1).cast("long").alias("id"), "title", "rank_position", F.col("signals")["views"].alias("views"), F.col("signals")["comments"].alias("comments"))


@query(
    """SELECT conv_id, string_agg(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300), chr(10) ORDER BY turn) AS said
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') WHERE rn <= 3 GROUP BY 1"""
)
def post_comments(spark: SparkSession, sf: str) -> DataFrame:
    """The first three comments of posts; markup, deleted and blank ones go."""
    turns = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("post_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    marked = F.concat(F.array(F.lit("[deleted]"), F.lit("<p> </p>")), F.transform("l", lambda x: F.concat(F.lit("<p>"), x["text"], F.lit("</p>"))))
    found = json_sources.comments(turns.select("post_id", marked.alias("c")), "c", 3)
    return found.filter(F.size("comments") > 0).select(F.col("post_id").alias("conv_id"), F.array_join("comments", "\n").alias("said"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS signals, CASE doc_id % 4 WHEN 0 THEN 'zh-Hans' WHEN 1 THEN 'pt-PT' WHEN 2 THEN 'xx-XX' ELSE 'ja-JP' END AS locale,
  CASE WHEN doc_id % 5 = 0 THEN 'mine' ELSE 'extra' END AS kept, CAST(doc_id % 97 * 10000 AS BIGINT) AS naive FROM documents"""
)
def record_adapters(spark: SparkSession, sf: str) -> DataFrame:
    """Signals without zeros, locales of bare languages, extras that never overwrite."""
    i = F.col("doc_id")
    given = records.signals(views=i + 1, likes=F.when(i % 3 == 0, 5).otherwise(0), shares=F.lit(None).cast("long"))
    language = F.when(i % 4 == 0, "zh").when(i % 4 == 1, "pt-PT").when(i % 4 == 2, "xx").otherwise("ja")
    base = F.when(i % 5 == 0, F.create_map(F.lit("k"), F.lit("mine"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    merged = records.merged_extras(base, F.create_map(F.lit("k"), F.lit("extra")))
    return read(spark, sf, "documents").select(
        "doc_id", F.size(given).alias("signals"), records.default_locale(language).alias("locale"), merged["k"].alias("kept"),
        html_sources.naive_score(F.concat(i % 97, F.lit("万"))).alias("naive"),
    )


@query(
    f"""WITH {_TITLED} SELECT 'v' || i AS external_id, CAST(pos + 1 AS INTEGER) AS rank_position, i % 24 AS hours FROM titled WHERE i % 48 < 24"""
)
def source_recent(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the last day only, as searches and channels are asked for."""
    hours = "cast(i % 48 as int)"
    entry = f"named_struct('id', concat('v', i), 'snippet', named_struct('title', t, 'publishedAt', date_format(timestamp'2024-01-31 00:00:00' - make_interval(0, 0, 0, 0, {hours}, 0, 0), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")))"
    items = json_sources.parsed(_payloads(_titled(spark, sf), entry, '{"items": %s}'), "youtube")
    recent = json_sources.recent_only(items, now(), 23)
    return recent.select("external_id", "rank_position", (F.substring("external_id", 2, 12).cast("long") % 24).alias("hours"))


@query(f"""WITH {_TITLED} SELECT i AS doc_id, CASE WHEN i % 5 > 0 THEN 'About ' || t ELSE '' END AS description, CASE WHEN i % 5 > 0 THEN 'Paper & Co ' || (i % 7) ELSE '' END AS source FROM titled""")
def news_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregated news: the first entry's title and source out of each summary's list; none where there is no list."""
    i = F.col("i")
    entry = F.concat(F.lit('<ol><li><a href="https://e.example/x" target="_blank">About <b>'), F.col("t"), F.lit('</b></a>&nbsp;<font color="#6f6f6f">Paper &amp; Co '), (i % 7).cast("string"), F.lit('</font></li><li><a href="y">Second</a><font>Other</font></li></ol>'))
    rows = _titled(spark, sf).withColumn("html", F.when(i % 5 > 0, entry).otherwise("plain"))
    return rows.select(i.alias("doc_id"), feeds.news_description(F.col("html")).alias("description"), feeds.news_source(F.col("html")).alias("source"))
