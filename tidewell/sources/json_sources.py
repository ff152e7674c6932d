"""JSON collectors, each a description of where things stand in the payload.

A payload (one response a row, column ``body``) is parsed with a schema, its list exploded with
positions, filtered, and projected. Ranks count either all entries (gaps where some go) or those that stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import numbers, times
from tidewell.functions.text import comment_text
from tidewell.functions.urls import domain
from tidewell.sources.records import absent_if_blank, record, signals


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


@dataclass(frozen=True)
class JsonSource:
    name: str
    schema: str
    items: str
    title: Callable[[], Column]
    url: Callable[[], Column]
    external_id: Callable[[], Column]
    keep: Callable[[], Column] | None = None
    description: Callable[[], Column] | None = None
    published_at: Callable[[], Column] | None = None
    signals: dict[str, Callable[[], Column]] = field(default_factory=dict)
    gaps: bool = True


def _c(path: str) -> Callable[[], Column]:
    return lambda: F.col(path)


def _https(path: str) -> Callable[[], Column]:
    return lambda: F.regexp_replace(F.regexp_replace(F.col(path), "^//", "https://"), "^http:", "https:")


def _reddit_url() -> Column:
    own = F.concat(F.lit("https://www.reddit.com"), F.col("e.data.permalink"))
    return F.when(F.col("e.data.is_self") | domain(F.col("e.data.url")).rlike(r"(^|\.)(reddit\.com|redd\.it)$") | ~_filled(F.col("e.data.url")), own).otherwise(F.col("e.data.url"))


def _best(path: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(f"{path}.{n}.url") for n in names])


def _tweet_total() -> Column:
    m = "e.public_metrics."
    return sum((F.coalesce(F.col(m + n), F.lit(0)) for n in ("retweet_count", "reply_count", "quote_count")), F.coalesce(F.col(m + "like_count"), F.lit(0)))


SOURCES = {
    s.name: s
    for s in (
        JsonSource(
            "reddit",
            "data STRUCT<after: STRING, children: ARRAY<STRUCT<kind: STRING, data: STRUCT<id: STRING, title: STRING, permalink: STRING, url: STRING, is_self: BOOLEAN,"
            " over_18: BOOLEAN, score: LONG, upvote_ratio: DOUBLE, num_comments: LONG, selftext: STRING, created_utc: DOUBLE, thumbnail: STRING>>>>",
            "data.children", _c("e.data.title"), _reddit_url, _c("e.data.id"),
            keep=lambda: (F.col("e.kind") == "t3") & ~F.coalesce("e.data.over_18", F.lit(False)),
            description=lambda: F.substring("e.data.selftext", 1, 1000), published_at=lambda: F.timestamp_seconds("e.data.created_utc"),
            signals={"score": _c("e.data.score"), "upvotes": lambda: numbers.reddit_upvotes(F.col("e.data.score"), F.col("e.data.upvote_ratio")), "comments": _c("e.data.num_comments")},
        ),
        JsonSource(
            "hackernews", "items ARRAY<STRUCT<id: LONG, title: STRING, url: STRING, text: STRING, score: LONG, descendants: LONG, time: LONG>>", "items",
            _c("e.title"), lambda: F.coalesce(absent_if_blank(F.col("e.url")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("e.id"))), lambda: F.col("e.id").cast("string"),
            keep=lambda: _filled(F.col("e.title")), description=lambda: F.substring(comment_text(F.col("e.text")), 1, 1000), published_at=lambda: times.from_epoch(F.col("e.time")),
            signals={"score": _c("e.score"), "comments": _c("e.descendants")},
        ),
        JsonSource(
            "youtube",
            "nextPageToken STRING, items ARRAY<STRUCT<id: STRING, snippet: STRUCT<title: STRING, description: STRING, publishedAt: STRING, thumbnails: STRUCT<maxres: STRUCT<url: STRING>,"
            " high: STRUCT<url: STRING>, medium: STRUCT<url: STRING>, default: STRUCT<url: STRING>>>, statistics: STRUCT<viewCount: STRING, likeCount: STRING, commentCount: STRING>>>",
            "items", _c("e.snippet.title"), lambda: F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("e.id")), _c("e.id"),
            keep=lambda: _filled(F.col("e.id")), description=lambda: F.substring("e.snippet.description", 1, 1000), published_at=lambda: times.parsed_iso(F.col("e.snippet.publishedAt")),
            signals={
                "views": lambda: F.col("e.statistics.viewCount").try_cast("long"), "upvotes": lambda: F.col("e.statistics.likeCount").try_cast("long"),
                "comments": lambda: F.col("e.statistics.commentCount").try_cast("long"),
            },
        ),
        JsonSource(
            "twitter",
            "data ARRAY<STRUCT<id: STRING, text: STRING, author_id: STRING, created_at: STRING, public_metrics: STRUCT<like_count: LONG, retweet_count: LONG, reply_count: LONG, quote_count: LONG>>>",
            "data", lambda: F.substring("e.text", 1, 200), lambda: F.concat(F.lit("https://twitter.com/i/web/status/"), F.col("e.id")), _c("e.id"),
            keep=lambda: _tweet_total() >= 100, description=lambda: F.when(F.length("e.text") > 200, F.col("e.text")), published_at=lambda: times.parsed_iso(F.col("e.created_at")),
            signals={
                "upvotes": _c("e.public_metrics.like_count"), "comments": _c("e.public_metrics.reply_count"),
                "shares": lambda: F.coalesce("e.public_metrics.retweet_count", F.lit(0)) + F.coalesce("e.public_metrics.quote_count", F.lit(0)),
            },
        ),
        JsonSource(
            "wikipedia", "items ARRAY<STRUCT<articles: ARRAY<STRUCT<article: STRING, views: LONG>>>>", "items[0].articles",
            lambda: F.replace("e.article", F.lit("_"), F.lit(" ")), lambda: F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("e.article")), _c("e.article"),
            keep=lambda: ~F.col("e.article").isin("Main_Page", "-") & ~F.col("e.article").rlike(r"^(Special|Wikipedia|Portal|Help|File|Category|Template|User|Talk):"),
            signals={"views": _c("e.views")}, gaps=False,
        ),
        JsonSource(
            "sina", "result STRUCT<data: ARRAY<STRUCT<oid: STRING, title: STRING, url: STRING, wapurl: STRING, intro: STRING>>>", "result.data", _c("e.title"),
            lambda: F.regexp_replace(F.coalesce(absent_if_blank(F.col("e.url")), F.col("e.wapurl")), "^http:", "https:"), _c("e.oid"),
            keep=lambda: _filled(F.col("e.title")), description=_c("e.intro"), published_at=lambda: times.url_date(F.coalesce(absent_if_blank(F.col("e.url")), F.col("e.wapurl"))).cast("timestamp"),
        ),
        JsonSource(
            "nyt", "section STRING, results ARRAY<STRUCT<uri: STRING, title: STRING, abstract: STRING, url: STRING, published_date: STRING>>", "results", _c("e.title"), _c("e.url"),
            lambda: F.concat_ws("_", F.col("d.section"), F.coalesce("e.uri", "e.url")), keep=lambda: _filled(F.col("e.title")) & _filled(F.col("e.url")), description=_c("e.abstract"),
            published_at=lambda: times.parsed_iso(F.col("e.published_date")), gaps=False,
        ),
        JsonSource(
            "bilibili", "data STRUCT<list: ARRAY<STRUCT<bvid: STRING, title: STRING, desc: STRING, pic: STRING, pubdate: LONG, stat: STRUCT<view: LONG, like: LONG, reply: LONG, share: LONG, coin: LONG>>>>",
            "data.list", _c("e.title"), lambda: F.concat(F.lit("https://www.bilibili.com/video/"), F.col("e.bvid")), _c("e.bvid"), description=_c("e.desc"), published_at=lambda: times.from_epoch(F.col("e.pubdate")),
            signals={"views": _c("e.stat.view"), "likes": _c("e.stat.like"), "comments": _c("e.stat.reply"), "shares": _c("e.stat.share"), "coins": _c("e.stat.coin")},
        ),
        JsonSource(
            "weibo", "ok INT, data STRUCT<realtime: ARRAY<STRUCT<word: STRING, note: STRING, num: STRING>>>", "data.realtime", lambda: F.coalesce("e.note", "e.word"),
            lambda: F.concat(F.lit("https://s.weibo.com/weibo?q="), F.url_encode("e.word")), _c("e.word"), keep=lambda: _filled(F.col("e.word")) & (F.col("d.ok") == 1),
            signals={"hot_score": lambda: F.coalesce(F.col("e.num").try_cast("long"), F.lit(0))},
        ),
        JsonSource(
            "zhihu", "data ARRAY<STRUCT<target: STRUCT<id: STRING, title: STRING, excerpt: STRING>, detail_text: STRING>>", "data", _c("e.target.title"),
            lambda: F.concat(F.lit("https://www.zhihu.com/question/"), F.col("e.target.id")), _c("e.target.id"), keep=lambda: _filled(F.col("e.target.title")) & _filled(F.col("e.target.id")),
            description=_c("e.target.excerpt"), signals={"hot_score": lambda: numbers.cjk_number(F.col("e.detail_text"))},
        ),
        JsonSource(
            "devto", "items ARRAY<STRUCT<id: LONG, title: STRING, description: STRING, url: STRING, canonical_url: STRING, positive_reactions_count: LONG, comments_count: LONG, published_at: STRING>>", "items",
            _c("e.title"), lambda: F.coalesce(absent_if_blank(F.col("e.url")), F.col("e.canonical_url")), lambda: F.col("e.id").cast("string"), keep=lambda: _filled(F.col("e.title")),
            description=lambda: F.substring("e.description", 1, 1000), published_at=lambda: times.parsed_iso(F.col("e.published_at")), signals={"upvotes": _c("e.positive_reactions_count"), "comments": _c("e.comments_count")},
        ),
        JsonSource(
            "lobsters", "items ARRAY<STRUCT<short_id: STRING, title: STRING, url: STRING, comments_url: STRING, score: LONG, comment_count: LONG, created_at: STRING>>", "items",
            _c("e.title"), lambda: F.coalesce(absent_if_blank(F.col("e.url")), F.col("e.comments_url")), _c("e.short_id"), keep=lambda: _filled(F.col("e.title")),
            published_at=lambda: times.parsed_iso(F.col("e.created_at")), signals={"score": _c("e.score"), "upvotes": _c("e.score"), "comments": _c("e.comment_count")},
        ),
        JsonSource(
            "niconico", "data STRUCT<items: ARRAY<STRUCT<id: STRING, title: STRING, registeredAt: STRING, count: STRUCT<view: LONG, comment: LONG, mylist: LONG, like: LONG>>>>", "data.items", _c("e.title"),
            lambda: F.concat(F.lit("https://www.nicovideo.jp/watch/"), F.col("e.id")), _c("e.id"), published_at=lambda: times.parsed_iso(F.col("e.registeredAt")),
            signals={"views": _c("e.count.view"), "comments": _c("e.count.comment"), "mylist": _c("e.count.mylist"), "likes": _c("e.count.like")},
        ),
        JsonSource(
            "stackoverflow", "items ARRAY<STRUCT<question_id: LONG, title: STRING, link: STRING, score: LONG, view_count: LONG, answer_count: LONG, creation_date: LONG>>", "items", _c("e.title"), _c("e.link"),
            lambda: F.col("e.question_id").cast("string"), published_at=lambda: times.from_epoch(F.col("e.creation_date")), signals={"score": _c("e.score"), "views": _c("e.view_count"), "comments": _c("e.answer_count")},
        ),
        JsonSource(
            "v2ex", "items ARRAY<STRUCT<id: LONG, title: STRING, url: STRING, content: STRING, replies: LONG, created: LONG>>", "items", _c("e.title"), _c("e.url"), lambda: F.col("e.id").cast("string"),
            keep=lambda: _filled(F.col("e.title")), description=lambda: F.substring("e.content", 1, 1000), published_at=lambda: times.from_epoch(F.col("e.created")), signals={"comments": _c("e.replies")},
        ),
        JsonSource(
            "producthunt", "data STRUCT<posts: STRUCT<edges: ARRAY<STRUCT<node: STRUCT<id: STRING, name: STRING, tagline: STRING, description: STRING, url: STRING, votesCount: LONG, commentsCount: LONG, createdAt: STRING>>>>>",
            "data.posts.edges", lambda: F.concat_ws(" — ", "e.node.name", absent_if_blank(F.col("e.node.tagline"))), _c("e.node.url"), _c("e.node.id"), description=_c("e.node.description"),
            published_at=lambda: times.parsed_iso(F.col("e.node.createdAt")), signals={"upvotes": _c("e.node.votesCount"), "comments": _c("e.node.commentsCount")},
        ),
        JsonSource(
            "google_trends", "items ARRAY<STRUCT<title: STRING, link: STRING, traffic: STRING, pubDate: STRING>>", "items", _c("e.title"),
            lambda: F.coalesce(absent_if_blank(F.col("e.link")), F.concat(F.lit("https://www.google.com/search?q="), F.url_encode("e.title"))), _c("e.title"), keep=lambda: _filled(F.col("e.title")),
        ),
    )
}


def parsed(payloads: DataFrame, source: str | JsonSource, limit: int = 200, as_of: Column | None = None) -> DataFrame:
    """Items of a source's payloads, at most ``limit`` entries of each response.

    A body that is no JSON, or lacks the list, gives no items. With ``as_of``, items without a time get it.
    """
    s = SOURCES[source] if isinstance(source, str) else source
    rows = payloads.select(F.from_json("body", s.schema).alias("d")).select("d", F.posexplode(F.expr(f"d.{s.items}")).alias("pos", "e"))
    rows = rows.filter(F.col("pos") < limit) if s.gaps else rows
    rows = rows.filter(F.coalesce(s.keep(), F.lit(False))) if s.keep else rows
    if s.gaps:
        rows = rows.withColumn("rank", F.col("pos") + 1)
    else:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy("pos"))).filter(F.col("rank") <= limit)
    at = s.published_at() if s.published_at else F.lit(None).cast("timestamp")
    given = signals(**{k: v() for k, v in s.signals.items()})
    if s.name == "google_trends":
        given = signals(score=F.lit(limit) - F.col("pos"))
    return record(
        rows, s.name, external_id=s.external_id(), title=s.title(), url=s.url(), description=s.description() if s.description else F.lit(None),
        rank_position=F.col("rank"), published_at=F.coalesce(at, as_of) if as_of is not None else at, signals=given, raw=F.to_json("e"),
    )


def comments(payloads: DataFrame, text: str, limit: int, length: int = 300) -> DataFrame:
    """The first comments of each post (``post_id``, ``comments`` array of HTML): no deleted or blank ones, cut."""
    cleaned = F.transform(F.col(text), lambda c: F.substring(comment_text(c), 1, length))
    kept = F.filter(cleaned, lambda c: (c != "") & ~c.isin("[deleted]", "[removed]"))
    return payloads.select("post_id", F.slice(kept, 1, limit).alias("comments"))


def joined_modes(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Two lists as one: half the limit each, ranks go on."""
    a = first.orderBy("rank_position").limit(limit // 2)
    offset = a.agg(F.coalesce(F.max("rank_position"), F.lit(0)).alias("offset"))
    b = second.orderBy("rank_position").limit(limit - limit // 2).crossJoin(F.broadcast(offset))
    return a.unionByName(b.withColumn("rank_position", F.col("rank_position") + F.col("offset")).drop("offset"))


def with_authors(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """Items with the name of their author where it is known."""
    author = F.get_json_object("raw", "$.author_id")
    return tweets.withColumn("author_id", author).join(users.select(F.col("id").alias("author_id"), "username"), "author_id", "left")


def recent_only(items: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Items that are not older than ``hours``; those without a time stay."""
    return items.filter(F.col("published_at").isNull() | (F.col("published_at") >= as_of - F.make_interval(hours=F.lit(hours))))
