"""RSS and Atom: parsed by Spark's XML functions, one feed document a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import without_tags
from tidewell.sources.records import record

_ITEM = "title:string,link:string,guid:string,id:string,description:string,summary:string,pubDate:string,published:string,updated:string"
_SCHEMA = f"channel STRUCT<item: ARRAY<STRUCT<{_ITEM}>>>, entry ARRAY<STRUCT<{_ITEM.replace('link:string', 'link:struct<_href:string>')}>>"
_RFC822 = "d MMM yyyy HH:mm:ss Z"

#: One parser, ten feeds: names of collectors that differ by their settings alone.
WRAPPERS = ("aljazeera", "ap", "bbc", "billboard", "guardian", "hatena", "ign", "polygon", "reuters", "variety")


def feed_time(c: Column) -> Column:
    zoned = F.regexp_replace(F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT)\b", "+0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit(_RFC822)), F.try_to_timestamp(c))


def parsed(feeds: DataFrame, source: str = "rss", limit: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of feed documents (``feed``, ``body``): entries without title or link go, ranks count them.

    Ids: id, guid, url, in this order; times: published, then updated; descriptions lose their markup and
    keep 2000 characters. ``limit``: the first entries of a feed that are looked at. ``keep``: columns (``feed``) to go along.
    """
    doc = feeds.select("feed", F.from_xml("body", _SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    shape = lambda e, link: F.struct(
        e["title"].alias("title"), link.alias("link"), e["id"].alias("id"), e["guid"].alias("guid"),
        F.coalesce(e["description"], e["summary"]).alias("description"), F.coalesce(e["pubDate"], e["published"], e["updated"]).alias("at"),
    )
    rss = F.transform(F.col("d.channel.item"), lambda e: shape(e, e["link"]))
    atom = F.transform(F.col("d.entry"), lambda e: shape(e, e["link"]["_href"]))
    rows = doc.select("feed", F.posexplode(F.coalesce(rss, atom)).alias("pos", "e"))
    if limit is not None:
        rows = rows.filter(F.col("pos") < limit)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.filter(blank(F.col("e.title")).isNotNull() & blank(F.col("e.link")).isNotNull())
    out = rows.select("feed", "pos", "e.*")
    return record(
        out.withColumn("raw", F.to_json(F.struct("title", "link", "id", "guid", "description", "at"))), source, keep,
        external_id=F.coalesce(blank(F.col("id")), blank(F.col("guid")), F.col("link")), title=without_tags(F.col("title")),
        description=F.substring(without_tags(F.col("description")), 1, 2000), url=F.trim("link"), rank_position=F.col("pos") + 1,
        published_at=feed_time(F.col("at")), raw=F.col("raw"),
    )


def cursors(items: DataFrame) -> DataFrame:
    """``feed`` and its next ``cursor``: the id of its first item."""
    return items.groupBy("feed").agg(F.min_by("external_id", "rank_position").alias("cursor"))


def unless_unchanged(items: DataFrame, etag: str | None, seen_etag: str | None) -> DataFrame:
    """No items where the feed's tag is the one seen last."""
    return items.limit(0) if etag is not None and etag == seen_etag else items


def combined(items: DataFrame, limit: int, n_feeds: int, page: tuple[str, ...] = ()) -> DataFrame:
    """Several feeds as one: max(limit // n_feeds, 10) of each, a URL once (its first), ranked anew.

    ``items``: those of all feeds, numbered in ``feed_no`` from 0; ``page``: columns whose values are combined apart.
    """
    rows = items.filter(F.col("rank_position") <= max(limit // max(1, n_feeds), 10))
    first = Window.partitionBy(*page, "url").orderBy("feed_no", "rank_position")
    kept = rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    ranked = kept.withColumn("rank_position", F.row_number().over(Window.partitionBy(*page).orderBy("feed_no", "rank_position")).cast("int"))
    return ranked.filter(F.col("rank_position") <= limit).drop("rn", "feed_no")


def news_description(summary_html: Column) -> Column:
    """Title of the first list entry of an aggregated summary."""
    return without_tags(F.regexp_extract(summary_html, r"(?s)<li>.*?<a [^>]*>(.*?)</a>", 1))


def news_source(summary_html: Column) -> Column:
    return without_tags(F.regexp_extract(summary_html, r"(?s)<font[^>]*>(.*?)</font>", 1))
