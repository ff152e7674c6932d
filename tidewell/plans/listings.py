"""Queries of the ranking pages: pages made from ``documents`` in the forms that each source's selectors and fallbacks know; the SQL goes without pages.

Twenty ids in a row are a page. Pages take turns in a source's forms. Every page begins with more
navigation links than a page may have items, and every ninth entry has no title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.catalogue import query
from tidewell.sources import html_sources
from tidewell.sources.adapters import read

_NAV = "<nav>" + "".join(f'<a href="/nav/{k}">Navigation entry {k}</a>' for k in range(60)) + "</nav>"
_PLAIN = '<li><a href="/v/{i}">{t}</a></li>'
#: Source: forms of a page, each an entry and what surrounds the entries.
FORMS = {
    "baidu_hot": [
        ('<div class="category-wrap_q1"><a class="title_w2" href="/s?wd={i}"><div class="c-single-text-ellipsis"> {t} </div></a><div class="hot-index_e3">{i}万</div></div>', "<div>", "</div>"),
        ('<div class="item-wrap_q1"><a href="https://e.example/{i}">{t}</a><div class="trend_e3">1.5亿</div></div>', "<div>", "</div>"),
        ('<li><a href="/s?wd={i}">{t}</a>', "<ol>", "</ol>"),
    ],
    "naver_news": [('<li><a class="list_title" href="/article/{i}">{t}</a></li>', '<ul class="rankingnews_list">', "</ul>"), ('<p><a href="/x/article/{i}">{t}</a></p>', "", "")],
    "daum_news": [
        ('<li><a href="/photo/{i}"></a><strong class="tit_thumb"><a href="/v/{i}">{t}</a></strong></li>', '<ul class="list_news2">', "</ul>"),
        ('<li><a href="/photo/{i}"></a><a class="link_txt" href="/v/{i}">{t}</a></li>', '<div class="box_ranking"><ol>', "</ol></div>"), (_PLAIN, '<div class="box rank_all"><ul>', "</ul></div>"),
    ],
    "goo_news": [
        (_PLAIN, '<ul class="mb16">', "</ul>"), (_PLAIN, '<div class="ranking-list"><ol>', "</ol></div>"), (_PLAIN, '<div id="ranking"><ul>', "</ul></div>"), ('<p><a href="/article/{i}">{t}</a>', "", ""),
    ],
    "livedoor_news": [(_PLAIN, '<ul class="rankList">', "</ul>"), (_PLAIN, '<div class="rankWrap"><section><ol>', "</ol></section></div>"), ('<p><a href="/topics/article/{i}">{t}</a>', "", "")],
    "chinatimes": [
        ('<li data-article-id="{i}"><h3 class="title"><a href="/realtimenews/2024{i}-26">{t}</a></h3><a href="/realtimenews/x">other</a></li>', "<ul>", "</ul>"),
        ('<div><a href="/realtimenews/2024{i}-26">{t}</a></div>', "", ""),
    ],
    "wenxuecity": [('<li><a href="/news/2024/01/05/{i}.html">{t}</a></li>', "<ul>", "</ul>")],
    "letterboxd": [('<li><div class="poster film-poster" data-film-slug="film-{i}" data-target-link="/film/film-{i}/"><img src="p.png" alt="{t}"></div></li>', "<ul>", "</ul>")],
    "weibo_sogou": [
        ('<li>{i} <a href="https://e.example/{i}">{t}</a><em>{i}万</em></li>', '<ul class="hot-list">', "</ul>"), ("<li>{i} {t}<em>7</em></li>", '<ul class="TopBoard">', "</ul>"), ("<div>{i}. {t}</div>", "", ""),
    ],
    "github_trending": [
        ('<article class="Box-row"><h2><a href="/own{i}/rep{i}">own / rep</a></h2><p>{t}</p><span itemprop="programmingLanguage">Go</span><a href="/own{i}/rep{i}/stargazers">1,00{i}</a><a href="/own{i}/rep{i}/forks">2.5k</a><span>{i} stars today</span></article>', "", ""),
        ('<article><h2><a href="/own{i}/rep{i}">own / rep</a></h2><p>{t}</p><a href="/other/rep/stargazers">9</a></article>', "", ""),
    ],
}
#: Source: in SQL over i, t, p (the page), f (its form), k (place on the page, from 1): filter, external_id, title, url, signal, its value; whether ranks count left-out entries, by form.
_TITLED = "t <> ''"
EXPECTED = {
    "baidu_hot": (_TITLED, "NULL", "t", "CASE f WHEN 1 THEN 'https://e.example/' || i ELSE 'https://top.baidu.com/s?wd=' || i END", "hot_score", "CASE f WHEN 0 THEN i * 10000 WHEN 1 THEN 150000000 ELSE 0 END", "f < 2"),
    "naver_news": (_TITLED, "'naver_news_' || r", "t", "'https://news.naver.com' || CASE f WHEN 0 THEN '' ELSE '/x' END || '/article/' || i", "views", "0", "false"),
    "daum_news": (_TITLED, "'daum_news_' || r", "t", "'https://news.daum.net/v/' || i", "views", "0", "false"),
    "goo_news": (_TITLED, "'goo_news_' || r", "t", "'https://news.goo.ne.jp/' || CASE f WHEN 3 THEN 'article/' ELSE 'v/' END || i", "views", "0", "false"),
    "livedoor_news": (_TITLED, "'livedoor_news_' || r", "t", "'https://news.livedoor.com/' || CASE f WHEN 2 THEN 'topics/article/' ELSE 'v/' END || i", "views", "0", "false"),
    "chinatimes": (_TITLED, "'chinatimes_realtimenews_2024' || i || '-26'", "t", "'https://www.chinatimes.com/realtimenews/2024' || i || '-26'", "views", "0", "false"),
    "wenxuecity": (_TITLED, "'wenxuecity__news_2024_01_05_' || i || '.html'", "t", "'https://www.wenxuecity.com/news/2024/01/05/' || i || '.html'", "views", "0", "true"),
    "letterboxd": ("true", "'letterboxd_film-' || i", "CASE WHEN t = '' THEN 'Film ' || i ELSE t END", "'https://letterboxd.com/film/film-' || i || '/'", "views", "0", "false"),
    "weibo_sogou": (
        _TITLED, "NULL", "t || CASE f WHEN 1 THEN '7' ELSE '' END",
        "CASE f WHEN 0 THEN 'https://e.example/' || i ELSE 'https://s.weibo.com/weibo?q=' || replace(t, ' ', '%20') || CASE f WHEN 1 THEN '7' ELSE '' END END", "hot_score", "CASE f WHEN 0 THEN i * 10000 WHEN 1 THEN 7 ELSE 0 END", "false",
    ),
    "github_trending": ("true", "NULL", "'own' || i || '/rep' || i", "'https://github.com/own' || i || '/rep' || i", "stars", "CASE f WHEN 0 THEN CAST('100' || i AS BIGINT) ELSE 0 END", "true"),
}


def made_pages(docs: DataFrame, forms: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id``, ``html``: the documents of twenty ids as the entries of a page."""
    page, i = F.floor(F.col("doc_id") / 20), F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat("lang", F.lit(" title "), i))

    def by_form(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % len(forms) + 1).cast("int"))

    filled = F.replace(F.replace(by_form([f[0] for f in forms]), F.lit("{i}"), F.col("i")), F.lit("{t}"), F.col("t"))
    rows = docs.select(page.alias("page_id"), "doc_id", i.alias("i"), title.alias("t")).withColumn("entry", filled)
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("l"))
    body = F.concat(F.lit("<!DOCTYPE html><html><head><title>x</title></head><body>" + _NAV), by_form([f[1] for f in forms]), F.array_join(F.transform("l", lambda x: x["entry"]), ""), by_form([f[2] for f in forms]))
    return listed.select("page_id", body.alias("html"))


def _sql(name: str) -> str:
    keep, key, title, url, signal, value, gaps = EXPECTED[name]
    return f"""WITH d AS (SELECT doc_id AS i, doc_id // 20 AS p, doc_id // 20 % {len(FORMS[name])} AS f, CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang || ' title ' || doc_id END AS t, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS k FROM documents),
r AS (SELECT *, CASE WHEN {gaps} THEN k ELSE row_number() OVER (PARTITION BY p ORDER BY k) END AS r FROM d WHERE {keep})
SELECT p AS page_id, {key} AS external_id, {title} AS title, {url} AS url, CAST(r AS INTEGER) AS rank_position, CASE WHEN {value} > 0 THEN CAST({value} AS DOUBLE) END AS {signal} FROM r"""


def _register(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        items = html_sources.listed(made_pages(read(spark, sf, "documents"), FORMS[name]), name)
        signal = EXPECTED[name][4]
        return items.select("page_id", "external_id", "title", "url", "rank_position", F.try_element_at("signals", F.lit(signal)).alias(signal))

    run.__name__, run.__doc__ = f"listing_{name}", f"Items of the ranking pages of {name}."
    query(_sql(name))(run)


for _name in FORMS:
    _register(_name)


@query(
    """SELECT doc_id, CASE WHEN length(b) >= 50 THEN substr(b, 1, 3000) END AS body, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS comments
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' one' || CASE WHEN m = '' THEN '' ELSE ' ' || m END || ' tail' ELSE lang || 'one' || m || ' last' END AS b
  FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN trim(repeat('word ', doc_id % 700)) ELSE '' END AS m FROM documents))"""
)
def article_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of article pages by their container, or else by paragraphs, and the count of comments."""
    i = F.col("doc_id")
    more = F.when(i % 2 == 0, F.trim(F.repeat(F.lit("word "), (i % 700).cast("int")))).otherwise("")
    inner = F.concat(F.lit("<p> "), F.col("lang"), F.lit(" <b>one</b>"), more, F.lit("</p>"))
    with_box = F.concat(F.lit('<p>teaser</p><div id="content">'), inner, F.lit('tail</div><a class="morecomment">查看评论('), i.cast("string"), F.lit(")</a>"))
    html = F.when(i % 3 == 0, with_box).otherwise(F.concat(inner, F.lit("<div><p>last</p></div>")))
    found = html_sources.article_bodies(read(spark, sf, "documents").select(i.alias("page_id"), html.alias("html")))
    return found.select(F.col("page_id").alias("doc_id"), "body", "comments")
