"""HTML collectors: links of a page by rules, with Spark's regular expressions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import numbers, times
from tidewell.functions.text import without_tags
from tidewell.sources.elements import Field, Strategy, containers
from tidewell.sources.records import record, signals

_ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


@dataclass(frozen=True)
class LinkRules:
    """What links of a page are items: pattern of the address, least title length, what must not repeat."""

    name: str
    href: str = ".+"
    min_title: int = 2
    unique: str = "url"
    base: str = ""
    strip_rank: bool = False
    reject: str = ""


RULES = {
    r.name: r
    for r in (
        LinkRules("papers", href=r"/papers/(?:.*/)?[^/]*\d[^/]*/?$", min_title=10, reject=r"/papers/(trending|new)", base="https://huggingface.co"), LinkRules("hk01", href=r"/\d{7,}/"),
        LinkRules("mirrormedia", href=r"/story/(?!20(0\d|1\d|2[0-3]))", min_title=13),
    )
}


def _own(*selectors: str, **more: str) -> dict[str, Field]:
    """Title and address of one element."""
    return {"title": Field(selectors, **more), "href": Field(selectors, "href")}


@dataclass(frozen=True)
class Listing:
    """How a ranking page is read: strategies in their order, each with the least length of a title and a pattern of addresses.

    A later strategy counts where the ones before give nothing: no container (``by_container``), or no item. ``gaps``: ranks count
    containers, also those that give no item.
    """

    name: str
    base: str
    strategies: tuple[Strategy, ...]
    min_title: tuple[int, ...]
    href: str = ".+"
    unique: str = "url"
    by_container: bool = False
    gaps: bool = False
    needs_href: bool = True


_ARTICLES = Strategy(("a[href*='/article/']",), _own(""))
LISTINGS = {
    r.name: r
    for r in (
        Listing("baidu_hot", "https://top.baidu.com", (
            Strategy(("div[class*='category-wrap_']", "div[class*='item-wrap_']"), {
                "title": Field(("div[class*='c-single-text-ellipsis']", "a[class*='title_']", "a")), "href": Field(("a[class*='title_'][href]", "a[href]"), "href"),
                "score": Field(("div[class*='hot-index_']", "div[class*='trend_']")),
            }),
            Strategy(("div[class*='list'] a, div[class*='rank'] a, ol a, ul a",), _own("")),
        ), (1, 2), unique="title", by_container=True, gaps=True, needs_href=False),
        Listing("naver_news", "https://news.naver.com", (Strategy(("ul.rankingnews_list li",), _own(".list_title", "a")), _ARTICLES), (1, 5)),
        Listing("daum_news", "https://news.daum.net", (
            Strategy(("ul.list_news2 > li", "div.box_ranking > ol > li"), _own("strong.tit_thumb > a", "a.link_txt", "a")), Strategy(("[class*='rank'] a",), _own("")),
        ), (5, 5)),
        Listing("goo_news", "https://news.goo.ne.jp", (Strategy(("ul.mb16 > li", "div.ranking-list > ol > li", "div#ranking > ul > li"), _own("a")), _ARTICLES), (3, 5)),
        Listing("livedoor_news", "https://news.livedoor.com", (Strategy(("ul.rankList > li", "div.rankWrap ol > li"), _own("a")), _ARTICLES), (3, 5)),
        Listing("chinatimes", "https://www.chinatimes.com", (Strategy(("h3.title > a[href]",), _own("")), Strategy(("a[href^='/realtimenews/']",), _own(""))), (1, 4), href="^/realtimenews/"),
        Listing("wenxuecity", "https://www.wenxuecity.com", (Strategy(("li > a[href*='/news/']",), _own("")),), (1,), unique="pos", gaps=True),
        Listing("letterboxd", "https://letterboxd.com", (Strategy(("div.film-poster",), {"slug": Field(("",), "data-film-slug"), "href": Field(("",), "data-target-link"), "title": Field(("img",), "alt")}),), (0,), unique="slug", needs_href=False),
        Listing("weibo_sogou", "", (
            Strategy(("ul.hot-list li, ul.trend-list li, div.hot-list-item",), {}),
            Strategy(("li",), {}, inside="ul[class*='hot' i], ul[class*='rank' i], ul[class*='trend' i], ul[class*='top' i]"),
            Strategy(("li, div, tr",), {}, text_like=r"(?s)\d.."),
        ), (2, 2, 2), unique="title", by_container=True, needs_href=False),
        Listing("github_trending", "https://github.com", (
            Strategy(("article.Box-row", "article"), {
                "href": Field(("h2 >> a[href]",), "href"), "description": Field(("p",)), "language": Field(("[itemprop='programmingLanguage']",)),
                "stars": Field(("a",), where=("href", "{href}/stargazers")), "forks": Field(("a",), where=("href", "{href}/forks")), "today": Field(("span",), like="stars? today"),
            }),
        ), (0,), href=r"^/*[^/]+/[^/]+", unique="pos", gaps=True),
    )
}
#: Where an article's body stands, the first that is there; and how much of it is kept.
ARTICLE_BODIES = (
    "div.article-content", "div#article-content", "div.content", "div#content", "div.article", "article", "div.main-content", "div[class*='article']", "div[class*='content']",
)
BODY_CHARS, LEAST_BODY = 3000, 50


def links(pages: DataFrame) -> DataFrame:
    """``page_id``, ``pos``, ``href``, ``text`` of every anchor of pages (``page_id``, ``html``)."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(_ANCHOR), 1).alias("href"), F.regexp_extract_all("html", F.lit(_ANCHOR), 2).alias("text"))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    return rows.select("page_id", "pos", F.col("a.href").alias("href"), without_tags(F.col("a.text")).alias("text"))


def page_title(html: Column) -> Column:
    return without_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def absolute(href: Column, base: str) -> Column:
    root = F.regexp_extract(F.lit(base), r"^([a-z]+://[^/]+)", 1)
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, F.lit("/"), href))


def extracted(pages: DataFrame, rules: str | LinkRules, limit: int = 50) -> DataFrame:
    """Items of a page: links that the rules take, each address or title once (its first), ranked without gaps."""
    r = RULES[rules] if isinstance(rules, str) else rules
    found = links(pages)
    title = F.regexp_replace("text", r"^\d+\s*", "") if r.strip_rank else F.col("text")
    rows = found.withColumn("title", title).withColumn("url", absolute(F.col("href"), r.base) if r.base else F.col("href"))
    rows = rows.filter(F.col("href").rlike(r.href) & (F.length("title") >= r.min_title))
    rows = rows.filter(~F.col("href").rlike(r.reject)) if r.reject else rows
    first = Window.partitionBy("page_id", r.unique).orderBy("pos")
    rows = rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("rank") <= limit)
    return record(rows, r.name, external_id=F.coalesce(F.nullif(F.regexp_extract("url", r"(\d{5,})", 1), F.lit("")), F.col("url")), title=F.col("title"), url=F.col("url"), rank_position=F.col("rank"), published_at=times.url_date(F.col("url")).cast("timestamp"))


def listed(pages: DataFrame, listing: str | Listing, limit: int = 50) -> DataFrame:
    """Items of ranking pages (``page_id``, ``html``) by a listing's selectors: ``page_id``, then the record columns.

    Per page, the first strategy that gives something counts, an address (or what the listing names) is
    taken once, and ``limit`` items stay. Pages without items give no row.
    """
    r = LISTINGS[listing] if isinstance(listing, str) else listing
    of = lambda name: F.try_element_at("fields", F.lit(name))
    rows = containers(pages, _specified(r))
    title = F.trim(F.coalesce(of("title"), F.lit("")))
    if r.name == "weibo_sogou":
        title = F.when(title.rlike(r"^\d"), F.regexp_replace(title, r"^[0-9. ]+", "")).otherwise(title)
    if r.name == "letterboxd":
        title = F.when(title != "", title).otherwise(F.initcap(F.replace(of("slug"), F.lit("-"), F.lit(" "))))
    if r.name == "github_trending":
        title = F.concat_ws("/", F.slice(F.split(F.regexp_replace(F.trim(of("href")), "^/+", ""), "/"), 1, 2))
    rows = rows.select("page_id", "strategy", "pos", "fields", title.alias("title"), F.trim(of("href")).alias("href"), of("slug").alias("slug"))
    least = F.element_at(F.array(*[F.lit(n) for n in r.min_title]), F.col("strategy"))
    sound = F.length("title") >= least
    sound = sound & F.coalesce(F.col("href").rlike(r.href), F.lit(False)) if r.needs_href else sound
    sound = sound & (F.coalesce("slug", F.lit("")) != "") if r.unique == "slug" else sound
    if r.by_container:
        # containers alone decide; of ranks with gaps only the first containers count
        rows = _first_strategy(rows)
        rows = rows.filter((F.col("strategy") > 1) | (F.col("pos") <= limit)) if r.gaps else rows
        rows = rows.filter(sound)
    else:
        rows = rows.filter(F.col("pos") <= limit) if r.gaps else rows
        rows = _first_strategy(rows.filter(sound))
    rows = rows.withColumn("url", _address(r))
    by_rank = F.lit(r.gaps) & (F.col("strategy") == 1)
    first = Window.partitionBy("page_id", F.when(by_rank, F.col("pos").cast("string")).otherwise(F.col(r.unique).cast("string"))).orderBy("pos")
    rows = rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    rank = F.when(by_rank, F.col("pos")).otherwise(F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return _recorded(rows, r)


def _specified(r: Listing) -> tuple[Strategy, ...]:
    if r.name != "weibo_sogou":
        return r.strategies
    # the title is that of the anchor, or else of the whole entry
    fields = {"title": Field(("a[href]", "")), "href": Field(("a[href]",), "href"), "score": Field(("span.num, span.hot, span[class*='score'], em",))}
    return tuple(Strategy(s.containers, fields, s.inside, s.text_like) for s in r.strategies)


def _first_strategy(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__least", F.min("strategy").over(Window.partitionBy("page_id"))).filter("strategy = __least").drop("__least")


def _quoted(c: Column) -> Column:
    """Percent-encoded, slashes kept."""
    for before, after in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        c = F.replace(c, F.lit(before), F.lit(after))
    return c


def _address(r: Listing) -> Column:
    href = F.col("href")
    if r.name == "weibo_sogou":
        return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit("https://s.weibo.com/weibo?q="), _quoted(F.url_encode("title"))))
    if r.name == "letterboxd":
        return absolute(F.coalesce(href, F.concat(F.lit("/film/"), F.col("slug"), F.lit("/"))), r.base)
    if r.name == "github_trending":
        return F.concat(F.lit("https://github.com/"), F.col("title"))
    if r.name == "baidu_hot":
        href = F.coalesce(F.nullif(href, F.lit("")), F.lit("https://top.baidu.com/board?tab=realtime"))
        return F.when(href.startswith("/"), absolute(href, r.base)).otherwise(href)
    return absolute(href, r.base)


def _recorded(rows: DataFrame, r: Listing) -> DataFrame:
    of = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))
    shown = {
        "baidu_hot": {"hot_score": numbers.cjk_number(of("score"))}, "weibo_sogou": {"hot_score": naive_score(of("score"))},
        "github_trending": {"stars": count_with_k(of("stars")), "forks": count_with_k(of("forks")), "stars_today": count_with_k(of("today"))},
    }.get(r.name, {})
    path = F.replace(F.regexp_replace("href", "^/+", ""), F.lit("/"), F.lit("_"))
    key = {
        "chinatimes": F.concat(F.lit("chinatimes_"), path), "wenxuecity": F.concat(F.lit("wenxuecity_"), F.replace("href", F.lit("/"), F.lit("_"))), "letterboxd": F.concat(F.lit("letterboxd_"), F.col("slug")),
        "baidu_hot": F.lit(None), "weibo_sogou": F.lit(None), "github_trending": F.lit(None),
    }.get(r.name, F.concat(F.lit(r.name + "_"), F.col("rank")))
    columns = {"external_id": key, "title": F.col("title"), "url": F.col("url"), "rank_position": F.col("rank"), "signals": signals(**shown)}
    columns["description"] = F.nullif(of("description"), F.lit(""))
    if r.name in ("chinatimes", "wenxuecity"):
        columns["published_at"] = times.url_date(F.col("href")).cast("timestamp")
    if r.name == "github_trending":
        columns["raw"] = F.to_json(F.struct(F.split("title", "/")[0].alias("owner"), F.split("title", "/")[1].alias("repo"), of("language").alias("language")))
    return record(rows, r.name, ("page_id",), **columns)


def count_with_k(shown: Column) -> Column:
    """The first word of a shown count: ``1,234`` and ``12.5k``; 0 for anything else."""
    word = F.regexp_extract(F.replace(F.lower(F.trim(shown)), F.lit(","), F.lit("")), r"^(\S+)", 1)
    many = F.floor(F.regexp_extract(word, r"^([\d.]+)k$", 1).try_cast("double") * 1000)
    return F.coalesce(F.when(word.endswith("k"), many).otherwise(word.try_cast("long")), F.lit(0)).cast("long")


def article_bodies(pages: DataFrame) -> DataFrame:
    """``page_id``, ``body`` and ``comments`` of article pages: the first known container's text, or else all paragraphs.

    A body under LEAST_BODY characters counts as none, a longer one is cut at BODY_CHARS.
    """
    fields = {"body": Field(ARTICLE_BODIES, sep=" "), "paragraphs": Field(("p",), sep=" ", every=True), "comments": Field(("a.morecomment",))}
    rows = containers(pages, (Strategy(("",), fields),))
    of = lambda name: F.try_element_at("fields", F.lit(name))
    body = F.trim(F.coalesce(of("body"), of("paragraphs"), F.lit("")))
    n = F.regexp_extract(F.coalesce(of("comments"), F.lit("")), r"(\d+)", 1).try_cast("long")
    return rows.select("page_id", F.when(F.length(body) >= LEAST_BODY, F.substring(body, 1, BODY_CHARS)).alias("body"), F.coalesce(n, F.lit(0)).cast("long").alias("comments"))


def with_score(items: DataFrame, shown: Column, kind: str = "cjk") -> DataFrame:
    """Adds the score shown beside an item: 万 and 亿, or ``12.5k``."""
    n = numbers.cjk_number(shown) if kind == "cjk" else numbers.abbreviated_number(shown)
    return items.withColumn("signals", signals(hot_score=n) if kind == "cjk" else signals(stars=n))


def naive_score(shown: Column) -> Column:
    """The score as one source reads it: 万 becomes four zeros and the point goes, so 1.2万 is 120000."""
    return F.coalesce(F.regexp_replace(F.replace(shown, F.lit("万"), F.lit("0000")), r"\D", "").try_cast("long"), F.lit(0).cast("long"))


def synthetic_ranking(spark, n: int = 20) -> DataFrame:
    """The stub source: rows with arithmetic engagement."""
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("r"))
    return record(
        rows, "yahoo_jp", external_id=F.concat(F.lit("yahoo_jp_"), F.col("r")), title=F.concat(F.lit("Ranking item "), F.col("r")), url=F.concat(F.lit("https://news.yahoo.co.jp/pickup/"), F.col("r")),
        rank_position=F.col("r"), signals=signals(views=10000 - F.col("r") * 100, comments=500 - F.col("r") * 10),
    )
