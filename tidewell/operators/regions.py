"""Region classification: several regions an item, one of them primary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.collections import first_other_than, looked_up, sorted_set
from tidewell.operators.ranking import hottest

#: Language and platform, then subreddit, to region.
LANG_PLATFORM = {
    "ja|yahoo_japan": "jp", "ja|nhk_news_rss": "jp", "ja|nicovideo": "jp", "ja|hatena": "jp", "ja|livedoor_news": "jp", "ja|goo_news": "jp",
    "ko|naver_news": "kr", "ko|daum_news": "kr",
    "zh|bilibili": "cn", "zh|baidu": "cn", "zh|weibo": "cn", "zh|zhihu": "cn", "zh|v2ex": "cn",
    "zh|chinatimes": "tw", "zh|mirrormedia": "tw", "zh|ettoday": "tw", "zh|hk01": "hk",
}
SUBREDDITS = {
    "reddit_india": "in", "reddit_france": "fr", "reddit_de": "de", "reddit_askARussian": "ru", "reddit_poland": "pl", "reddit_italy": "it",
    "reddit_brasil": "br", "reddit_arabs": "ar", "reddit_turkey": "tr", "reddit_es": "es", "reddit_mexico": "es", "reddit_argentina": "ar_latam",
}
#: The region of a surface. wenxuecity_news has none on purpose.
SURFACE_REGIONS = {
    "g1_rss": "br", "folha_rss": "br", "bbcbrasil_rss": "br", "uol_rss": "br", "globo_g1_rss": "br",
    "spiegel_rss": "de", "zeit_rss": "de", "tagesschau_rss": "de", "sueddeutsche_rss": "de", "dw_de_rss": "de",
    "lemonde_rss": "fr", "france24_rss": "fr", "rfi_rss": "fr", "lefigaro_rss": "fr", "leparisien_rss": "fr",
    "elpais_rss": "es", "elmundo_rss": "es", "bbcmundo_rss": "es", "infobae_rss": "es",
    "tass_rss": "ru", "meduza_rss": "ru", "moscowtimes_rss": "ru", "bbc_russian_rss": "ru", "dw_ru_rss": "ru",
    "aajtak_rss": "in", "bbc_hindi_rss": "in", "zeenews_hindi_rss": "in", "navbharattimes_rss": "in", "ndtv_hindi_rss": "in", "india_english_news_rss": "in",
    "ansa_rss": "it", "repubblica_rss": "it", "corriere_rss": "it", "sole24ore_rss": "it",
    "bbcturkce_rss": "tr", "hurriyet_rss": "tr", "dw_tr_rss": "tr", "dailysabah_rss": "tr", "cumhuriyet_rss": "tr",
    "aljazeera_ar_rss": "ar", "bbcarabic_rss": "ar", "alarabiya_rss": "ar", "france24_ar_rss": "ar", "dw_ar_rss": "ar",
    "onet_rss": "pl", "tvn24_rss": "pl", "pap_rss": "pl", "wyborcza_rss": "pl",
    "kompas_rss": "id", "antara_rss": "id", "bbcindonesia_rss": "id", "tempo_rss": "id",
    "nhk_news_rss": "jp",
    "36kr_rss": "cn", "netease_news_rss": "cn",
    "chinatimes_news": "tw", "mirrormedia_news": "tw", "ettoday_rss": "tw",
    "hk01_news": "hk",
    "nunl_rss": "nl",
    "sweden_news_rss": "se",
    "philippines_news_rss": "ph",
    "vnexpress_rss": "vn",
    "thailand_news_rss": "th",
    "malaysia_news_rss": "my",
    "portugal_news_rss": "pt",
    "argentina_news_rss": "ar_latam",
    "naver_news_ranking": "kr", "daum_news_trending": "kr",
    "yahoo_jp_ranking": "jp", "goo_news_ranking": "jp", "livedoor_news_ranking": "jp", "hatena_hotentry": "jp",
    "bilibili_trending": "cn", "baidu_hot": "cn", "weibo_sogou": "cn", "weibo_hot": "cn", "zhihu_hot": "cn",
}
#: Terms of a region, found anywhere in a title.
REGION_TERMS = {
    "cn": ["中国", "北京", "上海", "深圳", "广州", "习近平", "China", "Beijing", "Shanghai", "Shenzhen", "Guangzhou", "Chinese"],
    "jp": ["日本", "東京", "大阪", "横浜", "Japan", "Tokyo", "Osaka", "Yokohama", "Shinzo Abe"],
    "kr": ["한국", "서울", "부산", "Korea", "South Korea", "Seoul", "Busan"],
    "us": ["美国", "Trump", "Biden", "White House", "Washington DC", "United States", "U.S.", "New York", "California"],
    "ru": ["Россия", "Москва", "Путин", "Кремль", "Russia", "Moscow", "Putin", "Kremlin", "Saint Petersburg"],
    "in": ["India", "Modi", "Delhi", "New Delhi", "Mumbai", "Bangalore", "भारत"],
    "de": ["Deutschland", "Berlin", "München", "Hamburg", "Frankfurt", "Scholz", "Merz", "Germany", "German", "Bundesliga"],
    "fr": ["France", "Paris", "Macron", "Lyon", "Marseille", "français", "French", "Elysée"],
    "br": ["Brasil", "Brasília", "Lula", "São Paulo", "Rio de Janeiro", "Brazil", "Brazilian", "Bolsonaro"],
    "es": ["España", "Madrid", "Barcelona", "Valencia", "Sevilla", "Sánchez", "Spain", "Spanish"],
    "it": ["Italia", "Roma", "Milano", "Napoli", "Venezia", "Meloni", "Italy", "Italian"],
    "tr": ["Türkiye", "Ankara", "İstanbul", "Istanbul", "Erdoğan", "Turkey", "Turkish"],
    "ar": ["السعودية", "مصر", "دبي", "أبوظبي", "الرياض", "القاهرة", "Saudi", "Egypt", "Dubai", "Abu Dhabi", "UAE", "Riyadh", "Cairo", "Middle East"],
    "id": ["Indonesia", "Jakarta", "Jokowi", "Prabowo", "Indonesian", "Bali"],
    "pl": ["Polska", "Warszawa", "Warsaw", "Kraków", "Tusk", "Poland", "Polish"],
    "nl": ["Nederland", "Amsterdam", "Rotterdam", "Den Haag", "Netherlands", "Dutch"],
    "se": ["Sverige", "Stockholm", "Göteborg", "Sweden", "Swedish", "Gothenburg"],
    "ph": ["Pilipinas", "Manila", "Quezon", "Marcos", "Philippines", "Filipino"],
    "vn": ["Việt Nam", "Hà Nội", "Sài Gòn", "Vietnam", "Vietnamese", "Ho Chi Minh"],
    "th": ["ประเทศไทย", "กรุงเทพ", "เชียงใหม่", "Bangkok", "Chiang Mai", "Thailand", "Thai"],
    "my": ["Malaysia", "Kuala Lumpur", "Anwar", "Malaysian"],
    "pt": ["Portugal", "Lisboa", "Lisbon", "Porto", "Portuguese"],
    "ar_latam": ["Argentina", "Buenos Aires", "Milei", "Argentino", "Argentine"],
    "tw": ["台灣", "台北", "台中", "高雄", "新北", "桃園", "台南", "Taiwan", "Taipei", "Kaohsiung", "Taichung", "Tainan"],
    "hk": ["香港", "九龍", "新界", "Hong Kong", "Hongkong", "HK", "Kowloon"],
}


def term_regex(terms: list[str]) -> str:
    """Any of the terms, anywhere, whatever the case."""
    return "(?iu)" + "|".join(re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", t) for t in terms)


def content_regions(lang: Column, platform: Column, surface: Column, title: Column, terms: dict[str, list[str]], surfaces: dict[str, str]) -> Column:
    """Sorted regions by language and platform, subreddit, surface, and terms in the title."""
    fixed = [
        looked_up(LANG_PLATFORM, F.concat(lang, F.lit("|"), platform)),
        F.when(platform == "reddit", looked_up(SUBREDDITS, surface)),
        looked_up(surfaces, surface),
    ]
    hits = [F.when(F.coalesce(title, F.lit("")).rlike(term_regex(t)), F.lit(region)) for region, t in terms.items()]
    return sorted_set(F.array(*fixed, *hits))


def classified(items: DataFrame, terms: dict[str, list[str]] | None = None, surfaces: dict[str, str] | None = None) -> DataFrame:
    """Adds ``content_regions`` and ``primary_region``: the first that is not us, else the first."""
    terms = REGION_TERMS if terms is None else terms
    surfaces = SURFACE_REGIONS if surfaces is None else surfaces
    found = content_regions(*[F.col(c) for c in ("lang_group", "platform", "surface_key", "title")], terms, surfaces)
    out = items.withColumn("content_regions", found)
    return out.withColumn("primary_region", first_other_than(F.col("content_regions"), "us"))


def cycle(items: DataFrame, answers: DataFrame, top: int = 50, llm_top: int = 20, **settings) -> DataFrame:
    """One cycle over unclassified rows: ``id``, ``content_regions``, ``primary_region``, ``method``.

    Heuristics first; the hottest rows of a platform that they leave open go to the external
    classifier (``answers``: ``id``, ``regions``); the rest is skipped.
    """
    rated = classified(hottest(items, "platform", top).drop("rank_in_group"), **settings)
    open_ = rated.filter(F.size("content_regions") == 0)
    asked = hottest(open_, "platform", llm_top).select("id", F.lit(True).alias("asked"))
    joined = rated.join(asked, "id", "left").join(answers, "id", "left")
    by_llm = F.coalesce("asked", F.lit(False)) & (F.coalesce(F.size("regions"), F.lit(0)) > 0)
    regions = F.when(by_llm, sorted_set(F.col("regions"))).otherwise(F.col("content_regions"))
    return joined.select(
        "id", regions.alias("content_regions"),
        F.when(F.size("content_regions") > 0, "heuristic").when(by_llm, "llm").otherwise("skipped").alias("method"),
    ).withColumn("primary_region", first_other_than(F.col("content_regions"), "us"))
