"""Entities of titles, and the statistics by which keywords are learned and expire."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import squeeze

#: Patterns and stop words of English titles.
ALL_CAPS = r"\b[A-Z]{2,6}\b"
TITLE_CASE = r"\b(?:[A-Z][a-z]+\s){1,3}[A-Z][a-z]+\b"
CAMEL_CASE = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"
NOUN_VERB = (
    r"\b([A-Z][a-z]*(?:[A-Z][a-z]*)*[a-z]+)\s+"
    r"(?:said|announced|reported|reports|unveiled|banned|launched|warned|pledged|signed|approved|filed|sued|wins|loses|beats|misses|cuts|raises|faces)\b"
)
ENGLISH_STOP = [
    "The", "This", "That", "New", "Top", "Big", "US", "UK", "EU", "UN", "A", "An", "In", "On", "At", "Is", "Are", "Was", "Were", "Has", "Have", "Had",
    "Be", "By", "Of", "To", "As", "For", "Or", "But", "And", "Not", "Its", "It", "He", "She", "They", "We", "You", "How", "Why", "What", "When",
    "Where", "Who", "Which", "After", "Before", "Over", "Under", "More", "Most", "Some", "All", "One", "Two", "First", "Last", "Next",
]
#: Patterns of other scripts.
LATIN = (r"(?U)\b\p{Lu}{2,6}\b", r"(?U)\b(?:\p{Lu}\p{Ll}+\s){1,3}\p{Lu}\p{Ll}+\b", r"(?U)\b\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)+\b")
ARABIC, ARTICLE = r"[\x{0600}-\x{06FF}]{2,}", "ال"
DEVANAGARI = r"[\x{0900}-\x{097F}]{2,}"
#: Words that are never keywords.
KEYWORD_STOP = [
    "the", "a", "an", "this", "that", "these", "those", "and", "or", "but", "both", "nor", "yet", "for", "from", "with", "without", "into", "onto",
    "upon", "about", "after", "before", "over", "under", "through", "during", "between", "against", "he", "she", "it", "its", "they", "them", "their",
    "we", "us", "you", "your", "our", "his", "her", "is", "are", "was", "were", "been", "being", "has", "have", "had", "does", "did", "will", "would",
    "could", "should", "can", "may", "might", "how", "why", "what", "when", "where", "who", "which", "whom", "all", "any", "some", "more", "most",
    "many", "much", "also", "only", "just", "very", "too", "then", "than", "such", "new", "top", "big", "old", "news", "video", "update", "report",
    "today", "breaking", "latest", "live", "watch",
]
CASELESS = ("ja", "ko", "ar", "th", "hi", "zh")


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def english_entities(title: Column) -> Column:
    """Capitals, title case, noun before a verb of news, camel case; without stop words."""
    title = F.coalesce(title, F.lit(""))
    found = F.array_distinct(F.concat(_all(title, ALL_CAPS), _all(title, TITLE_CASE), _all(title, NOUN_VERB, 1), _all(title, CAMEL_CASE)))
    return F.filter(F.array_except(found, F.array(*[F.lit(w) for w in ENGLISH_STOP])), lambda e: F.length(e) >= 2)


def latin_entities(title: Column, lang: Column, stop: list[str] | None = None) -> Column:
    """The same for any Latin or Cyrillic text; German terms must occur twice in the title."""
    title = F.coalesce(title, F.lit(""))
    found = F.array_distinct(F.concat(*[_all(title, p) for p in LATIN]))
    found = F.filter(found, lambda e: (F.length(e) >= 2) & (~F.lower(e).isin(*stop) if stop else F.lit(True)))
    times = lambda e: (F.length(title) - F.length(F.replace(title, e, F.lit("")))) / F.length(e)
    return F.filter(found, lambda e: (lang != "de") | (times(e) >= 2))


def arabic_entities(title: Column, stop: list[str] | None = None) -> Column:
    """Runs of Arabic letters; of words that differ by their article alone, the first, as written."""
    bare = lambda w: F.when(w.startswith(ARTICLE) & (F.length(w) > len(ARTICLE)), F.substr(w, F.lit(len(ARTICLE) + 1))).otherwise(w)
    pairs = F.transform(_all(F.coalesce(title, F.lit("")), ARABIC), lambda w: F.struct(bare(w).alias("k"), w.alias("w")))
    pairs = F.filter(pairs, lambda p: (F.length(p["k"]) >= 2) & (~p["k"].isin(*stop) if stop else F.lit(True)))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.transform(keys, lambda k: F.get(F.filter(pairs, lambda p: p["k"] == k), F.lit(0))["w"])


def hindi_entities(title: Column, stop: list[str] | None = None) -> Column:
    found = F.array_distinct(_all(F.coalesce(title, F.lit("")), DEVANAGARI))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def segmented_entities(segment: Callable[[str], list[str]] | None):
    """A pandas UDF around a segmenter (Chinese, Japanese, Korean, Thai); without one, no entities."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for titles in batches:
            yield titles.map(lambda t: list(dict.fromkeys(segment(t))) if segment and t else [])

    return run


def entities(title: Column, lang: Column, segmenters: dict[str, Callable[[str], list[str]]] | None = None) -> Column:
    """Entities by language group; English rules for unknown ones."""
    latin = ("fr", "de", "es", "pt", "it", "ru", "pl", "tr", "nl", "sv", "id", "vi", "uk", "ro", "cs", "hu", "fi", "da", "no", "el")
    out = F.when(lang.isin(*latin), latin_entities(title, lang)).when(lang == "ar", arabic_entities(title)).when(lang == "hi", hindi_entities(title))
    for code in ("zh", "ja", "ko", "th"):
        segment = (segmenters or {}).get(code)
        out = out.when(lang == code, segmented_entities(segment)(title) if segment else F.array().cast("array<string>"))
    return out.otherwise(english_entities(title))


def candidates(items: DataFrame, min_freq: int = 2, min_purity: float = 0.80) -> DataFrame:
    """``term``, ``lang``, ``topic``, ``total``, ``purity`` of terms that belong to one topic.

    ``items``: ``entities``, ``lang``, ``topic``. A term's topic is its most frequent one, the first
    in the alphabet of equals; its purity is that topic's share, compared before it is rounded.
    """
    counts = items.select(F.explode("entities").alias("term"), "lang", "topic").groupBy("term", "lang", "topic").agg(F.count(F.lit(1)).alias("n"))
    by_term = Window.partitionBy("term", "lang")  # a row a topic, so at most the vocabulary's size
    ranked = counts.withColumn("total", F.sum("n").over(by_term)).withColumn("rn", F.row_number().over(by_term.orderBy(F.col("n").desc(), "topic")))
    share = F.col("n") / F.col("total")
    return ranked.filter((F.col("rn") == 1) & (F.col("total") >= min_freq) & (share >= min_purity)).select("term", "lang", "topic", "total", F.round(share, 3).alias("purity"))


def valid(term: Column, score: Column, lang: Column) -> Column:
    """Whether a term may become a keyword: length, score, stop words, capitals, letters, case."""
    t = squeeze(term)
    ascii_ = t.rlike(r"^\p{ASCII}*$")
    cased = ascii_ & ~F.coalesce(lang.isin(*CASELESS), F.lit(False))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return (
        (F.length(t) >= F.when(cased, 3).otherwise(2))
        & (score >= 2)
        & ~F.lower(t).isin(*KEYWORD_STOP)
        & ~(t.rlike(r"^\p{L}+$") & (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) <= 2))
        & (letters * 2 >= F.length(t))
        & (~cased | t.rlike(r"(^| )\p{Lu}"))
    )


def confirmed(found: DataFrame, answers: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Candidates whose topic an external check confirms. ``answers``: ``term``, ``lang``, ``answer``."""
    joined = found.join(answers, ["term", "lang"])
    return joined.filter(F.col("answer").isin(*vocabulary) & (F.col("answer") == F.col("topic"))).drop("answer")


def merged(existing: DataFrame, new: DataFrame, today: Column, strong_score: int = 10, expire_days: int = 30, strong_expire_days: int = 90) -> DataFrame:
    """Learned keywords after a harvest: scores add up, silent ones expire, strong ones later.

    Both: ``topic``, ``term``, ``lang``, ``score``; ``existing`` also ``last_seen`` (date). The last day
    of a term of grace is included. A null ``last_seen`` counts as today.
    """
    n = new.groupBy("topic", "term", "lang").agg(F.sum("score").alias("gain"))
    joined = existing.join(n, ["topic", "term", "lang"], "full_outer")
    score = F.coalesce("score", F.lit(0)) + F.coalesce("gain", F.lit(0))
    seen = F.when(F.col("gain").isNotNull(), today).otherwise(F.coalesce("last_seen", today))
    out = joined.select("topic", "term", "lang", score.cast("long").alias("score"), seen.alias("last_seen"))
    grace = F.when(F.col("score") >= strong_score, strong_expire_days).otherwise(expire_days)
    return out.filter(F.datediff(today, F.col("last_seen")) <= grace)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keywords that came, went or changed score: ``change``, old and new score."""
    a = old.select("topic", "term", "lang", F.col("score").alias("old_score"))
    b = new.select("topic", "term", "lang", F.col("score").alias("new_score"))
    change = F.when(F.col("old_score").isNull(), "added").when(F.col("new_score").isNull(), "removed").when(F.col("old_score") != F.col("new_score"), "changed")
    return a.join(b, ["topic", "term", "lang"], "full_outer").withColumn("change", change).filter("change is not null")


def learned(raw: DataFrame, today: Column) -> DataFrame:
    """The keyword file as rows: records may be bare strings or lack score, language or date.

    ``raw``: ``topic``, ``entry`` (JSON text of one record).
    """
    is_object = F.col("entry").startswith("{")
    field = lambda name: F.when(is_object, F.get_json_object("entry", f"$.{name}"))
    term = F.coalesce(F.coalesce(field("term"), field("keyword")), F.regexp_replace("entry", '^"|"$', ""))
    lang = F.coalesce(field("lang"), F.when(term.rlike(r"^\p{ASCII}*$"), "en").otherwise("zh"))
    return raw.select("topic", term.alias("term"), lang.alias("lang"), F.coalesce(field("score").try_cast("long"), F.lit(1).cast("long")).alias("score"), F.coalesce(F.to_date(F.try_to_timestamp(field("last_seen"))), today).alias("last_seen"))


def grouped_file(keywords: DataFrame) -> DataFrame:
    """One row a topic with its sorted records, as the keyword file has them."""
    record = F.struct(F.col("term").alias("keyword"), "lang", "score", "last_seen")
    return keywords.groupBy("topic").agg(F.array_sort(F.collect_list(record)).alias("keywords"))
