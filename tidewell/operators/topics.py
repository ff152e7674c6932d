"""Topic classification: layered heuristics and the cycle around an external classifier."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.collections import highest_priority, looked_up
from tidewell.functions.text import strip
from tidewell.operators.ranking import hottest, pending_top

#: Vocabulary in order of priority, and the maps from sources.
PRIORITY = ["ai", "politics", "crypto", "business", "technology", "science", "world", "society", "sports", "entertainment"]
BUCKET_TOPICS = {
    "category_ai": "ai", "category_tech": "technology", "category_finance": "business", "category_politics": "politics",
    "category_entertainment": "entertainment", "category_gaming": "entertainment", "category_science": "science",
    "category_sports": "sports", "category_lifestyle": "society", "category_health": "society", "category_crime": "society",
    "category_environment": "science", "category_crypto": "crypto", "international_news": "world", "world_news": "world",
    "global_news": "world",
}
PLATFORM_TOPICS = {"paperswithcode": "ai", "arxiv_ai_rss": "ai", "devto": "technology", "lobsters": "technology", "stackoverflow": "technology"}
TAG_TOPICS = {
    "ai": "ai", "tech": "technology", "politics": "politics", "finance": "business", "business": "business", "science": "science",
    "society": "society", "health": "society", "crime": "society", "environment": "science", "sports": "sports", "entertainment": "entertainment",
}
TAG_PRIORITY = ["ai", "politics", "business", "technology", "science", "society", "sports", "entertainment"]
#: Confidence of a signal.
TIERS = {"bucket": "high", "platform": "high", "keyword": "medium", "locale": "low", "surface": "low"}


def keyword_regex(terms: list[str]) -> str:
    """One alternation for a category's terms; a word boundary stands at an end that is a letter or digit."""
    parts = []
    for term in dict.fromkeys(t for t in terms if t):
        quoted = re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", term)
        parts.append((r"\b" if term[0].isalnum() else "") + quoted + (r"\b" if term[-1].isalnum() else ""))
    return "(?iuU)(?:" + "|".join(parts) + ")"


def matched_topics(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """Categories whose terms occur: one compiled pattern each, no join with the terms."""
    hits = [F.when(text.rlike(keyword_regex(terms)), F.lit(topic)) for topic, terms in vocabulary.items() if terms]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def keyword_topic(title: Column, description: Column, vocabulary: dict[str, list[str]], priority: list[str] = PRIORITY) -> Column:
    text = F.concat(strip(F.coalesce(title, F.lit(""))), F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" "), F.substring(description, 1, 300))).otherwise(""))
    return highest_priority(matched_topics(text, vocabulary), priority)


def waterfall(
    items: DataFrame, vocabulary: dict[str, list[str]], buckets: dict[str, str] = BUCKET_TOPICS, platforms: dict[str, str] = PLATFORM_TOPICS,
    surfaces: dict[str, str] | None = None,
) -> DataFrame:
    """Adds ``topic``, ``signal``, ``tier``: bucket, platform, keywords, locale, surface; the first that tells.

    The keyword patterns run only for rows that the maps before them leave open.
    """
    locale = F.when((F.col("lang_group") == "zh") & (F.col("platform") == "bilibili"), "entertainment")
    signals = {
        "bucket": looked_up(buckets, F.col("bucket")), "platform": looked_up(platforms, F.col("platform")),
        "keyword": keyword_topic(F.col("title"), F.col("description"), vocabulary), "locale": locale,
        "surface": looked_up(surfaces or {}, F.col("surface_key")),
    }
    found = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("topic"), F.lit(s).alias("signal"), F.lit(TIERS[s]).alias("tier"))) for s, c in signals.items()])
    return items.withColumn("__found", found).select(
        *items.columns, F.col("__found.topic").alias("topic"), F.col("__found.signal").alias("signal"), F.coalesce("__found.tier", F.lit("none")).alias("tier")
    )


def version(taxonomy: str, vocabulary_text: str) -> str:
    """Token of the rules in force: taxonomy and the first 8 digits of the vocabulary's SHA-256."""
    import hashlib

    return f"{taxonomy}:{hashlib.sha256(vocabulary_text.encode()).hexdigest()[:8]}"


def cycle(items: DataFrame, vocabulary: dict[str, list[str]], answers: DataFrame, version_: str, llm: bool = True, top: int = 200, llm_top: int = 50, **maps) -> DataFrame:
    """One cycle over pending rows: ``id``, ``story_category``, ``classified_by``, ``classification_state``,
    ``classification_version``.

    ``answers``: ``id``, ``answer`` of the external classifier (null: no answer). It is asked about
    rows without a confident signal that are among their platform's hottest.
    """
    fetched = hottest(items.filter("classification_state = 'pending'"), "platform", top).drop("rank_in_group")
    asked = pending_top(fetched, llm_top).select("id", F.lit(True).alias("asked"))
    rated = waterfall(fetched, vocabulary, **maps).join(asked, "id", "left").join(answers, "id", "left")
    eligible = F.col("tier").isin("low", "none") & F.coalesce("asked", F.lit(False)) & F.lit(llm)
    by_llm = eligible & F.col("answer").isNotNull()
    known = F.col("topic").isNotNull()
    return rated.select(
        "id",
        F.when(by_llm, F.col("answer")).otherwise(F.col("topic")).alias("story_category"),
        F.when(by_llm, "llm").when(known, F.col("signal")).alias("classified_by"),
        F.when(by_llm, "llm_complete").when(known, "heuristic_complete").otherwise("failed").alias("classification_state"),
        F.when(by_llm | known, F.lit(version_)).alias("classification_version"),
    )


def requeue_stale(items: DataFrame, version_: str) -> DataFrame:
    """Rows not classified externally, whose version is another one, become pending again."""
    stale = (
        ~F.col("classification_version").eqNullSafe(F.lit(version_)) & ~F.col("classified_by").eqNullSafe(F.lit("llm"))
        & ~F.col("classification_state").eqNullSafe(F.lit("pending"))
    )
    return items.withColumn("classification_state", F.when(stale, "pending").otherwise(F.col("classification_state")))


def tag_category(tags: Column) -> Column:
    mapped = F.array_compact(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: looked_up(TAG_TOPICS, t)))
    return highest_priority(mapped, TAG_PRIORITY)


def backfill_state(items: DataFrame) -> DataFrame:
    """State and category of rows from before states existed; others than external ones start anew."""
    by_llm = F.col("classified_by").eqNullSafe(F.lit("llm"))
    category = tag_category(F.col("topic_tags"))
    # step one gives every row a state; rows not classified externally are then reset
    return items.select(
        "id",
        F.when(by_llm & category.isNotNull(), "llm_complete").when(by_llm, "failed").otherwise("pending").alias("classification_state"),
        F.when(by_llm, category).alias("story_category"),
    )


def heuristic_state(items: DataFrame) -> Column:
    """The state that backfilling gives first, before the reset."""
    some = F.size(F.coalesce(F.col("topic_tags"), F.array().cast("array<string>"))) > 0
    return (
        F.when(F.col("classified_by") == "llm", "llm_complete")
        .when(F.col("topic_classified_at").isNull(), "pending")
        .when(F.col("classified_by") == "heuristic", F.when(some, "heuristic_complete").otherwise("failed"))
        .when(F.col("classified_by").isNull(), "heuristic_complete")
        .otherwise("pending")
    )


#: Texts of an exhausted quota.
QUOTA_TEXTS = ("usage limit", "usage_limit", "rate limit", "rate_limit", "quota", "too many requests", "credit balance", "limit reached")


def quota_error(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(QUOTA_TEXTS))


def summary_strategy(platform: Column, description: Column, has_signals: Column) -> Column:
    """How an item is summarised."""
    p = F.lower(F.coalesce(platform, F.lit("")))
    return (
        F.when(p.rlike("twitter|yahoo_jp"), "skip")
        .when(F.contains(p, F.lit("youtube")), "youtube")
        .when(F.length(strip(F.coalesce(description, F.lit("")))) > 30, F.when(p.rlike("reddit|hacker"), "discussion").otherwise("news_article"))
        .when(has_signals, "signals_only")
        .otherwise("skip")
    )
