"""Scores, bands, budgets and number parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import strip

#: Weights of the signals, decay per hour, and names a signal goes by.
DECAY = 0.05
WEIGHTS = {"upvotes": 1.0, "comments": 2.0, "views": 0.1, "shares": 3.0, "rank": 10.0}
ALIASES = {
    "upvotes": ("upvotes", "score", "points"),
    "comments": ("comments", "num_comments", "comment_count"),
    "views": ("views", "view_count"),
    "shares": ("shares", "share_count"),
}
BANDS = ((500, "Top 1%"), (300, "Top 5%"), (200, "Top 10%"), (100, "Top 25%"), (50, "Top 50%"))


def recency_decay(hours: Column) -> Column:
    """exp(-0.05 h), with hours before 0 taken as 0."""
    return F.exp(F.greatest(hours, F.lit(0.0)) * -DECAY)


def first_signal(values: list[Column]) -> Column:
    """The first value that is neither null nor zero, else 0: an explicit zero falls through."""
    return F.coalesce(*[F.nullif(v.cast("double"), F.lit(0.0)) for v in values], F.lit(0.0))


def map_signal(signals: Column, name: str) -> Column:
    return first_signal([F.try_element_at(signals, F.lit(k)) for k in ALIASES[name]])


def rank_score(rank: Column) -> Column:
    return F.when(rank > 0, F.greatest(F.lit(0.0), 100.0 - rank.cast("double"))).otherwise(0.0)


def engagement_weight(upvotes: Column, comments: Column, views: Column, shares: Column, rank: Column) -> Column:
    """Weighted sum of the signals and the rank, 0 at least."""
    parts = {"upvotes": first_signal([upvotes]), "comments": first_signal([comments]), "views": first_signal([views]), "shares": first_signal([shares])}
    total = reduce(Column.__add__, [v * WEIGHTS[k] for k, v in parts.items()]) + rank_score(rank) * WEIGHTS["rank"]
    return F.greatest(F.lit(0.0), total)


def hotness(weight: Column, hours: Column) -> Column:
    return recency_decay(hours) * F.log10(1.0 + weight) * 100.0


def needs_recompute(hotness_: Column, hours_since_computed: Column, hours_old: Column, threshold: float = 6.0) -> Column:
    due = (hours_since_computed >= threshold) | ((hours_old < 48.0) & (hours_since_computed >= threshold / 2))
    return hotness_.isNull() | hours_since_computed.isNull() | due


def band(hotness_: Column) -> Column:
    out = None
    for bound, label in BANDS:
        out = F.when(hotness_ >= bound, label) if out is None else out.when(hotness_ >= bound, label)
    return out.otherwise("Bottom 50%")


def backoff_delay(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """min(base 2^attempt, cap); jitter is left to the caller."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def jittered(delay: Column, draw: Column, percent: float = 0.3) -> Column:
    """``delay`` moved by up to ``percent`` either way, by a uniform draw from [0, 1)."""
    return delay * (1 - percent + draw * 2 * percent)


def cjk_number(c: Column) -> Column:
    """3856万 as 38560000, 1.2亿 as 120000000, unit words dropped; what can't be read is 0."""
    bare = strip(F.regexp_replace(F.coalesce(c, F.lit("")), ",|热度|搜索", ""))

    def scaled(unit: str, by: int) -> Column:
        return F.replace(bare, F.lit(unit), F.lit("")).try_cast("double") * by

    digits = F.regexp_replace(bare, r"[^0-9.]", "").try_cast("double")
    value = F.when(F.contains(bare, F.lit("亿")), scaled("亿", 100_000_000)).when(F.contains(bare, F.lit("万")), scaled("万", 10_000)).otherwise(digits)
    return F.coalesce(value.cast("long"), F.lit(0).cast("long"))


def abbreviated_number(c: Column) -> Column:
    """``12.5k`` as 12500, ``1,234 stars today`` as 1234; what can't be read is 0."""
    first = F.regexp_extract(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(""))), r"^\s*(\S+)", 1)
    thousands = F.regexp_extract(first, r"^(.*)k$", 1).try_cast("double") * 1000
    return F.coalesce(F.when(first.endswith("k"), thousands.cast("long")).otherwise(first.try_cast("long")), F.lit(0).cast("long"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 part / whole, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits))


def budget_cap(direct: Column, base: Column | int) -> Column:
    """Simulated requests allowed an hour: 30 % of the direct ones, ``base`` at least."""
    return F.greatest(F.floor(direct * 0.30), F.lit(base) if isinstance(base, int) else base)


def truncated_percent(total: Column, percent_: Column | float) -> Column:
    """``total`` percent, cut to a whole number toward zero."""
    return (total * percent_ / 100).cast("int")


def quota_target(total: Column, percent_: int, low: int = 2, high: int = 5, small: int = 20) -> Column:
    """Target of the validators: small groups between ``low`` and ``high``, others by percent."""
    by_percent = F.greatest(F.lit(1), truncated_percent(total, percent_))
    return F.when(total < small, F.least(total.cast("int"), F.greatest(F.lit(low), F.least(F.lit(high), by_percent)))).otherwise(by_percent)


def reddit_upvotes(score: Column, ratio: Column) -> Column:
    """Votes from a score and an upvote ratio; a half leaves the score, 0 gives 0."""
    return F.when(ratio == 0, F.lit(0)).when(ratio == 0.5, score.cast("int")).otherwise((score / (2 * ratio - 1)).cast("int"))


def whole_percent(part: Column, whole: Column) -> Column:
    """100 part / whole in whole numbers, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 100 / F.nullif(whole, F.lit(0))))


def lognormal_delay(mode: Column, draw: Column, low: float, high: float, sigma: float = 0.5) -> Column:
    """exp(ln(mode) + sigma * draw), within the bounds; ``draw`` comes from a standard normal distribution."""
    return F.greatest(F.lit(low), F.least(F.exp(F.log(mode) + sigma * draw), F.lit(high)))
