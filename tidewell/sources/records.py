"""Item records: the columns every collector's parser gives, and the adapters that fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.collections import looked_up, positive_entries
from tidewell.operators.languages import DEFAULT_LOCALE

COLUMNS = ("source", "external_id", "title", "description", "url", "rank_position", "published_at", "signals", "raw")


def default_locale(language: Column) -> Column:
    """Locale of a bare language: the known default, else ``xx-XX``; a full locale stays."""
    return F.when(F.contains(language, F.lit("-")), language).otherwise(F.coalesce(looked_up(DEFAULT_LOCALE, language), F.concat(F.lower(language), F.lit("-"), F.upper(language))))


def signals(**values: Column) -> Column:
    """Engagement as a map; signals that are null or not positive are left out."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in values.items()]
    return positive_entries(F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))) if entries else F.create_map().cast("map<string,double>")


def merged_extras(base: Column, extras: Column) -> Column:
    """Extra entries added to a map; keys that it has already are never overwritten."""
    fresh = F.map_filter(extras, lambda k, v: v.isNotNull() & ~F.map_contains_key(base, k))
    return F.map_concat(base, fresh)


def absent_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def record(df: DataFrame, source: str, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The record columns, behind those to ``keep``; columns not given are null."""
    types = {"rank_position": "int", "published_at": "timestamp", "signals": "map<string,double>"}
    return df.select(*keep, *[F.lit(source).alias("source") if c == "source" else columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS])
