"""Feed queries: order, pages, readiness, display columns."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode_cursor(cursor: str | None) -> int | None:
    """Id of a cursor: base64 of a JSON object with ``id``, of a JSON number, or a plain number.

    Anything else, and id 0, is no cursor.
    """
    if not cursor:
        return None
    try:
        value = json.loads(base64.b64decode(cursor, validate=True))
    except ValueError:
        value = cursor
    if isinstance(value, dict):
        value = value.get("id")
    try:
        return int(value) or None
    except (TypeError, ValueError):
        return None


def encode_cursor(last_id: Column, lang: str | None = None) -> Column:
    """Plain id, or with a language a JSON object, in base64."""
    if lang is None:
        return F.base64(F.encode(last_id.cast("string"), "utf-8"))
    return F.base64(F.encode(F.to_json(F.struct(last_id.alias("id"), F.lit(lang).alias("lang"))), "utf-8"))


def filtered(items: DataFrame, region: str | None = None, bucket: str | None = None, lang_group: str | None = None) -> DataFrame:
    """Filters apply only where a value is given; an empty one is no filter."""
    for column, value in (("region_key", region), ("bucket", bucket), ("lang_group", lang_group)):
        if value:
            items = items.filter(F.col(column) == value)
    return items


def recency_order() -> list[Column]:
    return [F.col("collected_at").desc(), F.col("id").desc()]


def scored_first_order() -> list[Column]:
    return [F.col("hotness").isNotNull().desc(), F.col("hotness").desc_nulls_last(), *recency_order()]


def page(items: DataFrame, limit: int, cursor: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """One page and the row after it, which tells whether there are more: limit + 1 rows.

    The cursor filters on ids while the order is by time, as the feed has it; ``keyset_page``
    is the form that never skips rows.
    """
    at = decode_cursor(cursor)
    if at is not None:
        items = items.filter(F.col("id") < at)
    return items.orderBy(*(order or recency_order())).limit(limit + 1)


def keyset_page(items: DataFrame, limit: int, last: tuple | None = None) -> DataFrame:
    """Rows after (collected_at, id) in recency order."""
    if last is not None:
        at, last_id = F.lit(last[0]).cast("timestamp"), F.lit(last[1])
        items = items.filter((F.col("collected_at") < at) | (F.col("collected_at") == at) & (F.col("id") < last_id))
    return items.orderBy(*recency_order()).limit(limit)


def ready_flag(derived: Column, inline_status: Column, inline_title: Column, legacy: Column, native: Column) -> Column:
    """Ready for display: a derivation, an inline translation with a title, a legacy one, or native."""
    inline = inline_status.isin("complete", "skipped") & inline_title.isNotNull()
    return F.coalesce(derived, F.lit(False)) | F.coalesce(inline, F.lit(False)) | F.coalesce(legacy, F.lit(False)) | F.coalesce(native, F.lit(False))


def bounded_scan(items: DataFrame, ready: Column, limit: int, cap: int = 2000) -> DataFrame:
    """Up to ``limit`` ready rows among the first ``cap`` in recency order, with ``position``.

    Sorting and cutting to ``cap`` rows comes first, so that the window runs over ``cap`` rows.
    """
    first = items.orderBy(*recency_order()).limit(cap)
    placed = first.withColumn("position", F.row_number().over(Window.orderBy(*recency_order())))
    return placed.filter(ready).orderBy("position").limit(limit)


def display_title(derived: Column, inline: Column, legacy: Column, original: Column, canonical: Column, same_language: Column) -> Column:
    """Derivation, inline (not for native rows), legacy, original if it is in the language, canonical."""
    return F.coalesce(
        F.nullif(derived, F.lit("")), F.when(~same_language, F.nullif(inline, F.lit(""))), F.nullif(legacy, F.lit("")),
        F.when(same_language, original), canonical, original,
    )


def recent_of_surface(items: DataFrame, surface: str, limit: int) -> DataFrame:
    return items.filter(F.col("surface_key") == surface).orderBy(*recency_order()).limit(limit)


def searched(items: DataFrame, term: str, columns: tuple[str, ...] = ("title", "url", "external_id")) -> DataFrame:
    """Rows with the term in any of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        if c in items.columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    return items.filter(hit)


def excluding(items: DataFrame, column: str, value) -> DataFrame:
    """Rows where the column differs from a value; nulls stay."""
    return items.filter(~F.col(column).eqNullSafe(F.lit(value)))


def drill_down(items: DataFrame, column: str = "collected_at", unit: str = "day") -> DataFrame:
    """Counts by year, month or day."""
    return items.groupBy(F.date_format(F.date_trunc(unit, column), "yyyy-MM-dd").alias("period")).agg(F.count(F.lit(1)).alias("items"))


def offset_page(items: DataFrame, size: int, offset: int) -> DataFrame:
    """Rows from ``offset`` on, newest first. Sorts offset + size rows; pages by key (:func:`page`) need no offset."""
    return items.orderBy(F.col("collected_at").desc(), F.col("id").desc()).offset(offset).limit(size)


def thumbnail(payload: Column) -> Column:
    """Thumbnail address in a raw payload; null without one."""
    return F.get_json_object(payload, "$._thumbnail_url")
