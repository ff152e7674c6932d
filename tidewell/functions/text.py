"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that comment texts use.
COMMENT_ENTITIES = {"&gt;": ">", "&lt;": "<", "&amp;": "&", "&quot;": '"', "&#x27;": "'", "&#x2F;": "/", "&nbsp;": " "}

_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(c, _EDGE, "")


def squeeze(c: Column) -> Column:
    """Trimmed, with every run of white space as one blank."""
    return strip(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def folded(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def canonical_hash(title: Column, url: Column) -> Column:
    """Identity of an item: SHA-256 of its folded title and url."""
    return F.sha2(F.concat(folded(title), F.lit("|"), folded(url)), 256)


def truncated(c: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(c, 1, n)


def snippet(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def without_tags(c: Column) -> Column:
    """Text nodes joined by blanks and trimmed; empty for null."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]+>", " ")
    return squeeze(decoded(bare))


def decoded(c: Column) -> Column:
    """The common named and numeric entities as characters; & comes last."""
    for entity, char in COMMENT_ENTITIES.items():
        if entity != "&amp;":
            c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.replace(c, F.lit("&#39;"), F.lit("'"))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def comment_text(c: Column) -> Column:
    """A comment's text: tags become blanks, entities characters, white space collapses."""
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in COMMENT_ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def template(pattern: str, values: dict[str, Column]) -> Column:
    """``{key}`` in ``pattern`` replaced by the values; null and empty ones by nothing."""
    out = F.lit(pattern)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def salvaged_array(c: Column) -> Column:
    """The JSON array inside a reply: from the first [ to the last ], null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit(""))


def numbered_parts(c: Column) -> Column:
    """Map of number to text for replies like ``[1] text``; blank parts are left out."""
    numbers = F.regexp_extract_all(c, F.lit(r"(?s)(?<=^|\n)\[(\d+)\]\s*(.+?)(?=\n\[\d+\]|\z)"), 1)
    texts = F.regexp_extract_all(c, F.lit(r"(?s)(?<=^|\n)\[(\d+)\]\s*(.+?)(?=\n\[\d+\]|\z)"), 2)
    entries = F.arrays_zip(F.transform(numbers, lambda n: n.cast("int")).alias("n"), F.transform(texts, strip).alias("t"))
    return F.map_from_entries(F.filter(entries, lambda e: e["t"] != ""))


def embedding_text(title: Column, description: Column, comments: Column) -> Column:
    """Title and description within their limits, and up to five comments."""
    kept = F.transform(F.slice(F.coalesce(comments, F.array().cast("array<string>")), 1, 5), lambda c: F.substring(c, 1, 150))
    said = F.when(F.size(kept) > 0, F.concat(F.lit("[comments: "), F.array_join(kept, " | "), F.lit("]")))
    return F.concat_ws(" ", F.nullif(F.substring(title, 1, 200), F.lit("")), F.nullif(F.substring(description, 1, 500), F.lit("")), said)


def translation_key(title: Column, description: Column, kind: Column, locale: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), kind, locale), 256)


def one_decimal(x: Column) -> Column:
    """A number from 0 on with one decimal, as C's printf has it: the double's exact value is rounded, a true half to the even digit.

    Java's formatter rounds the shortest decimal form, and a half away from zero. Doubles near a half are multiples of
    2^-59, and ten times that fits a long.
    """
    whole = F.floor(x)
    tenths = ((x - whole) * F.lit(float(1 << 59))).cast("long") * 10
    digit = F.shiftright(tenths, 59)
    rest = tenths - F.shiftleft(digit, 59)
    up = (rest > 1 << 58) | ((rest == 1 << 58) & (digit % 2 == 1))
    rounded = whole * 10 + digit + up.cast("int")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def short_number(n: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.2M."""
    return (
        F.when(n >= 1_000_000, F.concat(one_decimal(n / 1_000_000.0), F.lit("M")))
        .when(n >= 1_000, F.concat(one_decimal(n / 1_000.0), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def engagement_line(views: Column, upvotes: Column, score: Column, comments: Column, shares: Column) -> Column:
    """Signals that are not zero, in a fixed order; the score only where upvotes are unknown."""
    def part(n: Column, before: str, after: str, when: Column | None = None) -> Column:
        shown = F.coalesce(n, F.lit(0)) != 0
        return F.when(shown if when is None else shown & when, F.concat(F.lit(before), short_number(n), F.lit(after)))

    return F.concat_ws(
        " · ", part(views, "🎬 ", " views"), part(upvotes, "", " 👍"), part(score, "🔥 ", " pts", upvotes.isNull()), part(comments, "", " 💬"), part(shares, "", " 🔁")
    )


def numbered_list(items: Column) -> Column:
    """``1. a`` and so on, one a line."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("(no comments available)")


def masked_secret(c: Column) -> Column:
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "(not set)")
        .when(F.length(c) <= 11, "***")
        .otherwise(F.concat(F.substring(c, 1, 7), F.lit("..."), F.substring(c, -4, 4)))
    )


def ago_label(seconds: Column) -> Column:
    def whole(n: Column, unit: str) -> Column:
        return F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(seconds < 60, whole(seconds, "s"))
        .when(seconds < 3600, whole(seconds / 60, "m"))
        .when(seconds < 86400, whole(seconds / 3600, "h"))
        .otherwise(whole(seconds / 86400, "d"))
    )


def duration_label(ms: Column) -> Column:
    return (
        F.when(ms.isNull(), "-")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(one_decimal(ms / 1000.0), F.lit("s")))
        .otherwise(F.concat(one_decimal(ms / 60000.0), F.lit("m")))
    )


def max_age(cache_control: Column) -> Column:
    return F.regexp_extract(cache_control, r"max-age=(\d+)", 1).try_cast("int")
