"""Locales, language groups, and the border to a language detector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.collections import looked_up
from tidewell.functions.text import strip

#: The language group of each locale.
LOCALE_GROUP = {
    "zh-Hans": "zh", "zh-Hant": "zh", "zh-CN": "zh", "zh-TW": "zh", "zh-HK": "zh", "zh-SG": "zh",
    "en-US": "en", "en-GB": "en", "en-AU": "en", "en-CA": "en", "en-NZ": "en", "en-IE": "en",
    "ja-JP": "ja", "ja": "ja",
    "ko-KR": "ko", "ko": "ko",
    "es-ES": "es", "es-MX": "es", "es-AR": "es", "es-CO": "es", "es-CL": "es",
    "fr-FR": "fr", "fr-CA": "fr", "fr-BE": "fr", "fr-CH": "fr",
    "de-DE": "de", "de-AT": "de", "de-CH": "de",
    "pt-BR": "pt", "pt-PT": "pt",
    "it-IT": "it", "it": "it",
    "ru-RU": "ru", "ru": "ru",
    "ar-SA": "ar", "ar-AE": "ar", "ar-EG": "ar",
    "hi-IN": "hi", "hi": "hi",
    "id-ID": "id", "id": "id",
    "th-TH": "th", "th": "th",
    "vi-VN": "vi", "vi": "vi",
    "nl-NL": "nl", "nl-BE": "nl", "nl": "nl",
    "pl-PL": "pl", "pl": "pl",
    "tr-TR": "tr", "tr": "tr",
    "sv-SE": "sv", "sv": "sv",
    "no-NO": "no", "nb-NO": "no", "nn-NO": "no", "no": "no",
    "da-DK": "da", "da": "da",
    "fi-FI": "fi", "fi": "fi",
    "el-GR": "el", "el": "el",
    "he-IL": "he", "he": "he",
    "cs-CZ": "cs", "cs": "cs",
    "hu-HU": "hu", "hu": "hu",
    "ro-RO": "ro", "ro": "ro",
    "uk-UA": "uk", "uk": "uk",
}
#: The locale that a bare language stands for.
DEFAULT_LOCALE = {
    "zh": "zh-Hans", "en": "en-US", "ja": "ja-JP", "ko": "ko-KR", "es": "es-ES", "fr": "fr-FR", "de": "de-DE", "pt": "pt-BR",
    "it": "it-IT", "ru": "ru-RU", "ar": "ar-SA", "hi": "hi-IN", "id": "id-ID", "th": "th-TH", "vi": "vi-VN", "nl": "nl-NL",
    "pl": "pl-PL", "tr": "tr-TR", "sv": "sv-SE", "no": "no-NO", "da": "da-DK", "fi": "fi-FI", "el": "el-GR", "he": "he-IL",
    "cs": "cs-CZ", "hu": "hu-HU", "ro": "ro-RO", "uk": "uk-UA",
}


def normalized_locale(locale: Column) -> Column:
    c = F.replace(locale, F.lit("_"), F.lit("-"))
    low = F.lower(c)
    return (
        F.when(low == "zh-hans", "zh-Hans")
        .when(low.isin("zh-hant", "zh-tw"), "zh-Hant")
        .when(low == "en", "en-US")
        .when(low == "ja", "ja-JP")
        .when(F.size(F.split(c, "-")) == 2, F.concat(F.split_part(low, F.lit("-"), F.lit(1)), F.lit("-"), F.upper(F.split_part(c, F.lit("-"), F.lit(2)))))
        .otherwise(c)
    )


def lang_group(locale: Column) -> Column:
    n = normalized_locale(locale)
    return F.coalesce(looked_up(LOCALE_GROUP, n), F.lower(F.split_part(n, F.lit("-"), F.lit(1))))


def same_family(a: Column, b: Column) -> Column:
    return lang_group(a) == lang_group(b)


def detector(detect: Callable[[str, str], str]):
    """A pandas UDF around an external detector (text, fallback) -> code; blank texts and errors give the fallback.

    Without one, :mod:`tidewell.operators.language_model` detects.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, fallbacks in batches:
            out = []
            for text, fallback in zip(texts, fallbacks, strict=True):
                try:
                    out.append(detect(text, fallback) if text and text.strip() else fallback)
                except Exception:
                    out.append(fallback)
            yield pd.Series(out, dtype=object)

    return run


def classified(items: DataFrame, detected: Column) -> DataFrame:
    """Adds ``base_lang``, ``locale``, ``lang_group``.

    ``detected``: language code of title and description. Chinese variants become zh. If the collector's
    locale (``original_locale``) belongs to another group, it wins. The locale is the region's default
    (``default_locale``) where the language is the same, else the language's default, else ``xx-XX``.
    """
    base = F.when(F.lower(detected).startswith("zh"), "zh").otherwise(F.lower(detected))
    said = lang_group(F.col("original_locale"))
    final = F.when(said.isNotNull() & (said != "") & (said != lang_group(base)), said).otherwise(base)
    default = F.col("default_locale")
    same = F.split_part(F.lower(default), F.lit("-"), F.lit(1)) == final
    locale = F.when(same, default).otherwise(F.coalesce(looked_up(DEFAULT_LOCALE, final), F.concat(final, F.lit("-"), F.upper(final))))
    return items.withColumn("base_lang", final).withColumn("locale", locale).withColumn("lang_group", lang_group(F.col("locale")))


def translation_skip(source: Column, target: Column) -> Column:
    """Whether a display translation passes through: the same locale or language."""
    a, b = F.lower(F.substring(source, 1, 2)), F.lower(F.substring(target, 1, 2))
    return (source == target) | (a == b)


def test_translation(text: Column, target: Column) -> Column:
    """The deterministic stand-in for an engine; null (an error) for an empty text."""
    return F.when(strip(text) != "", F.concat(F.lit("["), target, F.lit("] "), text))


def engine_order(primary: Column, fallbacks: Column, healthy: Column) -> Column:
    """Primary engine, then the fallbacks without repeats, those that are healthy."""
    return F.array_intersect(F.array_distinct(F.concat(F.array(primary), fallbacks)), healthy)
