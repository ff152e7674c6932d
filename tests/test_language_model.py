"""The trigram model against plain counting, on odd texts and held-out documents."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.operators import language_model


def grams(text):
    t = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    t = re.sub(" +", " ", t).strip()
    t = f" {t} "
    return [t[i : i + 3] for i in range(len(t) - 2)] if t.strip() else []


def plain_fit(rows, size):
    counts = Counter((lang, g) for lang, text in rows for g in grams(text))
    total = Counter()
    for (_, g), n in counts.items():
        total[g] += n
    chosen = sorted(total, key=lambda g: (-total[g], g.encode()))[:size]
    langs = sorted({lang for lang, _ in rows})
    held = {x: sum(counts[x, g] for g in chosen) for x in langs}
    share = {x: math.log(sum(lang == x for lang, _ in rows) / len(rows)) for x in langs}
    return lambda text: best(
        {x: share[x] + sum(math.log((counts[x, g] + 0.5) / (held[x] + 0.5 * len(chosen))) for g in grams(text) if g in set(chosen)) for x in langs}, any(g in set(chosen) for g in grams(text))
    )


def best(scores, known):
    return min(scores, key=lambda x: (-scores[x], x)) if known else None


TEXTS = [
    ("en", "The quick brown fox jumps over the lazy dog and runs through the woods"), ("en", "She said that the weather is going to be fine this evening"), ("de", "Der schnelle braune Fuchs springt über den faulen Hund"),
    ("de", "Das Wetter soll heute Abend schön werden, sagte sie"), ("ja", "今日は天気がとても良いので散歩に行きました"), ("ru", "Сегодня хорошая погода и мы пошли гулять"), ("fr", "Le renard brun saute par-dessus le chien paresseux"),
]


@pytest.mark.parametrize("size", [1000, 60])
def test_equals_plain_counting(spark, size):
    docs = spark.createDataFrame([*TEXTS, (None, "left out"), ("en", None)], "lang string, text string")
    model = language_model.fit(docs, vocabulary=size)
    want = plain_fit([*TEXTS, ("en", None)], size)
    asked = ["the dog", "Hund und Fuchs", "天気", "погода!", "", None, "12 34", "le chien", "\U00020000\U00020001 x\U0001f600y the", "zz", " a "]
    got = {r.id: r.detected for r in language_model.detected(spark.createDataFrame(list(enumerate(asked)), "id long, text string"), model, F.col("text")).collect()}
    assert {i: x for i, t in enumerate(asked) if (x := want(t)) is not None} == got


def test_supplementary_characters_stay_whole(spark):
    df = spark.createDataFrame([("a\U00020000\U00020001b",)], "t string")
    assert df.select(language_model.trigrams(F.col("t"))).first()[0] == [" a\U00020000", "a\U00020000\U00020001", "\U00020000\U00020001b", "\U00020001b "]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_model.fit(docs.filter("doc_id % 3 <> 1"))
    held = docs.filter("doc_id % 3 = 1 and lang is not null")
    joined = held.join(language_model.detected(held, model, F.col("text"), "doc_id"), "doc_id")
    right = {r.lang: r.right / r.n for r in joined.groupBy("lang").agg(F.count_if(F.col("lang") == F.col("detected")).alias("right"), F.count("*").alias("n")).collect()}
    assert len(right) > 2 and min(right.values()) >= 0.95, right


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, lang string, text string")
    model = language_model.fit(empty)
    assert language_model.detected(spark.createDataFrame([(1, "x")], "id long, text string"), model, F.col("text")).count() == 0
    full = language_model.fit(spark.createDataFrame(TEXTS, "lang string, text string"))
    assert language_model.detected(empty, full, F.col("text")).count() == 0


def test_more_than_twenty_thousand_rows_are_all_counted(spark):
    """A fit takes every labelled row: here a trigram that one row in 25,000 has."""
    docs = spark.range(25_000).select(F.lit("en").alias("lang"), F.when(F.col("id") == 17, "zq").otherwise("ab").alias("text"))
    n = {r.gram: r.logs[0] for r in language_model.fit(docs).weights.collect()}
    total = 2 * 25_000 + 0.5 * 4
    assert n == pytest.approx({" ab": math.log(24_999.5 / total), "ab ": math.log(24_999.5 / total), " zq": math.log(1.5 / total), "zq ": math.log(1.5 / total)})


@pytest.mark.parametrize("direct", [1 << 22, 1])
def test_weights_find_trigrams(monkeypatch, direct):
    monkeypatch.setattr(language_model, "_DIRECT", direct)
    known = [" ab", "ab ", "\U00020000\U00020001 "]
    keys, row = language_model._read([" ab ", "", " b", " \U00020000\U00020001 "])
    assert row.tolist() == [0, 0, 3, 3] and language_model._Weights(known).rows(keys).tolist() == [0, 1, 3, 2]
