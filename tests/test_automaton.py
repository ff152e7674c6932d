"""The automaton against regular expressions, its cost, and the reload inside a stream."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidewell.operators import automaton
from tidewell.streaming import pipelines


def by_regex(text, vocabulary):
    def holds(term):
        return re.search((r"\b" if term[0].isalnum() else "") + re.escape(term) + (r"\b" if term[-1].isalnum() else ""), text, re.IGNORECASE)

    return [c for c, terms in vocabulary.items() if any(holds(t) for t in terms if t)]


def vocabulary(words, n, seed=1):
    r = random.Random(seed)
    pick = lambda: " ".join(r.choice(words) for _ in range(r.choice((1, 1, 2))))[: r.choice((2, 5, 40))]
    return {c: [pick() for _ in range(n // 4)] for c in ("ai", "politics", "science", "sports")}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(50).collect()]


def test_equals_regular_expressions(spark, texts):
    words = sorted({w for t in texts for w in t.split()})
    v = vocabulary(words, 1200)
    v["world"] = [" AI ", "U.S.", "_x", "", "naïve", "İ", "GDP-"]
    more = [*texts, None, "", "an AI thing", "the U.S.A", "u.s. b_x", "NAÏVE", "xAI ", "GDP-5"]
    got = automaton.matched(spark.createDataFrame(list(enumerate(more)), "id long, t string"), F.col("t"), v).collect()
    assert {r.id: r.topics for r in got} == {i: by_regex(t or "", v) if t else [] for i, t in enumerate(more)}
    assert automaton.matched(spark.createDataFrame([(1, "x")], "id long, t string"), F.col("t"), {}).first().topics == []


def test_cost_does_not_grow_with_the_terms(texts):
    words = [f"zz{i}" for i in range(30_000)]
    took = []
    for n in (200, 20_000):
        k = automaton.Keywords(vocabulary(words, n))
        began = time.process_time()
        for t in texts * 4:
            k.found(t)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.05


def test_a_changed_file_takes_effect_in_the_next_batch(spark, tmp_path):
    file, out = tmp_path / "keywords.json", []
    items, at = str(tmp_path / "items"), str(tmp_path / "at")
    write = lambda df, batch_id, version: out.append((version, {r.id: r.topic for r in df.collect()}))
    each = automaton.reloading(spark, str(file), {"ai": ["neural"]}, write, lambda: F.col("title"))

    def drain():
        stream = pipelines.files(spark, items, "id long, title string")
        pipelines.each_batch(stream, at, each).awaitTermination()

    spark.createDataFrame([(1, "neural nets"), (2, "a new tariff")], "id long, title string").coalesce(1).write.parquet(items)
    drain()
    file.write_text(json.dumps({"keywords": {"business": [{"term": "tariff"}, {"x": 1}], "finance": ["neural"]}}))
    spark.createDataFrame([(3, "a new Tariff"), (4, "neural")], "id long, title string").coalesce(1).write.mode("append").parquet(items)
    drain()
    file.write_text("broken")
    spark.createDataFrame([(5, "a tariff"), (6, "neural")], "id long, title string").coalesce(1).write.mode("append").parquet(items)
    drain()
    assert [x[1] for x in out] == [{1: "ai", 2: None}, {3: "business", 4: "ai"}, {5: None, 6: "ai"}]
    assert out[0][0] == "" == out[2][0] and len(out[1][0]) == 8
