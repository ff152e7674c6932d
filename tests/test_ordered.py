"""As-of joins, streaks and sliding counts over runs against plain loops; a hot key spans many runs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import ordered, policy

START = datetime(2024, 1, 1)


@pytest.fixture(params=[True, False], ids=["many runs", "few runs"])
def many(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not request.param).lower())
    spark.conf.set("spark.sql.shuffle.partitions", "13" if request.param else "2")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def log(seed, n=600):
    r = random.Random(seed)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", "c", None])
    return [(i, key(), None if r.random() < 0.02 else START + timedelta(seconds=r.randrange(900)), r.random() < 0.2) for i in range(n)]


def test_as_of(spark, many):
    left, right = log(1), log(2, 200)
    a, b = spark.createDataFrame(left, "id long, k string, ts timestamp, ok boolean"), spark.createDataFrame(right, "eid long, k string, at timestamp, ok boolean")
    got = {r.id: r.found.eid if r.found else None for r in ordered.as_of(a, b, "k", "ts", "at", ["eid"]).collect()}
    for i, k, ts, _ in left:
        before = [(at, eid) for eid, key, at, _ in right if key == k and k is not None and at is not None and ts is not None and at <= ts]
        assert got[i] == (max(before)[1] if before else None)
    assert len(got) == len(left)
    assert all(r.found is None for r in ordered.as_of(a, b.limit(0), "k", "ts", "at").collect()) and ordered.as_of(a.limit(0), b, "k", "ts", "at").count() == 0


def test_streaks(spark, many):
    rows = [(i, k or "x", i * 3 % 601, ok) for i, k, _, ok in log(3)]
    got = {r.id: r.streak for r in ordered.streaks(spark.createDataFrame(rows, "id long, k string, at long, ok boolean"), "k", ["at", "id"], F.col("ok")).collect()}
    held = {}
    for i, k, _, ok in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        held[k] = 0 if ok else held.get(k, 0) + 1
        assert got[i] == held[k]


def test_sliding_counts(spark, many):
    rows = log(4)
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, ok boolean")
    got = {r.id: r.in_window for r in ordered.sliding_counts(df, "k", "ts", 60).collect()}
    for i, k, ts, _ in rows:
        want = None if k is None or ts is None else sum(key == k and at is not None and ts - timedelta(seconds=60) <= at <= ts for _, key, at, _ in rows)
        assert got[i] == want
    assert ordered.sliding_counts(df.limit(0), "k", "ts", 60).count() == 0


def test_no_run_holds_a_hot_key(spark):
    rows = [(i, "hot", START + timedelta(seconds=i)) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    runs = ordered.in_runs(spark.createDataFrame(rows, "id long, k string, ts timestamp"), ["k", "ts"])
    sizes = [r["count"] for r in runs.groupBy(ordered.RUN).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2000


def test_a_later_entry_never_answers(spark):
    at = lambda m: START + timedelta(minutes=m)
    requests = spark.createDataFrame([(1, "u", at(-5)), (2, "u", at(5)), (3, "u", at(70)), (4, "v", at(1)), (5, None, at(1)), (6, "u", at(200))], "id long, url_hash string, ts timestamp")
    cache = spark.createDataFrame([("u", at(0), at(60), "e1"), ("u", at(0), at(10), "e0"), ("u", at(100), at(130), None), (None, at(0), at(60), "x")], "url_hash string, validated_at timestamp, expires_at timestamp, etag string")
    got = {r.id: r.cache for r in policy.cached_response(requests, cache).collect()}
    assert got == {1: "miss", 2: "fresh", 3: "revalidate", 4: "miss", 5: "miss", 6: "miss"}
