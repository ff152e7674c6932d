"""Queries over cases and collectors against their SQL, and rules without SQL against plain cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.operators import ranking, statuses, tables
from tidewell.plans import cases, catalogue, collected, listings

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in catalogue.QUERIES.items() if n in catalogue.ORACLES and (f.__module__ in (cases.__name__, collected.__name__, listings.__name__) or n in ("pctl_cutoff", "select_full", "cosine_topk", "feed_page"))]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf)
    plain = db.execute(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    names = [d[0] for d in plain.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted([str(r[c]) for c in columns] for r in got.collect()) == sorted([str(r[i]) for i in at] for r in plain.fetchall())


def test_probes_run_every_interval_and_bring_a_provider_back(spark):
    log = [("p", 0, None), ("p", 10, False), ("p", 200, True), ("p", 310, True), ("p", 400, True), ("p", 500, None), ("p", 600, True), ("p", 620, True), ("q", 5, True)]
    df = spark.createDataFrame(log, "provider string, seconds long, up boolean")
    got = [(r.provider, r.seconds, r.probed, r.available) for r in statuses.replay_probes(df).orderBy("provider", "seconds").collect()]
    assert got == [
        ("p", 0, False, False), ("p", 10, True, False), ("p", 200, False, False), ("p", 310, True, True), ("p", 400, False, True), ("p", 500, False, False), ("p", 600, False, False), ("p", 620, True, True),
        ("q", 5, False, True),
    ]


def test_quota_errors_block_for_half_an_hour(spark):
    log = [("w", 0, False), ("w", 10, True), ("w", 20, True), ("w", 1809, False), ("w", 1810, False)]
    got = statuses.replay_quota_backoff(spark.createDataFrame(log, "worker string, seconds long, quota_error boolean")).orderBy("seconds").collect()
    assert [r.sent for r in got] == [True, True, False, False, True]


@pytest.mark.parametrize("shape", ["tail", "ties", "one", "few"])
def test_cutoffs_of_any_shape(spark, shape):
    r = random.Random(shape)
    make = {"tail": lambda i: 10 ** r.uniform(-6, 6), "ties": lambda i: float(i % 3), "one": lambda i: 5.0, "few": lambda i: r.random()}[shape]
    rows = [(f"g{i % 3}", make(i)) for i in range(9 if shape == "few" else 30_000)]
    df = spark.createDataFrame(rows, "lang_group string, hotness double")
    for percent in (0, 1, 10, 50, 100):
        got = {x.lang_group: x.cutoff for x in ranking.cutoffs(df, percent).collect()}
        for g in ("g0", "g1", "g2"):
            scores = sorted((h for k, h in rows if k == g), reverse=True)
            assert got[g] == scores[max(1, int(len(scores) * percent / 100)) - 1], (g, percent)


def test_retention_keeps_rows_without_a_time(spark):
    df = spark.sql("select 1 as id, timestamp'2020-01-01' as at union all select 2, null union all select 3, timestamp'2024-01-01'")
    got = tables.retained(df, "at", F.lit("2024-01-02").cast("timestamp"), 30)
    assert sorted(x.id for x in got.collect()) == [2, 3]


def test_nearest_vectors_over_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(tables, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(tables, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    v = np.vstack([rng.normal(size=(90, 8)), np.zeros((1, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for x in tables.cosine_top(df, df.filter("vec_id % 7 = 0"), 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.where(length > 0, length, 1)
    for q in range(0, 91, 7):
        cosine = np.round(unit @ unit[q], 6)
        best = sorted((i for i in range(91) if i != q), key=lambda i: (-cosine[i], i))[:5]
        assert [i for _, i in sorted(got[q])] == best


def test_queries_repeated_for_blocks_are_not_broadcast(spark, monkeypatch):
    """Spark sees the queries' size before they are repeated, which is small here."""
    monkeypatch.setattr(tables, "VECTOR_BLOCK", 16)
    df = spark.range(90).selectExpr("id as vec_id", "array(double(id), 1d) as embedding")
    got = tables.cosine_top(df, df.filter("vec_id % 7 = 0"), 5)
    assert got.count() == 13 * 5
    run = got._jdf.queryExecution()
    run.toRdd().count()
    assert "Broadcast" not in run.executedPlan().toString()


def test_embeddings_have_length_one(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.v for r in df.select("id", statuses.embedder()(F.col("text")).alias("v")).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and not any(got[2]) and not any(got[3]) and len(got[1]) == 384


def test_best_of_equals_sorting():
    import numpy as np

    rng = np.random.default_rng(4)
    for columns, k in ((1, 3), (7, 3), (300, 10)):
        cosine = rng.integers(0, 5, (40, columns)) / 4
        cosine[rng.random(cosine.shape) < 0.3], cosine[0] = -np.inf, np.nan
        ids = rng.permutation(columns) + 100
        row, at = tables.best_of(cosine, ids, k)
        want = [(i, j) for i in range(40) for j in sorted((j for j in range(columns) if np.isfinite(cosine[i, j])), key=lambda j: (-cosine[i, j], ids[j]))[:k]]
        assert list(zip(row.tolist(), at.tolist(), strict=True)) == want
