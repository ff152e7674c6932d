"""Latent vectors against a dense decomposition, odd texts, and how well neighbours agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import latent, statuses


def dense(rows, n):
    a = np.zeros((len(rows), n))
    for i, r in enumerate(rows):
        a[i, r.ts] = r.ws
    return a


def test_equals_dense_decomposition(spark):
    r = np.random.default_rng(2)
    topics = [[f"w{k}_{i}" for i in range(12)] for k in range(5)]
    docs = [(k, " ".join(r.choice(topics[k % 5], 20)) + " common " + " ".join(r.choice(topics[(k + 1) % 5], 3))) for k in range(120)]
    model, rows = latent.fit(spark.createDataFrame(docs, "id long, text string"), dimensions=5)
    held = rows.collect()
    a = dense(held, model.terms.count())
    assert np.allclose(np.linalg.norm(a, axis=1), 1)
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.singular, s[:5], rtol=1e-3)
    y = a @ v[:5].T
    want = y / np.linalg.norm(y, axis=1)[:, None]
    got = {x.id: x.embedding for x in latent.vectors(rows, model).collect()}
    ours = np.array([got[x.id] for x in held])
    assert np.abs(ours @ ours.T - want @ want.T).max() < 0.02


def test_odd_texts(spark):
    docs = [(1, "a b c d"), (2, "a b c d"), (2, "a b x"), (None, "c d a"), (4, None), (5, ""), (6, "unseen words"), (7, "!!")]
    df = spark.createDataFrame(docs, "id long, text string").withColumns({"t": F.lit("clash"), "ws": F.lit("clash"), "term": F.lit("clash")})
    model, rows = latent.fit(df, dimensions=3)
    got = latent.vectors(rows, model).collect()
    assert len(got) == len(docs) and {x.id for x in got if x.embedding is None} == {4, 5, 6, 7}
    empty, none = latent.fit(spark.createDataFrame([], "id long, text string"))
    assert latent.vectors(none, empty).count() == 0
    assert [x.embedding for x in latent.vectors(*latent.fit(spark.createDataFrame([(1, "once")], "id long, text string"))[::-1]).collect()] == [None]


def test_neighbours_agree_more_often_than_those_of_hashed_counts(spark):
    """Share of nearest neighbours in the same language, for every document as a query."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    model, rows = latent.fit(docs)
    lang = {r.id: r.lang for r in docs.collect()}

    def agreement(pairs):
        ids, m = [p[0] for p in pairs], np.array([p[1] for p in pairs])
        near = m @ m.T
        np.fill_diagonal(near, -2)
        return np.mean([lang[ids[i]] == lang[ids[j]] for i, j in enumerate(near.argmax(axis=1))])

    ours = agreement([(r.id, r.embedding) for r in latent.vectors(rows, model).collect() if r.embedding])
    hashed = agreement([(r.id, r.e) for r in docs.select("id", statuses.embedder()(F.col("text")).alias("e")).collect()])
    assert ours >= hashed and ours >= 0.95


def test_registered_neighbours(spark, sf):
    from tidewell.plans import cases

    held = {r.doc_id: np.array(r.embedding) for r in cases.embedded_texts(spark, sf).collect() if r.embedding}
    ids, m = list(held), np.array(list(held.values()))
    got = {}
    for r in cases.latent_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r.cosine)
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, cosines in got.items():
        near = sorted((float(v @ held[q]) for i, v in zip(ids, m, strict=True) if i != q), reverse=True)[:5]
        assert sorted(cosines, reverse=True) == pytest.approx(near, abs=1e-5)


def test_no_term_of_a_text_is_shuffled(spark):
    """Terms are counted where the text is read: the rows' plan has no exchange, and a text of many words is one row."""
    docs = spark.createDataFrame([(1, "a b a c " * 5000), (2, "a b"), (3, "c")], "id long, text string")
    rows = latent.weighted(docs, latent.vocabulary(docs))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.id: dict(zip(r.ts, r.ws, strict=True)) for r in rows.collect()}
    idf = {r.t: r.idf for r in latent.vocabulary(docs).collect()}
    names = {r.term: r.t for r in latent.vocabulary(docs).collect()}
    raw = {names[x]: (1 + np.log(n)) * idf[names[x]] for x, n in (("a", 10_000), ("b", 5000), ("c", 5000))}
    size = np.sqrt(sum(w * w for w in raw.values()))
    assert got[1] == pytest.approx({t: w / size for t, w in raw.items()}) and set(got[3].values()) == {1.0}
