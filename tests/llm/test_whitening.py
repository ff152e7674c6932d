"""Whitening against a dense eigensolver, and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import whitening


def dense(rows):
    """Grid vectors by id, their distinct list, and its covariance."""
    x = {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, v in rows}
    fit = np.array(sorted(set(x.values())), np.int64)
    centred = fit - fit.sum(0) / len(fit)
    return x, fit, centred.T @ centred / len(fit)


def held_against_dense(got, rows, wanted):
    x, fit, v = dense(rows)
    e, q = np.linalg.eigh(v)
    e, q, sums = e[::-1], q[:, ::-1], fit.sum(0)
    by = {(r.vec_id, r.component): r for r in got}
    for i, vector in x.items():
        exact = sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(vector, sums, strict=True))
        for k in range(1, wanted + 1):
            r = by[i, k]
            assert (r.n, r.deviation) == (len(fit), exact)
            assert r.explained == pytest.approx(e[k - 1] / np.trace(v), rel=1e-9)
            assert r.identity_error < 1e-9
    for k in range(wanted):
        ours = np.array([by[i, k + 1].whitened for i in x])
        theirs = (np.array(list(x.values())) - sums / len(fit)) @ q[:, k] / math.sqrt(e[k])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-7


def test_equals_dense_eigensolver(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.whiten(vectors).collect()
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert len(got) == 16 * len(rows)
    held_against_dense(got, rows, 16)


def test_iterates_where_the_block_does_not_span_the_space(spark):
    r = np.random.default_rng(3)
    scale = 0.93 ** np.arange(150)
    rows = [(i, [float(c) for c in r.standard_normal(150) * scale * 3]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit = whitening.fit_list(whitening.gridded(vectors))
    found = whitening.components(fit, 5)
    assert found.rounds > 3 and found.residual <= whitening.TOLERANCE
    held_against_dense(whitening.whiten(vectors, 5).collect(), rows, 5)


def test_odd_vectors_have_defined_results(spark):
    sound = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)] + [(None, [0.5, 0.25, -1.0]), (3, [9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0])]
    broken = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [math.nan, 1.0, 1.0]), (104, [math.inf, 1.0, 1.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    vectors = spark.createDataFrame(sound + broken, schema)
    got = whitening.whiten(vectors).collect()
    assert len(got) == 3 * len(sound) and {r.component for r in got} == {1, 2, 3}
    assert {r.n for r in got} == {17}  # repeats count once
    assert sum(r.vec_id is None for r in got) == 3 and not any(r.vec_id is not None and r.vec_id >= 100 for r in got)
    extra = vectors.withColumns({"n": F.lit("clash"), "x": F.lit("clash"), "component": F.lit(0)})
    key = lambda r: (str(r.vec_id), r.component, r.deviation)
    assert sorted(map(key, whitening.whiten(extra).collect())) == sorted(map(key, got))
    for few in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).count() == 0


def test_a_flat_direction_has_no_component(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)


def test_deviations_do_not_wrap():
    x, n = np.array([[2**40, 1]], np.int64), 2**20
    assert whitening._deviations(np.array([[5, 7]], np.int64), 3, np.array([15, 20], dtype=object)) == [1]
    with pytest.raises(OverflowError):
        whitening._deviations(x, n, np.array([0, 0], dtype=object))
