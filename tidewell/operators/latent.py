"""Text vectors by a randomised singular value decomposition of the weighted term matrix.

Texts are rows of term weights: (1 + ln count) times the term's inverse document frequency, at length 1. A block of random directions
over the terms is multiplied by the matrix and its transpose a few times, orthonormal in between; every product is one pass in
which tasks handle their own texts, and Spark adds up what they give each term. The driver holds terms x directions, whatever the corpus.
A text's terms are counted in the task that reads it; no term of a text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.lineage import cut
from tidewell.shipping import map_arrow

#: Terms in the model, those in most texts; dimensions of a vector; directions beside them; passes.
TERMS, DIMENSIONS, SPARE, PASSES = 20_000, 32, 8, 4
#: Terms in fewer texts than this say little.
MIN_TEXTS = 2


def term_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def vocabulary(docs: DataFrame, text: str = "text", size: int = TERMS) -> DataFrame:
    """``term``, ``t`` (its number), ``idf``. Of equally frequent terms at the end those that come first stay."""
    n = docs.count()
    each = docs.select(F.explode(F.array_distinct(term_words(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = each.filter(F.col("df") >= MIN_TEXTS).orderBy(F.desc("df"), "term").limit(size).collect()
    held = [(r["term"], k, float(np.log((1 + n) / (1 + r["df"])) + 1)) for k, r in enumerate(rows)]
    return docs.sparkSession.createDataFrame(held, "term string, t int, idf double")


def _offsets(rows: np.ndarray, n: int) -> pa.Array:
    """Where each of ``n`` lists begins, whose items' rows are given in order."""
    return pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32))


def weighted(docs: DataFrame, terms: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """``key``, ``ts``, ``ws``: the numbers and weights of a text's known terms, at length 1; empty where it has none. The vocabulary is broadcast."""
    held = terms.select("term", "idf", "t").toArrow().sort_by("t")
    shared = docs.sparkSession.sparkContext.broadcast((held["term"].combine_chunks(), held["idf"].to_numpy()))
    schema = f"{key} {dict(docs.dtypes)[key]}, ts array<int>, ws array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        for batch in batches:
            words = batch.column(1)
            t = pc.index_in(words.flatten(), value_set=known)
            row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))[t.is_valid().to_numpy(zero_copy_only=False)]
            pairs, n = np.unique(row * max(1, len(known)) + t.drop_null().to_numpy(), return_counts=True)
            row, t = np.divmod(pairs, max(1, len(known)))
            w = (1 + np.log(n)) * idf[t]
            w /= np.sqrt(np.bincount(row, w * w, len(words)))[row]
            at = _offsets(row, len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(t.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(w))], names=[key, "ts", "ws"])

    return map_arrow(docs.select(key, term_words(F.col(text)).alias("__words")), run, schema)


def _entries(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each row's place, terms and weights. A row has a term once."""
    lists = batch.column(at)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    t, w = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(at + 1).flatten().to_numpy(zero_copy_only=False)
    for row, (first, end) in enumerate(zip([0, *ends], ends, strict=False)):
        yield row, t[first:end], w[first:end]


def _squared(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix's transpose times the matrix times the block, in one pass."""
    shared, names = rows.sparkSession.sparkContext.broadcast(block), [f"c{j}" for j in range(block.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            total = np.zeros_like(shared.value) if total is None else total
            for _, t, w in _entries(batch, 0):
                total[t] += w[:, None] * (w @ shared.value.take(t, axis=0))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], names=["t", *names])

    parts = map_arrow(rows.select("ts", "ws"), run, "t int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("t").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("t")
    shared.destroy()  # a pass has a block of its own
    return np.column_stack([sums[c].to_numpy() for c in names])


@dataclass(frozen=True)
class Model:
    terms: DataFrame
    directions: np.ndarray  # terms x dimensions, orthonormal, by falling singular value
    singular: np.ndarray


def fit(docs: DataFrame, text: str = "text", key: str = "id", dimensions: int = DIMENSIONS, size: int = TERMS, seed: int = 5) -> tuple[Model, DataFrame]:
    """A model of a corpus, and its weighted rows, written. An empty corpus has no dimensions."""
    terms = vocabulary(docs, text, size)
    rows = cut(weighted(docs, terms, text, key))
    n = terms.count()
    m = min(n, dimensions + SPARE)
    if not m:
        return Model(terms, np.zeros((0, 0)), np.zeros(0)), rows
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, m)))[0]
    for _ in range(PASSES):
        block = np.linalg.qr(_squared(rows, block))[0]
    values, c = np.linalg.eigh(block.T @ _squared(rows, block))
    order = np.argsort(values)[::-1][:dimensions]
    order = order[values[order] > 1e-10 * max(values.max(), 1e-300)]
    return Model(terms, block @ c[:, order], np.sqrt(values[order])), rows


def vectors(rows: DataFrame, model: Model, key: str = "id") -> DataFrame:
    """``key``, ``embedding``: a text on the model's directions, at length 1; null where nothing of it is left."""
    shared = rows.sparkSession.sparkContext.broadcast(model.directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.zeros((batch.num_rows, shared.value.shape[1]))
            for row, t, w in _entries(batch, 1) if shared.value.size else ():
                y[row] = w @ shared.value.take(t, axis=0)
            size = np.linalg.norm(y, axis=1)
            held = np.flatnonzero(size >= 1e-12)
            at = _offsets(np.repeat(held, y.shape[1]), len(y))
            made = pa.ListArray.from_arrays(at, pa.array((y[held] / size[held, None]).ravel()), mask=pa.array(size < 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=[key, "embedding"])

    return map_arrow(rows.select(key, "ts", "ws"), run, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>")
