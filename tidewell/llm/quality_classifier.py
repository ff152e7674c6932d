"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Words enter as themselves and as their shapes (runs of letters, capitals and digits become one
sign each, other characters stay; a word equal to the one before it has a shape of its own).
N-grams of either are hashed to 2**BITS weights; a family's n-grams count as shares, so
that long and short texts compare, and a score is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, map_arrow

BITS = 18
#: Labelled documents that are fitted, in expectation: all, or a seeded sample of this many.
TRAIN_ROWS = 8192
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.5, 0.2, 2e-4, 1e-4
#: Family: (n-gram length, of shapes)
FAMILIES = ((1, True), (2, True), (3, True), (1, False), (2, False))
SCALE = 8.0
_MAX_WORDS = 400_000
_SIGNS = re.compile(r"[^\W\d_]+|\d+")


def shape(word: str) -> str:
    def sign(m: re.Match) -> str:
        run = m.group()
        return "0" if run[0].isdigit() else "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "B" if run[0].isupper() else "c"

    return _SIGNS.sub(sign, word)


class _Hashes(dict):
    def __init__(self, shapes: bool):
        super().__init__()
        self.shapes = shapes

    def __missing__(self, word: str) -> int:
        value = zlib.crc32((("s " + shape(word)) if self.shapes else ("w " + word)).encode())
        if len(word) <= 100:  # longer ones are hashed anew each time
            if len(self) >= _MAX_WORDS:
                self.clear()
            self[word] = value
        return value


_words, _shapes = _Hashes(False), _Hashes(True)
_REPEAT = np.uint64(zlib.crc32(b"s repeat"))


def ngrams(text: str) -> list[np.ndarray]:
    """Hashed n-grams (uint32 below 2**BITS) of each family; empty arrays for short texts."""
    words = text.split()
    n = len(words)
    surface = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    shapes = np.fromiter(map(_shapes.__getitem__, words), np.uint64, n)
    if n > 1:
        shapes[1:][surface[1:] == surface[:-1]] = _REPEAT
    out = []
    for k, (size, of_shapes) in enumerate(FAMILIES):
        base = shapes if of_shapes else surface
        if n < size:
            out.append(np.empty(0, np.uint32))
            continue
        h = base[: n - size + 1] + np.uint64(k + 1)
        for j in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + base[j : n - size + 1 + j]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(64 - BITS)).astype(np.uint32))
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the n-grams of a text."""
    ids, values = [], []
    for found in ngrams(text):
        if len(found):
            u, n = np.unique(found, return_counts=True)
            ids.append(u)
            values.append(n * (SCALE / len(found)))
    if not ids:
        return np.empty(0, np.uint32), np.empty(0)
    return np.concatenate(ids), np.concatenate(values)


def score(text: str, weights: np.ndarray) -> float:
    """``weights``: 2**BITS weights and the bias."""
    z = weights[-1] + sum(SCALE * float(weights[found].mean()) for found in ngrams(text) if len(found))
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over the rows in their order, ``epochs`` times; returns dense weights."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS], np.uint32)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for ids, values, label in rows:
            i, x = np.concatenate([ids, bias]), np.concatenate([values, [1.0]])
            # families share the index space: fold equal indices
            i, back = np.unique(i, return_inverse=True)
            x = np.bincount(back, x)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(slice(None))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Weights fitted on labelled documents whose crc32(doc_id) mod 3 is not 1.

    ``rows`` bounds the number of fitted documents (in expectation; drawn by a seeded hash of the id).
    Their ids, at most that many, are broadcast; their features, computed where the texts are, go to
    one task, which fits and returns the weights that are not zero. Labels that are null are
    left out; a document labelled twice counts with its lower label.
    """
    usable = labels.filter("doc_id is not null and quality is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    usable = cut(usable.groupBy(F.col("doc_id").alias("__tw_id")).agg(F.min("quality").cast("int").alias("__tw_label")))
    n = usable.count()
    chance = min(1.0, rows / n) if n else 0.0
    chosen = usable.withColumn("__tw_order", F.xxhash64(F.lit(5), "__tw_id")).filter(
        F.shiftrightunsigned("__tw_order", 11).cast("double") * 2.0**-53 < chance
    )
    texts = docs.select(F.col(key).alias("__tw_id"), F.col(text).alias("__tw_text"))
    joined = texts.join(F.broadcast(chosen), "__tw_id").select("__tw_order", "__tw_label", "__tw_text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column(2)]
            ids = pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32()))
            values = pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, values], names=["o", "label", "ids", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for k in range(batch.num_rows):
                ids, values = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in (2, 3))
                rows.append((ids.astype(np.uint32), values, batch.column(1)[k].as_py()))
        w = fit(rows) if rows else np.zeros(0)
        at = np.nonzero(w)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], names=["i", "w"])

    found = map_arrow(joined, featurise, "o long, label int, ids array<int>, values array<float>")
    fitted = map_arrow(found.repartition(1).sortWithinPartitions("o", "label"), learn, "i int, w double")
    weights = np.zeros((1 << BITS) + 1)
    for i, w in fitted.collect():  # at most 2**BITS + 1 weights
        weights[i] = w
    return weights


def classify(docs: DataFrame, weights: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row's whole text.

    Null and empty texts have no n-grams; the bias alone scores them. Without training rows all
    weights are 0 and scores 0.5. A null doc_id counts as the empty string for ``held_out``.
    Repeated rows give repeated results; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            scores = [score(t.as_py() or "", w) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    return scored.select("doc_id", (remainder == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
