"""Language detection by character trigrams: a multinomial Bayes model that Spark counts and scores.

A text's letters, in lower case and with a blank at the ends of its words, give overlapping trigrams. The model has a row a
trigram, with the logarithm of its probability in every language (additively smoothed). A text's score in a language is the sum over
its trigrams and the logarithm of the language's share; both are grouped sums of what tasks add up over their own
texts, so that trigrams are not rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.lineage import cut
from tidewell.shipping import map_arrow

#: Trigrams in the model, the most frequent ones: its size, whatever the corpus. And languages, the most frequent ones.
VOCABULARY, LANGUAGES = 50_000, 200
SMOOTHING = 0.5
#: Different trigrams of a language that a task holds before it hands them on; entries of a table that is looked up directly.
_HELD, _DIRECT = 1_000_000, 1 << 22
#: Three characters from every place on, none begun inside a surrogate pair.
_TRIGRAM = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(...))"


def _spelled(text: Column) -> Column:
    """A text's letters in lower case with a blank at the ends of its words; empty where it has none."""
    letters = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " "))
    return F.when(letters != "", F.concat(F.lit(" "), letters, F.lit(" "))).otherwise("")


def trigrams(text: Column) -> Column:
    """All trigrams of a text, in order; a null text has none."""
    return F.regexp_extract_all(_spelled(text), F.lit(_TRIGRAM), F.lit(1))


def _packed(codes: np.ndarray) -> np.ndarray:
    """Every three characters on end as a number; two places fewer than there are characters."""
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of texts, packed, and the place of each one's text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(codes) < 3:
        return codes[:0], codes[:0]
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = row[:-2] == row[2:]
    return _packed(codes)[inside], row[:-2][inside]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each trigram occurs in a task's texts of a language."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n[order], first)

    def handed_on(lang: str) -> Iterator[pa.RecordBatch]:
        keys, n = merged(lang)
        chars = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([chars[i : i + 3] for i in range(0, len(chars), 3)]), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        texts = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts[lang].append(text)
        for lang, some in texts.items():
            keys = np.sort(_read(some)[0])
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            held[lang].append((keys[first], np.diff(np.append(first, len(keys)))))
            if sum(len(k) for k, _ in held[lang]) > _HELD:
                held[lang] = [merged(lang)]
                if len(held[lang][0][0]) > _HELD // 2:
                    yield from handed_on(lang)
                    del held[lang]
    for lang in held:
        yield from handed_on(lang)


class _Weights:
    """The model's row of packed trigrams, the last row for those that it lacks."""

    def __init__(self, grams: list[str]) -> None:
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.int64)
        letters = np.unique(codes)
        self.base, self.number, self.n = len(letters) + 1, np.zeros(0x110000, np.int64), len(grams)
        self.number[letters] = np.arange(1, self.base)
        keys = _packed(codes)[::3] if len(codes) else codes
        self.direct = self.base**3 <= _DIRECT
        if self.direct:
            self.table = np.full(self.base**3, self.n, np.int32)
            self.table[self._small(keys)] = np.arange(self.n)
        else:
            self.order = np.argsort(keys)
            self.keys = keys[self.order]

    def _small(self, keys: np.ndarray) -> np.ndarray:
        return (self.number[keys >> 42] * self.base + self.number[keys >> 21 & 0x1FFFFF]) * self.base + self.number[keys & 0x1FFFFF]

    def rows(self, keys: np.ndarray) -> np.ndarray:
        if self.direct:
            return self.table[self._small(keys)]
        at = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
        return np.where(self.keys[at] == keys, self.order[at], self.n)


@dataclass(frozen=True)
class Model:
    """``languages`` in order of their codes, their log shares, and ``weights``: ``gram``, ``logs`` (one a language)."""

    languages: list[str]
    priors: list[float]
    weights: DataFrame


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: int = VOCABULARY) -> Model:
    """A model from texts with known languages; rows without a language are left out.

    Trigrams are counted in their tasks before they are shuffled. Of equally frequent ones at the end of the vocabulary
    those that come first stay.
    """
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    shares = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).orderBy("lang").collect()
    languages, total = [r["lang"] for r in shares], sum(r["n"] for r in shares)
    counted = map_arrow(known.select("lang", _spelled(F.col("text")).alias("text")), _counted, "lang string, gram string, n long")
    counts = cut(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    per_gram = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(languages)], F.sum("n").alias("n"))
    chosen = cut(per_gram.orderBy(F.desc("n"), "gram").limit(vocabulary))
    sums = chosen.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(languages))]).first()
    smooth = [F.log((F.col(f"n{k}") + SMOOTHING) / ((sums[f"n{k}"] or 0) + SMOOTHING * sums["v"])) for k in range(len(languages))] if sums["v"] else []
    weights = chosen.select("gram", F.array(*smooth).cast("array<double>").alias("logs"))
    priors = [float(x) for x in chosen.sparkSession.range(1).select(*[F.log(F.lit(r["n"] / total)) for r in shares]).first()] if shares else []
    return Model(languages, priors, weights)


def detected(items: DataFrame, model: Model, text: Column, key: str = "id") -> DataFrame:
    """``key``, ``detected``, ``margin``: the likeliest language (the first code of equals) and how far its score is ahead, a trigram.

    Rows without a known trigram are absent, for the caller's fallback. Rows with one key are one text. The model, of a bounded
    size, is broadcast.
    """
    n, kind = len(model.languages), dict(items.select(key).dtypes)[key]
    if not n:
        return items.limit(0).select(key, F.lit("").alias("detected"), F.lit(0.0).alias("margin"))
    held, names = model.weights.select("gram", "logs").collect(), [f"s{k}" for k in range(n)]
    logs = np.array([r["logs"] for r in held]).reshape(-1, n)
    shared = items.sparkSession.sparkContext.broadcast(([r["gram"] for r in held], np.vstack([logs, np.zeros((1, n))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logs = shared.value
        weights = _Weights(grams)
        for batch in batches:
            keys, row = _read(batch.column(1).to_pylist())
            found = weights.rows(keys) if grams else np.zeros(len(keys), np.int64)
            row, found = row[found < len(grams)], found[found < len(grams)]
            sums = [np.bincount(row, logs[found, k], batch.num_rows) for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=batch.num_rows)), *map(pa.array, sums)], names=[key, "n", *names])

    own = map_arrow(items.select(key, _spelled(text).alias("__text")), run, f"{key} {kind}, n long, " + ", ".join(f"{c} double" for c in names))
    sums = own.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).filter("n > 0")
    scores = F.array(*[F.struct((F.col(f"s{k}") + model.priors[k]).alias("score"), F.lit(-k).alias("order")) for k in range(n)])
    ranked = sums.select(key, "n", F.sort_array(scores, asc=False).alias("r"))
    code = F.element_at(F.array(*[F.lit(x) for x in model.languages]), 1 - F.col("r")[0]["order"])
    ahead = (F.col("r")[0]["score"] - F.get(F.col("r"), F.lit(1))["score"]) / F.col("n")
    return ranked.select(key, code.alias("detected"), ahead.alias("margin"))
