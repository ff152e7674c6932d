"""Words of texts without spaces: a lexicon learned by counting, and the likeliest split by it.

A string of characters is a word if it holds together and is free outside. It holds together if it is much
more frequent than chance makes any two parts of it stand side by side (cohesion); it is free if many
different characters stand before and behind it (branching entropy). All of it is grouped sums over the strings of
up to MAX_CHARS characters of the corpus. A text is then split where the product of its words' shares is
largest (a unigram lattice, solved by Viterbi); characters outside the lexicon are words by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.lineage import cut
from tidewell.shipping import map_arrow

MAX_CHARS = 4
#: Least occurrences, least cohesion (a natural logarithm), least entropy on either side (nats); and the size of a lexicon, the most frequent words.
MIN_COUNT, MIN_COHESION, MIN_ENTROPY, LEXICON = 5, 1.5, 0.8, 50_000
#: Scripts without spaces: Chinese, kana, Hangul, Thai; letters alone.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\x{3005}\x{30FC}]+"
#: Characters that a task's numbers of strings know at once, nothing included: five of them fit 62 bits. Different strings that it holds before it hands them on.
_ALPHABET, _HELD = 5404, 2_000_000
#: Entries of a table of weights that is looked up directly.
_DIRECT = 1 << 22


def runs(text: Column, pattern: str = UNSPACED) -> Column:
    """Stretches of a text that the lexicon is for; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the MAX_CHARS + 1 characters from a place on, fewer at the end of a run, occur in a task's runs."""
    width, held, waiting = MAX_CHARS + 1, [], 0
    number, letters = np.zeros(0x110000, np.int64), [0]  # of each character, from 1 on; 0 is none

    def handed_on() -> Iterator[pa.RecordBatch]:
        keys, n = _merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        known = np.array(letters, np.uint32)
        for at in range(0, len(keys), 65_536):
            some = keys[at : at + 65_536]
            chars = np.stack([known[some // _ALPHABET**j % _ALPHABET] for j in range(width - 1, -1, -1)], axis=1)
            sizes = (chars > 0).sum(axis=1)
            whole, ends = chars[chars > 0].astype("<u4").tobytes().decode("utf-32-le"), np.cumsum(sizes).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]), pa.array(n[at : at + 65_536])], names=["gram", "n"])

    for batch in batches:
        texts = batch.column(0).flatten().to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes, ends = _codes(texts), np.repeat(np.cumsum(sizes), sizes)
        for at in range(0, len(codes), 1 << 20):
            steps = [(at, min(at + (1 << 20), len(codes)))]
            while steps:
                low, high = steps.pop()
                part = codes[low : high + width - 1]
                new = np.flatnonzero(np.bincount(part, minlength=1) > 0)
                new = new[number[new] == 0]
                if len(letters) + len(new) > _ALPHABET:
                    if held:
                        yield from handed_on()
                        held, waiting = [], 0
                    number[:], letters = 0, [0]
                    middle = (low + high) // 2
                    steps += [(low, high)] if high - low < _ALPHABET // 2 else [(middle, high), (low, middle)]
                    continue
                number[new] = np.arange(len(letters), len(letters) + len(new))
                letters += new.tolist()
                ranks, last = np.concatenate((number[part], np.zeros(width, np.int64))), ends[low:high] - np.arange(low, high)
                keys = np.zeros(high - low, np.int64)
                for j in range(width):
                    keys = keys * _ALPHABET + np.where(last > j, ranks[j : j + high - low], 0)
                keys.sort()
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                held.append((keys[first], np.diff(np.append(first, len(keys)))))
                waiting += len(first)
                if waiting > _HELD:
                    held = [_merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    waiting = len(held[0][0])
                    if waiting > _HELD // 2:
                        yield from handed_on()
                        held, waiting = [], 0
    if held:
        yield from handed_on()


def _entropy(grams: DataFrame, word: str, side: str) -> DataFrame:
    """Per word the sum over the characters on one side of c ln c. An end of a run is a character of its own: it adds 1 ln 1."""
    return grams.filter(F.char_length("word") > 2).groupBy(F.expr(word).alias("word")).agg(F.sum(F.col("n").cast("double") * F.log(F.col("n").cast("double"))).alias(side))


def learn(docs: DataFrame, text: str = "text", pattern: str = UNSPACED, min_count: int = MIN_COUNT, size: int = LEXICON) -> DataFrame:
    """``word``, ``n``, ``cohesion``, ``entropy``: the lexicon of a corpus, single characters included.

    Tasks count their own windows of MAX_CHARS + 1 characters; all shorter strings, and what stands beside them, are sums
    over different windows. Of equally frequent words at the end of the lexicon those that come first stay. An empty
    corpus gives an empty lexicon.
    """
    windows = map_arrow(docs.select(runs(F.col(text), pattern).alias("runs")), _windows, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("gram")), lambda k: F.substring("gram", F.lit(1), k))).alias("word")
    grams = cut(cut(windows).select(prefix, "n").groupBy("word").agg(F.sum("n").alias("n")))
    single = grams.filter(F.char_length("word") == 1)
    total = single.agg(F.sum("n")).first()[0] or 0
    every = grams.filter((F.char_length("word") == 1) | ((F.char_length("word") <= MAX_CHARS) & (F.col("n") >= min_count)))
    # of all ways to part a word in two, the one that chance explains best
    part = F.explode(F.sequence(F.lit(1), F.char_length("word") - 1))
    parts = every.filter(F.char_length("word") > 1).select("word", "n", part.alias("at")).select(
        "word", "n", F.expr("substring(word, 1, at)").alias("l"), F.expr("substring(word, at + 1)").alias("r")
    )
    left = every.select(F.col("word").alias("l"), F.col("n").alias("nl"))
    right = every.select(F.col("word").alias("r"), F.col("n").alias("nr"))
    cohesion = F.min(F.log(F.col("n").cast("double") * total / (F.col("nl").cast("double") * F.col("nr"))))
    held = parts.join(left, "l").join(right, "r").groupBy("word").agg(F.first("n").alias("n"), cohesion.alias("cohesion")).filter(F.col("cohesion") >= MIN_COHESION)
    before, after = _entropy(grams, "substring(word, 2)", "s_before"), _entropy(grams, "substring(word, 1, char_length(word) - 1)", "s_after")
    sides = held.join(before, "word", "left").join(after, "word", "left")
    entropy = F.least(*[F.log(F.col("n").cast("double")) - F.coalesce(c, F.lit(0.0)) / F.col("n").cast("double") for c in ("s_before", "s_after")])
    words = sides.select("word", "n", "cohesion", entropy.alias("entropy")).filter(F.col("entropy") >= MIN_ENTROPY)
    chars = single.select("word", "n", F.lit(0.0).alias("cohesion"), F.lit(0.0).alias("entropy"))
    return cut(chars.unionByName(words).orderBy(F.desc("n"), "word").limit(size))


def best_split(run: str, logs: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The split of a run with the largest sum of logs; of equal ones that whose last word is longest, and so on before it."""
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        score, start = -math.inf, end - 1
        for at in range(max(0, end - longest), end):
            word = run[at:end]
            weight = logs.get(word, unknown if end - at == 1 else -math.inf)
            if best[at] + weight > score:
                score, start = best[at] + weight, at
        best.append(score)
        back.append(start)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


class Splitter:
    """:func:`best_split` of many runs, with the same sums: the weights of all strings that end at a place are looked up at once."""

    def __init__(self, logs: dict[str, float], unknown: float, longest: int) -> None:
        self.logs, self.unknown, self.longest = logs, unknown, longest
        letters = np.unique(_codes(list(logs)))
        self.number, self.base = np.zeros(0x110000, np.int64), len(letters) + 1
        self.number[letters] = np.arange(1, self.base)
        self.packed = longest <= MAX_CHARS and self.base**MAX_CHARS < 1 << 62
        self.tables = [self._table([w for w in logs if len(w) == k], k) for k in range(1, MAX_CHARS + 1)] if self.packed else []

    def _keys(self, ranks: np.ndarray, k: int) -> np.ndarray:
        """The number of the ``k`` characters up to each place, but for the first ones."""
        keys = np.zeros(len(ranks) - k + 1, np.int64)
        for j in range(k):
            keys = keys * self.base + ranks[j : len(ranks) - k + 1 + j]
        return keys

    def _table(self, words: list[str], k: int) -> tuple[np.ndarray | None, np.ndarray]:
        keys = np.array([int(self._keys(self.number[_codes([w])], k)[0]) for w in words], np.int64)
        order, least = np.argsort(keys), self.unknown if k == 1 else -math.inf
        values = np.array([self.logs[w] for w in words])[order]
        if self.base**k > _DIRECT:
            return np.append(keys[order], np.iinfo(np.int64).max), np.append(values, least)
        table = np.full(self.base**k, least)
        table[keys[order]] = values
        return None, table

    def _weights(self, ranks: np.ndarray, k: int) -> list[float]:
        if len(ranks) < k:
            return [-math.inf] * len(ranks)
        keys, (known, values) = self._keys(ranks, k), self.tables[k - 1]
        if known is None:
            found = values[keys]
        else:
            at = np.searchsorted(known, keys)
            found = np.where(known[at] == keys, values[at], values[-1])
        return [-math.inf] * (k - 1) + found.tolist()

    def __call__(self, parts: list[str]) -> list[list[str]]:
        return [self._split(x) if self.packed else best_split(x, self.logs, self.unknown, self.longest) for x in parts]

    def _split(self, text: str) -> list[str]:
        ranks = self.number[_codes([text])]
        one, two, three, four, back = 0.0, -math.inf, -math.inf, -math.inf, []  # the best sums up to one to four characters before
        for a, b, c, d in zip(*[self._weights(ranks, k) for k in range(1, MAX_CHARS + 1)], strict=True):
            score, size = four + d, 4
            if (x := three + c) > score:
                score, size = x, 3
            if (x := two + b) > score:
                score, size = x, 2
            if (x := one + a) > score:
                score, size = x, 1
            one, two, three, four = score, one, two, three
            back.append(size)
        out, end = [], len(text)
        while end:
            out.append(text[end - back[end - 1] : end])
            end -= back[end - 1]
        return out[::-1]


def segmented(items: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "id", pattern: str = UNSPACED) -> DataFrame:
    """``key``, ``words``: the words of a text's runs, in order. The lexicon, of a bounded size, goes to every task.

    A null text has none.
    """
    rows = {r["word"]: r["n"] for r in lexicon.select("word", "n").collect()}
    total = float(sum(rows.values())) or 1.0
    unknown = math.log(0.5 / total)
    longest = max(map(len, rows), default=1)
    shared = items.sparkSession.sparkContext.broadcast({w: math.log(n / total) for w, n in rows.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(shared.value, unknown, longest)
        for batch in batches:
            words = [[w for part in split(parts) for w in part] for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=[key, "words"])

    return map_arrow(items.select(key, runs(F.col(text), pattern).alias("runs")), run, f"{key} {dict(items.dtypes)[key]}, words array<string>")


def entities(words: Column, stop: list[str] | None = None) -> Column:
    """Words of two characters or more, once each, as entities of a title."""
    found = F.filter(F.array_distinct(words), lambda w: F.char_length(w) >= 2)
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found
