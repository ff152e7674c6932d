"""Keywords of all categories found in one pass by an Aho-Corasick automaton, and reloaded when their file changes.

The automaton holds every term of every category, so a text is read once, however many terms there are.
A term counts where a word boundary stands at each of its ends that is a letter or digit.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.collections import highest_priority
from tidewell.operators.topics import PRIORITY
from tidewell.shipping import map_arrow


def _folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc")


class Keywords:
    """The terms of a vocabulary (category -> terms), compiled."""

    def __init__(self, vocabulary: dict[str, list[str]]):
        self.categories = [c for c, terms in vocabulary.items() if any(terms)]
        held: dict[str, tuple[int, bool, bool, set[int]]] = {}
        for k, category in enumerate(self.categories):
            for term in vocabulary[category]:
                if term:
                    low = _folded(term)
                    held.setdefault(low, (len(low), term[0].isalnum(), term[-1].isalnum(), set()))[3].add(k)
        self.automaton = ahocorasick.Automaton()
        for low, value in held.items():
            self.automaton.add_word(low, value)
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def found(self, text: str) -> list[str]:
        """Categories whose terms occur, in the vocabulary's order."""
        if self.empty or not text:
            return []
        low, hits = _folded(text), set()
        for last, (size, left, right, categories) in self.automaton.iter(low):
            if categories <= hits:
                continue
            first = last - size + 1
            if left and first and _in_word(text[first - 1]) or right and last + 1 < len(text) and _in_word(text[last + 1]):
                continue
            hits |= categories
            if len(hits) == len(self.categories):
                break
        return [self.categories[k] for k in sorted(hits)]


_compiled: dict[str, Keywords] = {}


def _keywords(spec: str) -> Keywords:
    """One compiled vocabulary a Python worker: a new version takes the old one's place."""
    if spec not in _compiled:
        _compiled.clear()
        _compiled[spec] = Keywords(json.loads(spec))
    return _compiled[spec]


def matched(items: DataFrame, text: Column, vocabulary: dict[str, list[str]], name: str = "topics") -> DataFrame:
    """``items`` with an array of the categories whose terms occur in ``text``; none for a null text."""
    spec = items.sparkSession.sparkContext.broadcast(json.dumps(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = _keywords(spec.value)
        for batch in batches:
            at = batch.num_columns - 1
            hits = pa.array([keywords.found(t) if t else [] for t in batch.column(at).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], hits], names=[*batch.schema.names[:at], name])

    rows = items.withColumn("__tw_text", text)
    schema = rows.drop("__tw_text").withColumn(name, F.array().cast("array<string>")).schema
    return map_arrow(rows, run, schema)


def learned(spark: SparkSession, path: str, categories: list[str] = PRIORITY) -> tuple[str, dict[str, list[str]]]:
    """Version (8 digits of the SHA-256) and terms of a keyword file: ``{"keywords": {category: [term or {"term": ...}]}}``.

    Categories of older vocabularies are left out. A file that is missing or broken gives no terms: the static ones go on alone.
    """
    try:
        body = spark.read.text(path, wholetext=True).first()[0]
        raw = json.loads(body).get("keywords", {})
    except Exception:
        return "", {}
    terms = {c: [t for e in raw[c] if (t := e if isinstance(e, str) else e.get("term")) and isinstance(t, str)] for c in raw if c in categories}
    return hashlib.sha256(body.encode()).hexdigest()[:8], terms


def merged(static: dict[str, list[str]], more: dict[str, list[str]]) -> dict[str, list[str]]:
    """Static terms, then learned ones, each once."""
    return {c: list(dict.fromkeys([*static.get(c, []), *more.get(c, [])])) for c in dict.fromkeys([*static, *more])}


def reloading(spark: SparkSession, path: str, static: dict[str, list[str]], write: Callable[[DataFrame, int, str], None], text: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds ``topic`` by the keyword file as it is when the batch begins, and its ``version``.

    A changed file takes effect in the next batch; a batch that is repeated after a failure reads the file again.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        version, terms = learned(spark, path)
        found = matched(batch, text(), merged(static, terms))
        write(found.withColumn("topic", highest_priority(F.col("topics"), PRIORITY)).drop("topics").withColumn("version", F.lit(version)), batch_id, version)

    return each
