"""Repeated passages by content-defined chunking with a gear rolling hash.

A gear hash rolls over the bytes of a text; its value at the end of a word depends on the last
16 bytes alone. A word ends a chunk if its value is the least among the words up to REACH away
on either side, so boundaries are set by nearby content and shift along with it when text
is inserted or removed elsewhere. In words longer than LONG_WORD bytes (scripts without spaces, lines of data)
the hash itself sets ends, one in PART code points, and the parts count as words. Chunks are compared by 128-bit
digests over all documents. Chunks in a row that occur elsewhere, too, form a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, join_grouped, map_arrow, small

#: Words on either side among which a boundary has the least hash; chunks have REACH + 1 words
#: or more (the first and last of a text may have less), about 2 * REACH + 1 on average.
REACH = 3
#: A passage of 50 words holds whole chunks of about 34 words; half of it leaves a margin.
MIN_WORDS = 16
#: Words with more bytes than this are parted behind one in PART code points.
LONG_WORD, PART = 64, 8
_ROLL = 16  # bytes that the hash depends on
_NONE = np.uint32(0xFFFFFFFF)


def _gear() -> np.ndarray:
    """256 pseudo-random numbers, by the splitmix64 rule from 1 on."""
    z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + gear[byte], over the last 16 bytes.

    Sums over 2, 4, 8 and 16 bytes are made from two sums over half as many."""
    h, width = _GEAR[data], 1
    while width < _ROLL:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_words(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word ends a chunk; ``doc`` is the number of its text, ascending."""
    n = len(hashes)
    ends = hashes != _NONE
    for step in range(1, min(REACH, n - 1) + 1):
        same = doc[step:] == doc[:-step]
        # equal values are ends alike, so that words which repeat periodically are parted evenly
        ends[step:] &= ~same | (hashes[step:] <= hashes[:-step])
        ends[:-step] &= ~same | (hashes[:-step] <= hashes[step:])
    if n:
        ends[-1] = True
        ends[:-1] |= doc[1:] != doc[:-1]
    return ends


def _parted(data: np.ndarray, rolled: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last bytes of words, with long words parted at ends of code points that the hash chooses."""
    long = last - first >= LONG_WORD
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, first[long], 1)
    np.add.at(inside, last[long], -1)
    end_of_point = np.concatenate([(data[1:] & 0xC0) != 0x80, [True]])
    at = np.nonzero((np.cumsum(inside[:-1]) > 0) & (rolled < np.uint32(2**32 // PART)) & end_of_point)[0]
    return np.sort(np.concatenate([first, at + 1])), np.sort(np.concatenate([last, at]))


def chunk_batch(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Chunks of texts that lie one after the other in ``data`` (UTF-8 bytes): number of the
    text, number in it, start and end (code points), words, digest (in two halves)."""
    empty = {k: np.empty(0, np.int64) for k in ("doc", "idx", "start", "end", "words", "high", "low")}
    if not len(data):
        return empty
    space = _IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])
    stops = ~space & (np.concatenate([space[1:], [True]]) | edge[1:])
    first, last = np.nonzero(begins)[0], np.nonzero(stops)[0]
    if not len(first):
        return empty
    rolled = gear_hashes(data)
    if (last - first >= LONG_WORD).any():
        first, last = _parted(data, rolled, first, last)
    doc = np.searchsorted(offsets, first, side="right") - 1
    h = rolled[last]
    h[last - offsets[doc] < _ROLL - 1] = _NONE  # bytes of the text before would count
    ends = chunk_words(h, doc)
    stop = np.nonzero(ends)[0]
    start = np.concatenate([[0], stop[:-1] + 1])
    a, b, of = first[start], last[stop] + 1, doc[start]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[offsets[of]]
    view = memoryview(data)
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), ">i8").astype(np.int64)
    fresh = np.concatenate([[True], of[1:] != of[:-1]])
    at = np.arange(len(of))
    return {
        "doc": of, "idx": at - np.maximum.accumulate(np.where(fresh, at, 0)), "start": points[a] - base, "end": points[b] - base,
        "words": stop - start + 1, "high": digest[::2], "low": digest[1::2],
    }


def chunks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``idx``, ``start``, ``end`` (code points), ``words``, ``high``, ``low`` (digest) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            _, offsets, values = texts.buffers()
            bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.empty(0, np.uint8)
            found = chunk_batch(data, bounds - bounds[0])
            columns = [pa.array(ids[found["doc"]], pa.int64())]
            columns += [pa.array(found[k].astype(np.int32), pa.int32()) for k in ("idx", "start", "end", "words")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found["high"]), pa.array(found["low"])], names=["doc_id", "idx", "start", "end", "words", "high", "low"])

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_arrow(rows, run, "doc_id long, idx int, start int, end int, words int, high long, low long")


def _shared_chunks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Chunks that occur twice or more, with ``first`` (the smallest doc_id and idx that hold it), ``last`` (doc_id), ``held``.

    Chunks are computed twice, for the counts, which are pre-aggregated before the shuffle, and for the
    join with them: written out in between they would take more disk than both shuffles. Chunks with very many
    copies are joined in parts.
    """
    found = chunks(docs, text, key).withColumn("digest", F.struct("high", "low")).drop("high", "low")
    counts = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("held"))
    shared = cut(counts.filter("held > 1"))
    total = shared.agg(F.sum("held")).first()[0] or 0
    return join_grouped(found, shared, "digest", "held", total)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id", within: bool = False) -> DataFrame:
    """One row per passage that occurs in other documents as well.

    ``doc_id``, ``start``, ``end`` (code points, exclusive), ``n_words``, ``first_doc_id`` (the
    smallest doc_id among the holders of its chunks), ``copies`` (occurrences of its most frequent
    chunk), ``removable`` (words of chunks that a document with a smaller doc_id holds, too: cutting those
    everywhere leaves each chunk once).

    A passage is a longest run of chunks that occur in two documents or more (``within``: or twice in one), with at
    least ``min_words`` words. Documents without one give no row. Null and empty texts have no
    chunks; rows with a null doc_id are left out; rows with the same doc_id are one document, whose
    passages join those of all its rows (their words add up). An empty table gives an empty result.
    """
    shared = _shared_chunks(docs, text, key)
    if not within:
        shared = shared.filter("first <> last")
    run = F.col("idx") - F.dense_rank().over(Window.partitionBy("doc_id").orderBy("idx"))
    passages = shared.withColumn("run", run).groupBy("doc_id", "run")
    rows = passages.agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"),
        F.sum("words").alias("n_words"), F.min("first").alias("first_doc_id"), F.max("held").alias("copies"),
        F.sum(F.when(F.col("first") < F.col("doc_id"), F.col("words")).otherwise(0)).alias("removable"),
    )
    return rows.filter(F.col("n_words") >= min_words).drop("run")


def removable_spans(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``spans``: arrays of (start, end) in code points, ascending, that repeat what an earlier place holds.

    Earlier is a smaller doc_id, or the same and an earlier place. A span is a longest run of chunks of which each has
    an earlier copy, with at least ``min_words`` words; cutting all spans leaves every passage once.
    """
    # within the first document, a chunk's first place there counts; elsewhere all places are later ones
    shared = _shared_chunks(docs, text, key)
    place = Window.partitionBy("doc_id", "digest").orderBy("idx")
    marked = shared.withColumn("nth", F.row_number().over(place)).filter((F.col("first") < F.col("doc_id")) | (F.col("nth") > 1))
    run = F.col("idx") - F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    spans = marked.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n"))
    return spans.filter(F.col("n") >= min_words).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with :func:`removable_spans` cut from their texts; all rows and columns stay.

    Rows with a null or repeated doc_id stay as they are, as spans could not be told apart; their texts are
    not counted as earlier copies. Null texts stay null. A column ``n_chars`` follows the new text. An empty table stays empty.
    """
    once = cut(docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("__tw_id")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("__tw_id"))
    own = docs.join(once, docs[key] == once["__tw_id"], "left_semi")
    spans = small(cut(removable_spans(own, min_words, text, key).select(F.col("doc_id").alias("__tw_id"), F.col("spans").alias("__tw_spans"))))
    named = docs.select("*", F.col(key).cast("long").alias("__tw_id")).join(spans, "__tw_id", "left").select(*docs.columns, "__tw_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, last = batch.schema.get_field_index(text), batch.num_columns - 1
            new = []
            for value, found in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                new.append(value if value is None or not found else without(value, [(x["start"], x["end"]) for x in found]))
            out = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield pa.RecordBatch.from_arrays(out.columns[:last], schema=pa.schema([out.schema.field(k) for k in range(last)]))

    out = map_arrow(named, run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans, which are in order and apart."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])
