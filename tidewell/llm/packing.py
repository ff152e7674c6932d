"""Best-fit packing of documents into sequences, with conflicts.

Documents become pieces of at most a sequence's capacity. Pieces are dealt into groups of a bounded
number of rows in expectation, by a seeded hash, and a group is packed in one task: longest pieces
first, each into the open sequence (bin) with the least room that still takes it and does not
conflict. Bins are ordered by their room; the search starts at the first one with enough room
and goes on to its successors until a compatible bin is found. A bin carries bitmaps of the sources
and the duplicate clusters it holds: pieces of one cluster never share a bin, and a bin takes at most
``per_source`` pieces of one source as long as another bin has room. Where all bins with room are
full of the source, the tightest of them that lacks the cluster is taken; a new bin is opened only if there
is none. So a hot source is spread over the bins as far as it goes and costs no room.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, cut, ship

CAPACITY = 2048
PER_SOURCE = 3
GROUP_ROWS = 4096


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the given order. Sources and clusters are dense numbers."""
    room: list[tuple[int, int]] = []  # (room, bin) of open bins, ascending
    planes: list[list[int]] = []  # of a bin: bit s of plane k is set once it holds more than k pieces of source s
    copies: list[int] = []  # of a bin: bit c is set if it holds a piece of cluster c
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        at = chosen = bisect_left(room, (length, -1))
        while at < len(room):
            b = room[at][1]
            if not copies[b] & cluster_bit:
                if not planes[b][-1] & source_bit:
                    break
                if copies[room[chosen][1]] & cluster_bit:
                    chosen = at  # the first bin without the cluster
            at += 1
        if at < len(room):
            chosen = at
        if chosen < len(room) and not copies[room[chosen][1]] & cluster_bit:
            left, b = room.pop(chosen)
        else:
            left, b = capacity, len(planes)
            planes.append([0] * per_source)
            copies.append(0)
        bins.append(b)
        offsets.append(capacity - left)
        copies[b] |= cluster_bit
        plane = next((k for k in range(per_source) if not planes[b][k] & source_bit), per_source - 1)
        planes[b][plane] |= source_bit
        if left > length:
            insort(room, (left - length, b))
    return bins, offsets


def pieces(docs: DataFrame, capacity: int, length: Column | None, text: str, key: str, source: str) -> DataFrame:
    """One row per piece: ``doc_id``, ``source``, ``cluster``, ``piece``, ``start``, ``n_tokens``."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.coalesce(length, F.lit(0)) if length is not None else F.regexp_count(t, F.lit(WORD))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.xxhash64(t).alias("cluster"),
        (n.cast("long") + 1).alias("__tw_n"),  # a document ends with a separator
    )
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__tw_n") - 1) / capacity).cast("long"))
    return rows.select("doc_id", "source", "cluster", "__tw_n", F.explode(cuts).alias("piece")).select(
        "doc_id", "source", "cluster", "piece",
        (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("__tw_n") - F.col("piece") * capacity).alias("n_tokens"),
    )


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS, seed: int = 41,
    length: Column | None = None, text: str = "text", key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """``doc_id``, ``source``, ``cluster``, ``piece``, ``start``, ``n_tokens``, ``bin_id``, ``offset``.

    One row per piece of every document; pieces of a document cover it whole, each within
    ``capacity``. ``n_tokens`` counts words plus one separator at a document's end (or ``length``, a
    column of token counts, plus the separator). Equal texts are a cluster. Pieces as long as a
    sequence are bins of their own. Null and empty texts have one piece of one token. A null source and
    an empty one are the same. Repeated rows are packed each, in different bins as copies.
    An empty table gives an empty result; other columns are ignored. Bins and their numbers follow from the
    rows alone, not from files or partitions.
    """
    # pieces are a few numbers each; their texts are read once
    items = cut(pieces(docs, capacity, length, text, key, source))
    # rows that are the same in all this get numbers, so that they spread as well
    same = Window.partitionBy("doc_id", "source", "cluster", "piece", "n_tokens").orderBy("start")
    numbered = items.withColumn("copy", F.row_number().over(same))
    mark = F.xxhash64(F.lit(seed), "doc_id", "piece", "source", "cluster", "copy")
    is_whole = F.col("n_tokens") == capacity
    n = items.agg(F.count_if(is_whole).alias("whole"), F.count_if(~is_whole).alias("rest")).first()
    groups = {k: max(1, -(-n[k] // group_rows)) for k in ("whole", "rest")}
    whole = numbered.filter(is_whole).withColumn("group", F.pmod(mark, F.lit(groups["whole"])))
    dealt = numbered.filter(~is_whole).withColumn("group", F.pmod(mark, F.lit(groups["rest"])))
    schema = "doc_id long, source string, cluster long, piece long, start long, n_tokens long, bin_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        lengths, ids = np.array(column["n_tokens"], np.int64), np.array([-1 if d is None else d for d in column["doc_id"]], np.int64)
        order = np.lexsort((column["copy"], column["cluster"], column["piece"], ids, -lengths))
        out = table.take(pa.array(order))
        dense = []
        for c in ("source", "cluster"):
            numbers: dict = {}
            dense.append([numbers.setdefault(v, len(numbers)) for v in out.column(c).to_pylist()])
        bins, offsets = best_fit(lengths[order].tolist(), *dense, capacity, per_source)
        group = column["group"][0]
        out = out.drop_columns(["copy", "group"])
        out = out.append_column("bin_id", pa.array([2 * (group << 32 | b) for b in bins], pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    ship(docs.sparkSession)
    packed = dealt.groupBy("group").applyInArrow(run, schema)
    # odd numbers are the bins of whole pieces, one for each row
    place = Window.partitionBy("group").orderBy("doc_id", "piece", "cluster", "source", "copy")
    own = F.shiftleft("group", 32).bitwiseOR(F.row_number().over(place).cast("long")) * 2 + 1
    full = whole.withColumn("bin_id", own).withColumn("offset", F.lit(0).cast("long")).drop("copy", "group")
    return packed.unionByName(full)
