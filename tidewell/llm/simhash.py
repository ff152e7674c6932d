"""SimHash near-duplicates: exact tiled comparison of fingerprints.

Fingerprints are compared tile by tile with exclusive-or and bit counts. A tile holds the
fingerprints whose segments have the same population counts; as the difference of two
population counts never exceeds the Hamming distance, two tiles whose counts differ by more
than the radius (summed over the segments) can hold no link and are never paired. Large
tiles are split into blocks of bounded size, so a unit of work is one pair of blocks and no
task ever holds an unbounded group. No link is lost: within a pair of blocks the links are
replaced by a spanning forest of them, which has the same components.

A similarity needs a radius so wide that population counts alone prune nothing. There,
short fingerprints of random parts of a text's shingles (bands) are compared at radius zero
first: two texts of similarity 0.8 share one of sixteen with a probability of 0.97 or more. Tiles are those of
a band's fingerprint and of ranges of population counts then; whole fingerprints are compared inside them at the
wide radius, and what is within it is compared exactly, by the sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, join_grouped, map_arrow, small
from tidewell.llm.components import components

#: Fingerprints in one block of a tile, in expectation.
BLOCK = 2048
#: Bands of a text, and shingles in one, in expectation: from BAND_SHINGLES to twice as many.
BANDS, BAND_SHINGLES = 16, 4
#: Pairs with one text that a task compares exactly, and shingles in a block that holds sets, in expectation.
PAIR_ROWS, SET_SHINGLES = 2000, 4_000_000
SEED = 42


def _widened(h: np.ndarray, words64: int) -> np.ndarray:
    """(n, words64) hashes; the first column is ``h``, others mix it (splitmix64)."""
    out = np.empty((len(h), words64), dtype=np.uint64)
    out[:, 0] = h
    for k in range(1, words64):
        z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, A-Z in lower case, repeats included."""
    # bytes.lower() changes A-Z alone and bytes.split() parts at ASCII white space alone.
    found = text.lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: len(found) - size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words64: int = 1) -> np.ndarray:
    """Majority bits over the hashes (more than half), as ``words64`` unsigned numbers."""
    if not len(hashes):
        return np.zeros(words64, dtype=np.uint64)
    counts = np.zeros(64 * words64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):  # bounds memory for very long texts
        block = _widened(hashes[i : i + 8192], words64)
        counts += np.unpackbits(block.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def shingle_set(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct hashes in ascending order, and a signed digest of them."""
    held = np.unique(hashes)
    return held, int(np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).view(np.int64))


def band_keys(held: np.ndarray, similarity: float) -> np.ndarray:
    """One number for each band: its 64-bit SimHash mixed with the band and the range of sizes.

    ``held``: distinct hashes of shingles. A band holds those that a hash of its own chooses with chance
    1 / m, where m goes with the range of sizes (a factor of two); sets near the upper end of a range also get the bands of the next,
    so that two sets whose sizes agree to ``similarity`` have a range in common. An empty band gives no number.
    """
    n = len(held)
    if not n:
        return np.empty(0, np.int64)
    low = n.bit_length() - 1
    out = []
    for size_range in (low, low + 1) if n >= similarity * 2 ** (low + 1) else (low,):
        limit = np.uint64(2**32 // max(2, 2**size_range // BAND_SHINGLES))
        sums, chosen = np.zeros((BANDS, 64), np.int64), np.zeros(BANDS, np.int64)
        for at in range(0, n, 4096):  # bounds memory for very long texts
            h = held[at : at + 4096]
            z = (h[None, :] + _BAND_SEEDS) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            within = (z >> np.uint64(32)) < limit
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums += (within.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
            chosen += within.sum(axis=1)
        short = np.packbits(2 * sums > chosen[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        mark = np.uint64((size_range + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))
        key = (short ^ _BAND_SEEDS[:, 0] ^ mark) * np.uint64(0x9E3779B97F4A7C15)
        out.append((key ^ (key >> np.uint64(31)))[chosen > 0])
    return np.concatenate(out).view(np.int64)


_BAND_SEEDS = _widened(np.arange(1, BANDS + 1, dtype=np.uint64), 2)[:, 1:]


def fingerprints(
    docs: DataFrame, shingle: int = 3, words64: int = 1, text: str = "text", key: str = "doc_id", similarity: float | None = None
) -> DataFrame:
    """``doc_id``, ``size`` (shingles, long) and ``fp`` (array of longs) of every row.

    With a ``similarity`` repeats of a shingle do not count, ``digest`` is what equal sets share, and
    ``bands`` are their :func:`band_keys`. A null text counts as an
    empty one; an empty text has size 0 and fingerprint zero. Whole texts are read, one at a
    time. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes, found, digests, bands = [], [], [], []
            for t in texts:
                h = shingle_hashes(t.as_py() or b"", shingle)
                if similarity:
                    h, digest = shingle_set(h)
                    digests.append(digest)
                    bands.append(band_keys(h, similarity))
                sizes.append(len(h))
                found.append(fingerprint(h, words64).view(np.int64))
            values = pa.array(np.concatenate(found)) if found else pa.array([], pa.int64())
            offsets = pa.array(np.arange(0, len(sizes) * words64 + 1, words64), pa.int32())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values)]
            columns += [pa.array(digests, pa.int64()), pa.array(bands, pa.list_(pa.int64()))] if similarity else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "fp", "digest", "bands"][: len(columns)])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, size long, fp array<long>" + (", digest long, bands array<long>" if similarity else ""))


def _segment_counts(fp: Column, segments: int) -> list[Column]:
    """Population counts of equal segments of the first 64 bits."""
    width = 64 // segments
    mask = (1 << width) - 1 if width < 64 else -1
    return [F.bit_count(F.shiftrightunsigned(fp[0], width * k).bitwiseAND(F.lit(mask).cast("long"))) for k in range(segments)]


def _segments_for(nodes: int, radius: int) -> int:
    """Segments so that a fingerprint meets about a few ten thousand others.

    More segments mean more, smaller tiles, and more copies of each tile for its
    neighbours. Every choice finds the same links; only the work differs.
    """
    for segments in (2, 4, 8):
        width = 64 // segments
        same = math.comb(2 * width, width) / 4.0**width  # share of pairs with equal counts in a segment
        if nodes * same**segments * _ball(segments, radius) <= 20_000:
            return segments
    return 16


def _ball(segments: int, radius: int) -> int:
    return sum(1 for _ in _offsets(segments, radius)) * 2 - 1


def _offsets(segments: int, radius: int) -> Iterator[tuple[int, ...]]:
    """Offsets of neighbour tiles: sum of absolute values at most ``radius``, each pair of
    tiles once (the first non-zero entry is positive), zero included."""

    def grow(left: int, budget: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        for step in range(-budget, budget + 1):
            for rest in grow(left - 1, budget - abs(step)):
                yield (step, *rest)

    for offset in grow(segments, radius):
        first = next((x for x in offset if x), 0)
        if first >= 0:
            yield offset


def _forest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a[i]-b[j] as they are, or if they are many a star for each of their components."""
    u, v = a[i], b[j]
    if len(u) <= len(a) + len(b):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def compare_blocks(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius. ``a``, ``b``: (n, words64) unsigned fingerprints; ``same``: b is a.

    The first 128 bits are compared for all pairs, further ones for those pairs alone whose
    distance so far is within the radius.
    """
    rows, columns = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    first = min(2, a.shape[1])
    for at in range(0, len(a), step):
        distance = np.bitwise_count(a[at : at + step, :1] ^ b[None, :, 0])
        for k in range(1, first):
            distance += np.bitwise_count(a[at : at + step, k : k + 1] ^ b[None, :, k])
        near = distance <= min(radius, 64 * first)
        if same:
            near &= np.arange(at, at + near.shape[0])[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(near)
        if a.shape[1] > first and len(i):
            far = np.bitwise_count(a[at + i] ^ b[j]).sum(axis=1, dtype=np.int64)
            i, j = i[far <= radius], j[far <= radius]
        rows.append(i + at)
        columns.append(j)
    return np.concatenate(rows) if rows else np.empty(0, int), np.concatenate(columns) if columns else np.empty(0, int)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, as sorted distinct numbers."""
    if not len(a) or not len(b):
        return 0.0
    at = a.searchsorted(b)
    at[at == len(a)] = 0
    both = int(np.count_nonzero(a[at] == b))
    return both / (len(a) + len(b) - both)


def jaccards(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard similarities of the pairs sets_a[i], sets_b[j]: pair by pair where they are few, else by a product of incidence matrices."""
    rows, row_of = np.unique(i, return_inverse=True)
    columns, column_of = np.unique(j, return_inverse=True)
    size_a, size_b = (np.array([len(x[k]) for k in y], np.int64) for x, y in ((sets_a, rows), (sets_b, columns)))
    all_a, all_b = (np.concatenate([x[k] for k in y]) if len(y) else np.empty(0, np.int64) for x, y in ((sets_a, rows), (sets_b, columns)))
    common = np.intersect1d(all_a, all_b)
    if len(i) * 300_000 < len(rows) * len(columns) * len(common) + (len(all_a) + len(all_b)) * 1000:
        return np.array([jaccard(sets_a[x], sets_b[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    places = []
    for values, sizes in ((all_a, size_a), (all_b, size_b)):
        at = common.searchsorted(values)
        at[at == len(common)] = 0
        held = common[at] == values if len(common) else np.zeros(len(values), bool)
        places.append((np.repeat(np.arange(len(sizes)), sizes)[held], at[held]))
    both = np.zeros((len(rows), len(columns)), np.float32)
    for first in range(0, len(common), 4096):  # bounds memory
        width, parts = min(4096, len(common) - first), []
        for (of, at), n in zip(places, (len(rows), len(columns)), strict=True):
            inside = (at >= first) & (at < first + width)
            part = np.zeros((n, width), np.float32)
            part[of[inside], at[inside] - first] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    shared = both[row_of, column_of].astype(np.float64)
    whole = size_a[row_of] + size_b[column_of] - shared
    return np.where(whole > 0, shared / np.maximum(whole, 1), 0.0)


def tile_pairs(tiled: DataFrame, offsets: list[list[int]], radius: int, words64: int, similarity: float = 0.0) -> DataFrame:
    """Links ``u``, ``v`` within ``radius`` bits, of tiles that are one of ``offsets`` apart.

    ``tiled``: ``node``, ``size``, ``fp``, ``tile`` (array of longs); the first offset is zero, and of two
    opposite ones only one is given. The links of two blocks are given as a spanning forest. With a ``similarity``, rows
    also have ``root`` (a component that is known) and ``held`` (the set of shingles): pairs within the radius are
    candidates then, and those are links whose sets have the similarity; pairs that are joined already are passed over.
    A block is gathered once and in the order of its nodes; compared with itself it is sent once.
    """
    names = ["node", *[f"f{k}" for k in range(words64)], *(["root", "held"] if similarity else [])]
    rows = tiled.withColumns({f"f{k}": F.col("fp")[k] for k in range(words64)})
    wanted = F.ceil(F.count(F.lit(1)) / BLOCK)
    per_tile = tiled.groupBy("tile").agg((F.greatest(wanted, F.ceil(F.sum("size") / SET_SHINGLES)) if similarity else wanted).alias("blocks"))
    blocks = (
        rows.join(per_tile, "tile")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .groupBy("tile", "block")
        .agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))
    )
    steps = F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in offsets])
    left = blocks.withColumn("step", F.explode(steps)).select(
        F.col("block").alias("block_a"),
        F.col("rows").alias("rows_a"),
        F.exists("step", lambda x: x != 0).alias("other"),
        F.zip_with("tile", "step", lambda x, y: x + y).alias("tile"),
    )
    right = blocks.select("tile", F.col("block").alias("block_b"), F.col("rows").alias("rows_b"))
    pairs = left.join(right, "tile").filter("other or block_a <= block_b")
    pairs = pairs.select("rows_a", F.expr("case when other or block_a < block_b then rows_b end").alias("rows_b"))

    def unpacked(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        held = column.slice(row, 1).flatten()
        fp = np.stack([held.field(f"f{k}").to_numpy() for k in range(words64)], axis=1).view(np.uint64)
        if not similarity:
            return held.field("node").to_numpy(), fp, np.empty(0, np.int64), []
        lists = held.field("held")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        return held.field("node").to_numpy(), fp, held.field("root").to_numpy(), np.split(lists.flatten().to_numpy(), ends[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row in range(batch.num_rows):
                a, fp_a, root_a, sets_a = unpacked(batch.column(0), row)
                same = not batch.column(1)[row].is_valid
                b, fp_b, root_b, sets_b = (a, fp_a, root_a, sets_a) if same else unpacked(batch.column(1), row)
                i, j = compare_blocks(fp_a, fp_b, same, radius)
                if similarity:
                    p, q = (np.array([len(x) for x in y]) for y in (sets_a, sets_b))
                    wanted = (np.minimum(p[i], q[j]) >= similarity * np.maximum(p[i], q[j])) & (root_a[i] != root_b[j])
                    i, j = i[wanted], j[wanted]
                    similar = jaccards(sets_a, sets_b, i, j) >= similarity
                    i, j = i[similar], j[similar]
                if len(i):
                    u, v = _forest(a, b, i, j)
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    return map_arrow(pairs, run, "u long, v long", rows=16)


def links(nodes: DataFrame, radius: int, words64: int = 1) -> DataFrame:
    """Links ``u``, ``v`` between nodes whose fingerprints are within ``radius`` bits.

    ``nodes``: ``node`` (long), ``size``, ``fp``. Tiles are those of population counts, see the module's head. The links have
    the components of all links.
    """
    segments = _segments_for(nodes.count(), radius)
    key = F.array(*[c.cast("long") for c in _segment_counts(F.col("fp"), segments)])
    offsets = sorted((list(o) for o in _offsets(segments, radius)), key=any)
    tiled = nodes.select("node", "size", "fp", key.alias("tile"))
    return tile_pairs(tiled, offsets, radius, words64)


def _distance(a: str, b: str, words64: int) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, words64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``node``, ``held``: the distinct hashes of shingles of the ``nodes`` (``node``, ``digest``), from the texts again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], []
            digests = batch.column(2).to_pylist()
            for row, t in enumerate(batch.column(1).cast(pa.binary())):
                held, digest = shingle_set(shingle_hashes(t.as_py() or b"", shingle))
                if digest == digests[row]:  # else another text of the same doc_id
                    at.append(row)
                    found.append(held.view(np.int64))
            kept = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(found, pa.list_(pa.int64()))], names=["node", "held"])

    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).join(small(nodes), "node")
    return map_arrow(texts.select("node", "text", "digest"), read, "node long, held array<long>").dropDuplicates(["node"])


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``u``, ``v``, distinct, cut) whose sets have that Jaccard similarity or more, exactly.

    A set meets its partners in parts of about PAIR_ROWS, so that one with very many partners
    is shared by many tasks.
    """
    n = pairs.count()
    held = cut(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("held")))
    part = F.pmod(F.xxhash64("u"), F.ceil(F.col("held") / PAIR_ROWS)).cast("int").alias("part")
    dealt = cut(join_grouped(pairs, held, "v", "held", n).select("u", "v", part))
    left = dealt.join(sets.select(F.col("node").alias("u"), F.col("held").alias("set_u")), "u")
    right = dealt.select("v", "part").distinct().join(sets.select(F.col("node").alias("v"), F.col("held").alias("set_v")), "v")
    both = left.join(right, ["v", "part"]).withColumn("common", F.size(F.array_intersect("set_u", "set_v")).cast("double"))
    return both.filter(F.col("common") / (F.size("set_u") + F.size("set_v") - F.col("common")) >= similarity).select("u", "v")


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, radius: int, words64: int, similarity: float) -> DataFrame:
    """Links ``u``, ``v`` between nodes whose sets of shingles are similar enough and that share a band.

    ``nodes``: ``node`` (a doc_id), ``size``, ``fp``, ``digest``, ``bands``. First every node is compared with
    one node of each of its bands' tiles, the one that shares most bands with others (in a group of
    near copies the one that they are copies of): so a large group is joined by about as many pairs as it has
    nodes. Then tiles in which several components are left are compared whole, pair of blocks by
    pair of blocks. So links have the components of all similar pairs that share a band.
    """
    members = nodes.select("node", F.explode("bands").alias("band"))
    several = members.groupBy("band").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("a"), F.max("node").alias("b"))
    several = cut(several.filter("a <> b").select("band", "held"))
    total = several.agg(F.sum("held")).first()[0] or 0
    shared = cut(join_grouped(members, several, "band", "held", total).select("node", "band", "held"))
    known = cut(shared.groupBy("node").agg(F.sum("held").alias("reach")))
    slim = cut(nodes.select("node", "size", "fp", "digest").join(known, "node"))
    centres = shared.join(known, "node").groupBy("band").agg(F.max_by("node", F.struct("reach", -F.col("node"))).alias("centre"), F.count(F.lit(1)).alias("held"))
    stars = join_grouped(shared.select("node", "band"), cut(centres), "band", "held", total).filter("node <> centre")
    stars = cut(stars.select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct())

    count = stars.count()
    per_centre = stars.groupBy("v").agg(F.count(F.lit(1)).alias("held")).join(slim.select(F.col("node").alias("v"), F.col("size").alias("q"), F.col("fp").alias("fq")), "v")
    both = join_grouped(stars, cut(per_centre), "v", "held", count).join(slim.select(F.col("node").alias("u"), "size", "fp"), "u")
    agree = F.least("size", "q") >= F.lit(similarity) * F.greatest("size", "q")
    near = cut(both.filter(agree & (_distance("fp", "fq", words64) <= radius)).select("u", "v"))
    read = cut(near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct())
    sets = cut(_sets(docs, cut(slim.join(read, "node").select("node", "digest")), shingle))
    found = cut(similar_pairs(near, sets, similarity))

    named = cut(shared.join(components(found), "node", "left").select("node", "band", F.coalesce("root", "node").alias("root")))
    left_over = named.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("held")).filter("a <> b")
    rest = cut(join_grouped(named, cut(left_over.select("band", "held")), "band", "held", total).select("node", "band", "root"))
    lacking = rest.select("node").distinct().join(read, "node", "left_anti")
    sets = sets.unionByName(_sets(docs, cut(slim.join(lacking, "node").select("node", "digest")), shingle))
    bits = sum((F.bit_count(F.col("fp")[k]) for k in range(1, words64)), F.bit_count(F.col("fp")[0]))
    tile = F.array("band", F.floor(bits / (radius + 1)).cast("long")).alias("tile")
    tiled = cut(rest.join(slim, "node").join(sets, "node").select("node", "size", "root", "fp", "held", tile))
    return found.unionByName(tile_pairs(tiled, [[0, 0], [0, 1]], radius, words64, similarity))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, radius: int | None = None, words64: int = 4, similarity: float = 0.8
) -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``fp``, ``component_id``.

    ``radius``: bits. By default it follows from ``similarity``: the expected distance of two
    sets of equal size at that Jaccard similarity plus four standard deviations. Pairs within it that
    share a band and whose sizes agree to the similarity are candidates only; those are linked whose sets of
    shingles have that similarity exactly (by 64-bit hashes); ``size`` and ``fp`` are those of the
    set then, without repeats. A pair just at the similarity is found with a probability of 0.97 or more, one of 0.9 with
    0.999. With a given radius only the fingerprints decide, and no pair is missed.
    ``component_id`` is the smallest doc_id that links reach.

    Texts: null counts as empty; all empty texts share fingerprint zero and are linked.
    Rows with a null doc_id get a fingerprint, no links and a null component_id. Repeated
    rows and equal texts have equal fingerprints and so one component. An empty table gives
    an empty result. Other columns of ``docs`` are ignored.
    """
    ratio = 0.0
    if radius is None:
        bits, p = 64 * words64, math.acos(2 * similarity / (1 + similarity)) / math.pi
        radius, ratio = round(bits * p + 4 * math.sqrt(bits * p * (1 - p))), similarity
    rows = cut(fingerprints(docs, shingle, words64, similarity=ratio or None))
    # classes of equal sets, or of equal fingerprints where these alone decide
    on = ["fp", "size", "digest"] if ratio else ["fp"]
    held = rows.filter("doc_id is not null").groupBy(*on)
    if ratio:
        classes = cut(held.agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
        found = similar_links(docs, classes, shingle, radius, words64, similarity)
    else:
        classes = cut(held.agg(F.min("doc_id").alias("node"), F.max("size").alias("size")))
        found = links(classes, radius, words64)
    # rows that share a doc_id are one document, even where their texts differ
    mark = F.xxhash64(*(on if ratio else ["fp", "size"]))
    shared = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).filter("a <> b").select("doc_id")
    several = rows.select("doc_id", *on).join(shared, "doc_id").join(classes.select("node", *on), on)
    found = found.unionByName(several.select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    roots = components(found)
    named = classes.join(roots, "node", "left").select(*on, F.coalesce("root", "node").alias("component_id"))
    out = rows.join(named, on, "left")
    return out.select("doc_id", "size", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs`` that stay: one of each group of near-duplicates, all columns kept.

    The row with the smallest doc_id of a group stays; of several rows that share this
    doc_id the one with the least text does (null first; of equal texts the one whose columns have the
    least hash). Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, **settings)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__tw_id")).distinct()
    repeated = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = docs.join(gone, docs["doc_id"] == gone["__tw_id"], "left_anti")
    if repeated.isEmpty():
        return kept
    twice = repeated.select(F.col("doc_id").alias("__tw_id"))
    single = kept.join(twice, kept["doc_id"] == twice["__tw_id"], "left_anti")
    several = kept.join(twice, kept["doc_id"] == twice["__tw_id"], "left_semi")
    order = F.struct("text", F.xxhash64(*several.columns))
    least = several.groupBy("doc_id").agg(F.min_by(F.struct(*several.columns), order).alias("__tw_row"))
    return single.unionByName(least.select("__tw_row.*"))
