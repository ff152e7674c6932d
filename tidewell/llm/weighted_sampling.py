"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

For each of ``SAMPLES`` draws every term t of a document, with weight w (how often it occurs),
gets from seeded hashes r and c, both gamma distributed with shape 2, and b, uniform. With
q = floor(ln w / r + b) and ln a = ln c - r (q - b + 1), the draw keeps the term with the
least a, along with its q. Two documents keep the same (term, q) with a probability of exactly
their generalised Jaccard similarity, the sum of least weights over the sum of largest. As a
is a function of draw, term and q, the least a itself stands for the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, words

SAMPLES = 32
#: Ranges of equal counts from quantiles of the ids, parts of one at most (by quantiles again), and rows of a part, in expectation.
COARSE, FINE, PART_ROWS = 64, 4_000, 4_000


def weighted_terms(text: Column, docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row of ``docs`` and distinct word: ``keep``, ``__tw_term`` (64-bit hash),
    ``__tw_lnw`` (log of its count). A text without words gives one row with nulls."""
    ordered = docs.select(*keep, F.sort_array(F.transform(words(text), lambda w: F.xxhash64(w))).alias("__tw_h"))
    previous = F.concat(F.array(F.lit(None).cast("long")), F.slice("__tw_h", F.lit(1), F.greatest(F.size("__tw_h") - 1, F.lit(0))))
    marked = ordered.select(*keep, "__tw_h", F.zip_with("__tw_h", previous, lambda x, y: F.when(~x.eqNullSafe(y), x)).alias("__tw_new"))
    starts = marked.select(
        *keep, "__tw_h",
        F.filter(F.transform("__tw_new", lambda x, i: F.when(x.isNotNull(), i)), lambda x: x.isNotNull()).alias("__tw_starts"),
    )
    pairs = starts.select(
        *keep,
        F.zip_with(
            F.array_distinct("__tw_h"),
            F.zip_with("__tw_starts", F.slice("__tw_starts", F.lit(2), F.size("__tw_starts")), lambda a, b: F.coalesce(b, F.size("__tw_h")) - a),
            lambda h, n: F.struct(h.alias("h"), n.alias("n")),
        ).alias("__tw_pairs"),
    )
    rows = pairs.select(*keep, F.explode_outer("__tw_pairs").alias("__tw_pair"))
    return rows.select(*keep, F.col("__tw_pair.h").alias("__tw_term"), F.log(F.col("__tw_pair.n").cast("double")).alias("__tw_lnw"))


def _draw(k: int) -> Column:
    """ln a of one term in draw ``k``; null where there is no term."""
    x, y = F.xxhash64("__tw_term", F.lit(k)), F.xxhash64("__tw_term", F.lit(k + 1000))

    def uniform(bits: Column, width: int) -> Column:
        return (bits.cast("double") + 0.5) * F.lit(2.0**-width)

    def field(value: Column, shift: int, width: int) -> Column:
        return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    r = -F.log(uniform(F.shiftrightunsigned(x, 43), 21) * uniform(field(x, 22, 21), 21))
    b = uniform(field(x, 0, 22), 22)
    c = -F.log(uniform(F.shiftrightunsigned(y, 32), 32) * uniform(field(y, 0, 32), 32))
    return F.log(c) - r * (F.floor(F.col("__tw_lnw") / r + b) - b + 1)


def signatures(terms: DataFrame, keep: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keep`` and ``sig``, an array of ``samples`` numbers (nulls if there were no terms)."""
    least = terms.groupBy(*keep).agg(*[F.min(_draw(k)).alias(f"__tw_s{k}") for k in range(samples)])
    return least.select(*keep, F.array(*[f"__tw_s{k}" for k in range(samples)]).alias("sig"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal draws; two texts without words are alike, one with and one without not."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def _digits(sig: Column) -> Column:
    """Eight hexadecimal digits a draw; zeros where there was no word."""
    draws = F.transform(sig, lambda x: F.coalesce(F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0"), F.lit("0" * 8)))
    return F.array_join(F.transform(F.arrays_zip(draws.alias("d"), sig.alias("s")), lambda z: F.when(z["s"].isNull(), "0" * 8).otherwise(z["d"])), "")


def _parts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``__tw_part``: ranges of ``__tw_key`` of about PART_ROWS rows, in order.

    Quantiles give COARSE ranges of equal counts, and quantiles of each give its parts, so that ids
    may lie as unevenly as they like. Bounds are arrays of COARSE and, in as many rows, FINE numbers at most.
    """
    found = docs.agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("__tw_key", [i / COARSE for i in range(COARSE)], 10_000).alias("at"), F.min("__tw_key").alias("low")
    ).first()
    if not found["n"]:
        return docs.withColumn("__tw_part", F.lit(0).cast("long")), 1
    at = sorted({found["low"], *found["at"]})

    def place(bounds: Column) -> Column:
        """How many of the ascending bounds are at most the key, 1 at least."""
        return F.greatest(F.size(F.filter(bounds, lambda b: F.col("__tw_key") >= b)), F.lit(1))

    named = docs.withColumn("__tw_coarse", place(F.array(*[F.lit(b) for b in at])))
    fine = min(FINE, max(1, -(-found["n"] // (COARSE * PART_ROWS))))
    if fine == 1:
        return named.withColumn("__tw_part", F.col("__tw_coarse").cast("long")).drop("__tw_coarse"), len(at)
    inner = named.groupBy("__tw_coarse").agg(F.array_distinct(F.percentile_approx("__tw_key", [i / fine for i in range(fine)], max(10_000, 4 * fine))).alias("__tw_bounds"))
    cut_up = named.join(F.broadcast(cut(inner)), "__tw_coarse")  # COARSE rows
    part = F.col("__tw_coarse").cast("long") * fine + place(F.col("__tw_bounds")) - 1
    return cut_up.withColumn("__tw_part", part).drop("__tw_coarse", "__tw_bounds"), len(at) * fine


def fingerprints(docs: DataFrame, samples: int = SAMPLES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``sig`` of every row's whole text; no shuffle but of the numbers.

    A null text counts as empty; a text without words has nulls. Repeated rows each get a row.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("__tw_row"), F.col(text).alias("__tw_text"))
    keep = ["__tw_row", "doc_id"]
    return signatures(weighted_terms(F.col("__tw_text"), rows, keep), keep, samples).drop("__tw_row")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. The edited text has the last floor(n/2) code points
    replaced by as many first ones (or all) of the next document by ascending doc_id, the first
    following the last. Null texts count as empty. Rows with equal doc_id follow each other by text,
    rows with a null doc_id come last. A lone document is its own next. An empty table gives
    an empty result; other columns are ignored.

    Texts are shuffled once, to ranges of ids; the first document of a range is also sent to
    the range before it, so that every row finds its next one in its own range. All later
    steps keep that partitioning.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows, n_parts = _parts(
        docs.select(F.col(key).cast("long").alias("doc_id"), t.alias("__tw_text")).withColumn(
            # rows without an id come last, dealt by the first bytes of their texts, by which they are ordered
            "__tw_key", F.coalesce("doc_id", F.lit(2**62).cast("long") + F.coalesce(F.conv(F.hex(F.rpad(F.substring(F.col("__tw_text").cast("binary"), 1, 7), 7, b"\x00")), 16, 10).cast("long"), F.lit(0).cast("long")))
        )
    )
    firsts = rows.groupBy("__tw_part").agg(F.min("__tw_key").alias("__tw_key"))  # a row a part
    order = Window.orderBy("__tw_part")
    sent = firsts.select("__tw_key", F.lag("__tw_part").over(order).alias("__tw_to"))
    last = firsts.agg(F.max("__tw_part").alias("__tw_last"))
    sent = sent.crossJoin(F.broadcast(last)).select(F.col("__tw_key").alias("__tw_first"), F.coalesce("__tw_to", "__tw_last").alias("__tw_to"))
    sent = F.broadcast(sent) if n_parts <= 1_000_000 else sent
    with_guard = rows.join(sent, rows["__tw_key"] == sent["__tw_first"], "left").drop("__tw_first")
    own = F.struct(F.col("__tw_part").alias("part"), F.lit(False).alias("guard"))
    guard = F.struct(F.col("__tw_to").alias("part"), F.lit(True).alias("guard"))
    copies = F.when(F.col("__tw_to").isNull(), F.array(own)).otherwise(F.array(own, guard))
    dealt = with_guard.select("doc_id", "__tw_key", "__tw_text", F.explode(copies).alias("at")).select(
        "doc_id", "__tw_key", "__tw_text", F.col("at.part").alias("__tw_part"), F.col("at.guard").alias("__tw_guard")
    )
    follow = Window.partitionBy("__tw_part").orderBy("__tw_guard", "__tw_key", "__tw_text")
    seen = dealt.select(
        "__tw_part", "__tw_guard", "doc_id", "__tw_text",
        F.row_number().over(follow).alias("__tw_rn"),
        F.lead("__tw_text").over(follow).alias("__tw_next"),
    )
    n = F.length("__tw_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("__tw_text").substr(F.lit(1), n - half), F.coalesce(F.col("__tw_next"), F.lit("")).substr(F.lit(1), half))
    both = seen.select("__tw_part", "__tw_guard", "__tw_rn", "doc_id", n.cast("long").alias("n_chars"), "__tw_text", edited.alias("__tw_edited"))
    both = both.select(
        "__tw_part", "__tw_guard", "__tw_rn", "doc_id", "n_chars", F.sha2("__tw_edited", 256).alias("edited_sha256"),
        F.posexplode(F.when(F.col("__tw_guard"), F.array("__tw_text")).otherwise(F.array("__tw_text", "__tw_edited"))).alias("__tw_which", "__tw_text"),
    )
    keep = ["__tw_part", "__tw_rn", "__tw_which", "__tw_guard", "doc_id", "n_chars", "edited_sha256"]
    found = signatures(weighted_terms(F.col("__tw_text"), both, keep), keep, samples)
    by_row = ["__tw_part", "__tw_rn", "__tw_guard", "doc_id", "n_chars", "edited_sha256"]
    wide = found.groupBy(*by_row).agg(
        *[F.max(F.when(F.col("__tw_which") == w, F.col("sig")[k])).alias(f"__tw_{w}_{k}") for w in (0, 1) for k in range(samples)]
    )
    sigs = wide.select(*by_row, *[F.array(*[f"__tw_{w}_{k}" for k in range(samples)]).alias(f"__tw_sig{w}") for w in (0, 1)])
    nexts = sigs.withColumn("__tw_sig2", F.lead("__tw_sig0").over(Window.partitionBy("__tw_part").orderBy("__tw_rn"))).filter("not __tw_guard")
    return nexts.select(
        "doc_id", "n_chars", "edited_sha256",
        _digits(F.col("__tw_sig0")).alias("fingerprint"), _digits(F.col("__tw_sig1")).alias("edited_fingerprint"),
        likeness(F.col("__tw_sig0"), F.col("__tw_sig1"), samples).alias("near_edited"),
        likeness(F.col("__tw_sig0"), F.col("__tw_sig2"), samples).alias("near_next"),
    )
