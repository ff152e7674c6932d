"""Quality rules whose cutoffs are chosen under a risk bound. DataFrame functions only.

Every document gets a few signals (shares per word). Levels 0, 1, ... are stricter and
stricter sets of cutoffs, one for each signal; a document's level is the first one whose
cutoffs reject it. On the labelled holdout of a stratum, the share of good documents that a
level rejects is bounded from above by the exact binomial (Clopper-Pearson) bound: level l
holds if P(Bin(n, alpha) <= k) <= delta / strata for k rejected of n good documents. Levels are
tested in their fixed order and testing ends at the first that fails, so no correction is
needed within a stratum; over strata the error probability is shared out (Bonferroni).
Then, with probability 1 - delta, no stratum loses more than a share alpha of its good
documents. Among the levels that hold, the one with the largest gain (share of bad documents
rejected less share of good ones) is used, the laxest of equals. A stratum without a level
that holds (too few labels, say) rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, small, words

LEVELS = 16
#: Signal: cutoff at level 0, cutoff at the last level; between them in equal steps.
CUTOFFS = {
    "symbols": (0.90, 0.15),  # symbol characters per word
    "capitals": (0.90, 0.25),  # capital letters per character of the words
    "bangs": (0.90, 0.25),  # exclamation marks per word
    "repeated_lines": (0.95, 0.70),  # repeated lines per line with a word
    "stutter": (0.90, 0.30),  # words equal to the word before them, per word
}
ALPHA, DELTA = 0.02, 0.05
WINDOW_WORDS = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by eight so that it is good to 1e-12 from 0 on."""
    y = n + F.lit(9.0)
    series = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (n + F.lit(float(i)))
    return series - F.log(product)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed over the exact probabilities."""
    size = n.cast("double")

    def term(i: Column) -> Column:
        x = i.cast("double")
        return F.exp(_log_factorial(size) - _log_factorial(x) - _log_factorial(size - x) + x * math.log(p) + (size - x) * math.log1p(-p))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(0.0), lambda total, i: total + term(i))


def _repeat_starts(ordered: Column) -> Column:
    """Starts of windows that occur twice or more, ascending. ``ordered``: sorted (hash, position)."""
    again = F.filter(
        ordered,
        lambda x, i: F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)),
    )
    return F.array_sort(F.transform(again, lambda x: x["i"]))


def signals(docs: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """Counts of every row's whole text, beside the ``carry`` columns (as ``__tw_c0`` ...).

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``
    (long), ``base_failed`` and the ``level`` at which the signals reject the row (null:
    at none). A null text has no words. Windows are compared by 64-bit hashes within a text.
    """
    carried = [F.col(c).alias(f"__tw_c{i}") for i, c in enumerate(carry or [])]
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select(*carried, t.alias("__tw_text"), words(t).alias("__tw_words"))
    keep = [f"__tw_c{i}" for i in range(len(carried))]
    lines = F.filter(F.split("__tw_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    b = a.select(
        *keep,
        F.size("__tw_words").cast("long").alias("n_words"),
        F.aggregate("__tw_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("__tw_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__tw_text", F.lit(r"\p{Lu}")).alias("__tw_caps"),
        F.regexp_count("__tw_text", F.lit("!")).alias("__tw_bangs"),
        lines.alias("__tw_lines"),
        F.transform("__tw_words", lambda w: F.xxhash64(w)).alias("__tw_h"),
    )
    starts = F.col("n_words") - (WINDOW_WORDS - 1)
    c = b.select(
        *keep, "n_words", "word_chars", "n_symbols", "__tw_caps", "__tw_bangs",
        F.size("__tw_lines").cast("long").alias("__tw_n_lines"),
        (F.size("__tw_lines") - F.size(F.array_distinct("__tw_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(F.zip_with("__tw_h", F.slice("__tw_h", F.lit(2), F.size("__tw_h")), lambda x, y: x == y), lambda same: same)).alias("__tw_same"),
        F.when(starts >= 2, F.transform(F.sequence(F.lit(1), starts.cast("int")), lambda i: F.xxhash64(F.slice("__tw_h", i, WINDOW_WORDS)))).alias("__tw_win"),
    )
    d = c.withColumn(
        "__tw_ordered",
        F.when(
            F.size(F.array_distinct("__tw_win")) < F.size("__tw_win"),
            F.sort_array(F.transform("__tw_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("__tw_win")
    e = d.withColumn("__tw_starts", _repeat_starts(F.col("__tw_ordered"))).drop("__tw_ordered")
    following = F.slice(F.col("__tw_starts"), F.lit(2), F.size("__tw_starts"))
    covered = F.aggregate(
        F.zip_with("__tw_starts", following, lambda x, y: F.least(F.lit(WINDOW_WORDS), F.coalesce(y - x, F.lit(WINDOW_WORDS)))),
        F.lit(0).cast("long"),
        lambda n, x: n + x,
    )
    f = e.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__tw_starts")
    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.nullif(F.col(whole), F.lit(0))

    ratio = {
        "symbols": share("n_symbols", "n_words"),
        "capitals": share("__tw_caps", "word_chars"),
        "bangs": share("__tw_bangs", "n_words"),
        "repeated_lines": share("n_dup_lines", "__tw_n_lines"),
        "stutter": share("__tw_same", "n_words"),
    }
    step = [
        # the first level l with cutoff(l) < value; none if the value is within the last cutoff
        F.when(v > lo, F.greatest(F.lit(0), F.floor((hi - v) / ((hi - lo) / (LEVELS - 1))).cast("int") + 1 * (v <= hi).cast("int")))
        for name, (hi, lo) in CUTOFFS.items()
        for v in [ratio[name]]
    ]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return f.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.col("n_words") > 0, F.least(*[F.least(s, F.lit(LEVELS - 1)) for s in step])).alias("level"),
    )


def choose_levels(rated: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum``, ``cutoff_level``: strata that reject, and the level from which they do.

    ``rated``: ``doc_id``, ``stratum``, ``rank`` (see _rank); ``labels``: ``doc_id``, ``quality`` (1: good; rows with a null are left out, a document labelled twice counts with
    its worst label). Counts per stratum and level are pre-aggregated; the result has one row
    a stratum at most.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = rated.join(marks, "doc_id")
    # counted where the base rules pass; a filter would be pushed into the texts' projections
    passes = F.col("rank") >= 0
    good, bad = (passes & (F.col("quality") == 1)).cast("long"), (passes & (F.col("quality") != 1)).cast("long")
    per = held.groupBy("stratum", F.col("rank").alias("level")).agg(F.sum(good).alias("g"), F.sum(bad).alias("b"))
    totals = per.groupBy("stratum").agg(
        F.sum("g").alias("n"), F.sum("b").alias("m"), F.collect_list(F.struct("level", "g", "b")).alias("counts")
    )  # a stratum has LEVELS + 1 rows at most
    strata = totals.agg(F.count_if(F.col("n") + F.col("m") > 0).alias("strata"))

    def upto(level: Column, what: str) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + F.when(x["level"] <= level, x[what]).otherwise(0))

    tried = totals.crossJoin(F.broadcast(strata)).select(  # one row on the right
        "stratum", "n", "m", "strata",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda l: F.struct(l.alias("l"), upto(l, "g").alias("k"), upto(l, "b").alias("hit")))).alias("x"),
    ).select("stratum", "n", "m", "strata", "x.*")
    tried = tried.filter("n > 0")
    holds = F.when(F.col("k") >= F.col("n") * alpha, F.lit(False)).otherwise(binomial_cdf(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("strata"))
    order = Window.partitionBy("stratum").orderBy("l")
    passed = tried.withColumn("holds", holds).withColumn("so_far", F.min(F.col("holds").cast("int")).over(order)).filter("so_far = 1")
    gain = F.coalesce(F.col("hit") / F.nullif(F.col("m"), F.lit(0)), F.lit(0.0)) - F.col("k") / F.col("n")
    best = Window.partitionBy("stratum").orderBy(F.col("gain").desc(), "l")
    chosen = passed.withColumn("gain", F.round(gain, 9)).withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return chosen.select("stratum", F.col("l").alias("cutoff_level"))


def _stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def _rank() -> Column:
    """-1 where the base rules fail, else the level, LEVELS where no level rejects."""
    return F.when(F.col("base_failed"), -1).otherwise(F.coalesce("level", F.lit(LEVELS)))


def judge(rated: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds ``kept`` to rated rows. ``levels`` has one row a stratum (language)."""
    return rated.join(levels, "stratum", "left").withColumn("kept", F.col("rank") > F.coalesce("cutoff_level", F.lit(-1)))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    Null and empty texts have no words and fail the base rules. A null language is a
    stratum of its own; rows with a null doc_id are judged but never calibrate. Repeated
    rows each get their row. Empty tables give an empty result; without labels only the base
    rules reject. Other columns are ignored, whatever their names.
    """
    rated = cut(
        signals(docs, ["doc_id", "lang"])
        .withColumnRenamed("__tw_c0", "doc_id")
        .withColumn("stratum", _stratum(F.col("__tw_c1")))
        .withColumn("rank", _rank())
        .drop("__tw_c1")
    )
    return judge(rated, small(cut(choose_levels(rated, labels.select("doc_id", "quality"), alpha, delta))))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns.

    The signals are computed once: rows go to the shared folder with their rank, from which the levels are chosen
    (reading ids and ranks alone) and the kept rows are taken. Texts are never shuffled.
    """
    names = docs.columns
    carried = [f"__tw_c{i}" for i in range(len(names))]
    id_, lang = carried[names.index("doc_id")], carried[names.index("lang")]
    rated = cut(signals(docs, names).select(*carried, _stratum(F.col(lang)).alias("stratum"), _rank().alias("rank")))
    chosen = choose_levels(rated.select(F.col(id_).alias("doc_id"), "stratum", "rank"), labels.select("doc_id", "quality"), alpha, delta)
    return judge(rated, small(cut(chosen))).filter("kept").select(*[F.col(c).alias(n) for c, n in zip(carried, names, strict=True)])
