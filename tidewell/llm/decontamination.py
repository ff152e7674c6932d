"""Benchmark decontamination by winnowing. DataFrame functions only.

A text's words have a hash each, runs of k words a hash of those, and of every ``w`` runs in a row
the least hash is kept, with its place (winnowing). Two texts that share ``k + w - 1`` words in a row see
the same ``w`` runs there and so keep the same hash at the same place of the passage: no shared
passage of that length can be missed. Kept hashes of training texts are joined with those of the benchmark;
around each hit the windows of whole length that hold it are compared word by word.

Items with fewer words than a window are windows themselves. They have kept hashes of their own length,
``k = ceil(length / 2)``, made only where the benchmark has items of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, join_grouped, small

WINDOW_WORDS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower case: all ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a side that is broadcast at most.
HIT_ROWS = 50_000


def item_words(text: Column) -> Column:
    """Words in lower case (A-Z only); empty for a null text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN), lambda w: w != F.lit(""))


def _runs(hashes: Column, k: int, length: int) -> Column:
    """Hash of every run of ``k`` word hashes, seeded by the window's length."""
    places = F.sequence(F.lit(0), F.size(hashes) - k)
    return F.transform(places, lambda i: F.xxhash64(F.lit(length), *[F.get(hashes, i + j) for j in range(k)]))


def winnowed(hashes: Column, length: int) -> Column:
    """(``h``, ``p``) of the kept runs of a text's word hashes, for shared passages of ``length`` words; null for shorter texts.

    A run is kept if it is least in one of the ``w`` stretches that hold it: if its hash, which no stretch's least
    exceeds, equals the greatest of their leasts. Of equal least runs all are kept.
    """
    k = (length + 1) // 2
    w = length - k + 1

    def kept(runs: Column) -> Column:
        if w == 1:
            return F.transform(runs, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        least = F.transform(F.sequence(F.lit(0), F.size(runs) - w), lambda i: F.least(*[F.get(runs, i + j) for j in range(w)]))
        return F.transform(F.array(least), lambda mins: F.filter(
            F.transform(runs, lambda h, p: F.struct(F.when(h == F.greatest(*[F.get(mins, p - j) for j in range(w)]), h).alias("h"), p.alias("p"))),
            lambda x: x["h"].isNotNull(),
        ))[0]

    bound = F.transform(F.array(_runs(hashes, k, length)), kept)[0]  # an array of one binds the runs, which are used several times
    return F.when(F.size(hashes) >= length, bound)


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def windows_of(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """``length``, ``window`` (words joined by spaces), ``items`` (sorted ids as strings): every distinct window once."""
    held = benchmark.select(F.col(key).cast("string").alias("item"), item_words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(WINDOW_WORDS))
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("length") + 1)
    each = held.withColumn("length", length).withColumn("at", F.explode(starts)).select("item", "length", F.array_join(F.slice("ws", F.col("at"), F.col("length")), " ").alias("window"))
    return each.groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with ``__tw_digest`` and ``__tw_words`` beside ``__tw_fps``, and every distinct text's hits.

    The second has ``digest``, ``at`` (first word, from 0), ``length`` and ``items``: occurrences of windows in texts. Equal
    texts have one entry, so that copies of a contaminated text are looked at once after the first join.
    """
    bench = cut(windows_of(benchmark, item_text, item_key))
    lengths = sorted(r[0] for r in bench.select("length").distinct().collect())  # ten at most
    hashes = F.transform(item_words(F.col(text)), lambda w: F.xxhash64(w))
    bound = docs.select("*", _digest(F.col(text)).alias("__tw_digest"), hashes.alias("__tw_hashes"))
    none = F.array().cast("array<struct<h:bigint,p:int,n:int>>")

    def marked(n: int) -> Column:
        found = F.transform(winnowed(F.col("__tw_hashes"), n), lambda x: F.struct(x["h"].alias("h"), x["p"].alias("p"), F.lit(n).alias("n")))
        return F.coalesce(found, none)

    kept = F.concat(none, *map(marked, lengths))
    carried = [c for c in docs.columns if c != text]
    rows = cut(bound.select(*carried, "__tw_digest", F.size("__tw_hashes").cast("long").alias("__tw_words"), kept.alias("__tw_fps")))

    marks = [
        bench.filter(F.col("length") == n).select(F.explode(winnowed(F.transform(F.split("window", " "), lambda w: F.xxhash64(w)), n)).alias("x")).select(F.col("x.h").alias("h"))
        for n in lengths
    ]
    empty = docs.sparkSession.createDataFrame([], "digest string, at int, length int, items array<string>")
    if not marks:
        return rows, empty
    wanted = marks[0]
    for m in marks[1:]:
        wanted = wanted.unionByName(m)
    wanted = cut(wanted.distinct())
    if wanted.count() <= HIT_ROWS:
        fps = rows.select("__tw_digest", F.explode("__tw_fps").alias("x")).join(F.broadcast(wanted.withColumnRenamed("h", "__h")), F.col("x.h") == F.col("__h"))
    else:  # runs that are common in the corpus are salted
        all_fps = rows.select("__tw_digest", F.explode("__tw_fps").alias("x")).withColumn("h", F.col("x.h"))
        held = cut(all_fps.groupBy("h").agg(F.count(F.lit(1)).alias("held")).join(wanted, "h"))
        fps = join_grouped(all_fps, held, "h", "held", held.agg(F.sum("held")).first()[0] or 0)
    places = fps.groupBy("__tw_digest").agg(F.collect_set(F.struct("x.n", "x.p")).alias("hit"), F.count(F.lit(1)).alias("held"))
    places = small(cut(places), HIT_ROWS)

    again = docs.select(F.col(text).alias("t"), _digest(F.col(text)).alias("__tw_digest")).join(places, "__tw_digest").select("__tw_digest", "hit", item_words(F.col("t")).alias("ws"))
    run = lambda n: F.floor((n + 1) / 2).cast("int")
    around = F.flatten(F.transform("hit", lambda x: F.transform(F.sequence(x["p"] - (x["n"] - run(x["n"])), x["p"]), lambda a: F.struct(x["n"].alias("length"), a.alias("at")))))
    inside = F.filter(F.array_distinct(around), lambda x: (x["at"] >= 0) & (x["at"] + x["length"] <= F.size("ws")))
    spans = F.transform(inside, lambda x: F.struct(x["length"].alias("length"), x["at"].alias("at"), F.array_join(F.slice("ws", x["at"] + 1, x["length"]), " ").alias("window")))
    tried = again.select(F.col("__tw_digest").alias("digest"), F.explode(spans).alias("x")).select("digest", "x.length", "x.at", "x.window")
    return rows, cut(tried.join(small(bench, HIT_ROWS), ["length", "window"]).select("digest", "at", "length", "items").dropDuplicates(["digest", "at", "length"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items`` (long), ``items`` (sorted strings), ``contaminated``.

    A window is ten words in a row of an item, or all words of a shorter one. ``n_hit`` counts the words inside
    any occurrence of a window, ``items`` are the ids of the items whose windows occur. Texts are compared in whole.

    Null and empty texts have no words, in either table. Rows that repeat, or share a doc_id, have a row each; a null
    doc_id stays null. Items that share an item_id are one item; windows of items with a null id hit, but the
    id is not listed. Empty tables give an empty result, or one without hits. Other columns are ignored.
    """
    rows, found = hits(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark, "text", item_text, item_key)
    ordered = F.sort_array(F.collect_set(F.struct("at", "length")))
    # union of the intervals, in the order of their starts: n words so far, up to place e
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(s["e"], x["at"]))).alias("n"), F.greatest(s["e"], x["at"] + x["length"]).alias("e")
    )
    words_hit = found.groupBy("digest").agg(F.aggregate(ordered, start, step)["n"].cast("long").alias("n_hit"))
    sets = found.select("digest", "items").distinct()
    items = sets.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per_text = small(cut(words_hit.join(items, "digest").withColumnRenamed("digest", "__tw_digest")), HIT_ROWS)
    out = rows.join(per_text, "__tw_digest", "left")
    return out.select(
        "doc_id", F.col("__tw_words").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
