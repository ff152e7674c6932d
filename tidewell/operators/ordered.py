"""Work in the order of (key, time) without a task that holds all rows of a key.

Rows are sorted by ranges of key and time and written, so that a hot key's rows lie in many runs. Within a run, windows find
what a row needs of the rows before it; what a run hands on is one row: the last entry, and the
count of its last key. These, a row a run, are summed up in order and handed to the run behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.lineage import cut

RUN = "__tw_run"


def in_runs(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted by ``order`` in written ranges, numbered in ``__tw_run``; nulls first.

    Ranges follow a sample of the rows, so they are even whatever the keys; rows equal in ``order`` stay in one.
    """
    columns = [F.col(c).asc_nulls_first() for c in order]
    return cut(df.repartitionByRange(*columns).withColumn(RUN, F.spark_partition_id()))


def _handed_on(per_run: DataFrame, value: Column, name: str) -> DataFrame:
    """``__tw_run`` and what the runs before it hand on: the greatest ``value`` among them. A row a run."""
    before = Window.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(cut(per_run.select(RUN, F.max(value).over(before).alias(name))))


def last_before(runs: DataFrame, key: str, order: list[str], entry: Column) -> DataFrame:
    """Adds ``found``: the last ``entry`` that is not null at or before a row of the same key, in the order that ``runs`` are in."""
    w = Window.partitionBy(RUN, key).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("__tw_entry", entry)
    place = F.struct(key, *order, F.col("__tw_entry").alias("__tw_e"))
    per_run = marked.groupBy(RUN).agg(F.max(F.when(F.col("__tw_entry").isNotNull(), place)).alias("m"))
    carried = _handed_on(per_run, F.col("m"), "__tw_carried")
    local = F.last("__tw_entry", ignorenulls=True).over(w)
    out = marked.withColumn("__tw_local", local).join(carried, RUN, "left")
    own = F.col("__tw_carried")[key].eqNullSafe(F.col(key)) & F.col("__tw_carried").isNotNull()
    return out.withColumn("found", F.coalesce("__tw_local", F.when(own, F.col("__tw_carried.__tw_e")))).drop("__tw_entry", "__tw_local", "__tw_carried")


def running_sums(runs: DataFrame, key: str, order: list[str], amount: Column) -> DataFrame:
    """Adds ``sum_so_far``: the sum of ``amount`` over the rows of a key up to each row."""
    w = Window.partitionBy(RUN, key).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("__tw_amount", amount)
    # a run hands on the sum of its last key; runs that a key fills are next to each other
    per_key = marked.groupBy(RUN, key).agg(F.sum("__tw_amount").alias("s"))
    ends = per_key.groupBy(RUN).agg(F.max(F.struct(F.col(key).alias("k"), F.col("s").alias("s"))).alias("tail"), F.count(F.lit(1)).alias("keys"))
    ends = cut(ends)  # a row a run
    far = ends.select(RUN, F.col("tail.k").alias("k"), F.sum("tail.s").over(Window.partitionBy("tail.k").orderBy(RUN)).alias("up_to"))
    previous = Window.orderBy(RUN)
    handed = far.select(RUN, F.lag(F.struct("k", "up_to")).over(previous).alias("__tw_handed"))
    joined = marked.withColumn("__tw_local", F.sum("__tw_amount").over(w)).join(F.broadcast(cut(handed)), RUN)
    carried = F.when(F.col("__tw_handed.k").eqNullSafe(F.col(key)) & F.col("__tw_handed").isNotNull(), F.col("__tw_handed.up_to")).otherwise(0)
    return joined.withColumn("sum_so_far", F.col("__tw_local") + carried).drop("__tw_amount", "__tw_local", "__tw_handed")


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, tie: list[str] | None = None) -> DataFrame:
    """``left`` with ``found``, the struct of ``right``'s last row of the same key at or before ``left_ts``; null if there is none.

    Of right rows of one time the one greatest in ``tie`` (all columns by default) counts. Rows without a key or a time find nothing,
    and right rows without one are never found. Rows of ``left`` stay as they are, repeats included.
    """
    entry = F.struct(*right.columns)
    names = tie or sorted(right.columns)
    events = left.select(F.col(key).alias("__k"), F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*names).alias("x")).schema["x"].dataType).alias("__tie"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(entry.alias("x")).schema["x"].dataType).alias("__entry"))
    rows = right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
    found = rows.select(F.col(key).alias("__k"), F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.struct(*names).alias("__tie"), F.lit(None).cast(events.schema["__row"].dataType).alias("__row"), entry.alias("__entry"))
    runs = in_runs(events.unionByName(found), ["__k", "__t", "__side", "__tie"])
    out = last_before(runs, "__k", ["__t", "__side", "__tie"], F.col("__entry")).filter("__side = 1")
    return out.select("__row.*", F.when(F.col("__t").isNotNull(), F.col("found")).alias("found"))


def streaks(rows: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """Adds ``streak``: how many rows without ``ok`` in a row end at each row. A null ``ok`` counts as none."""
    marked = rows.withColumn("__tw_ok", F.coalesce(ok, F.lit(False)))
    numbered = running_sums(in_runs(marked, [key, *order]), key, order, F.lit(1).cast("long")).withColumnRenamed("sum_so_far", "__tw_n")
    last = last_before(numbered, key, order, F.when(F.col("__tw_ok"), F.col("__tw_n")))
    return last.withColumn("streak", F.col("__tw_n") - F.coalesce("found", F.lit(0))).drop("__tw_ok", "__tw_n", "found", RUN)


def sliding_counts(log: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds ``in_window``: rows of the key in the last ``seconds`` before a row's second, that second included.

    Requests are counted by second first; a window is the difference of two running sums, the earlier of which is found as of its
    second. Rows without a key or a time have no count.
    """
    second = F.unix_timestamp(ts)
    each = log.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, second.alias("__sec")).agg(F.count(F.lit(1)).alias("__n"))
    sums = cut(running_sums(in_runs(each, [key, "__sec"]), key, ["__sec"], F.col("__n")).select(key, "__sec", F.col("sum_so_far").alias("__c")))
    asked = sums.withColumn("__from", F.col("__sec") - (seconds + 1))
    windows = as_of(asked, sums, key, "__from", "__sec").select(key, "__sec", (F.col("__c") - F.coalesce(F.col("found.__c"), F.lit(0))).alias("in_window"))
    return log.withColumn("__sec", second).join(windows, [key, "__sec"], "left").select(*log.columns, "in_window")
