"""Upserts, retention, set operations and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.shipping import map_arrow


def new_rows(incoming: DataFrame, history: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Incoming rows whose key is new, the first of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    first = incoming.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    return first.join(history.select(key), key, "left_anti")


def run_counts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: fetched, stored and duplicate items of a run."""
    a, b = incoming.agg(F.count(F.lit(1)).alias("fetched")), stored.agg(F.count(F.lit(1)).alias("stored"))
    return a.crossJoin(b).withColumn("deduped", F.col("fetched") - F.col("stored"))


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The current rows with the last change of each key applied."""
    names = [c for c in current.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in names if c != order])).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in names])
    return current.join(last.select(*keys), keys, "left_anti").select(*keys, *names).unionByName(last)


def updated(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Columns of the rows that match set anew; the others stay."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def retained(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows that are not older than ``days``, and those without a time; all of them for -1."""
    return df if days < 0 else df.filter(F.col(column).isNull() | (F.col(column) >= now - F.make_interval(days=F.lit(days))))


def retention_counts(items: DataFrame, children: dict[str, tuple[DataFrame, str]], column: str, now: Column, days: int) -> DataFrame:
    """One row: rows that retention removes from the items and from the tables that hang on them."""
    old = items.join(retained(items, column, now, days).select("id"), "id", "left_anti").select("id")
    out = old.agg(F.count(F.lit(1)).alias("items"))
    for name, (child, key) in children.items():
        out = out.crossJoin(child.join(old, child[key] == old["id"], "left_semi").agg(F.count(F.lit(1)).alias(name)))
    return out


def missing_child(items: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Items without a child row of any status."""
    return items.join(child.select(F.col(key).alias("id")), "id", "left_anti")


def keyset_batch(df: DataFrame, last_id: int, size: int) -> DataFrame:
    return df.filter(F.col("id") > last_id).orderBy("id").limit(size)


def full_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys by side: ``a``, ``b`` or ``both``."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_a").isNull(), "b").when(F.col("in_b").isNull(), "a").otherwise("both")
    return left.join(right, key, "full_outer").select(key, side.alias("side"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors scaled to length 1; zero vectors stay."""
    out = df.withColumn("__norm", norm(F.col(column)))
    return out.withColumn(column, F.when(F.col("__norm") > 0, F.transform(column, lambda x: x.cast("double") / F.col("__norm"))).otherwise(F.transform(column, lambda x: x.cast("double")))).drop("__norm")


#: Vectors and queries of a block, in expectation; queries that a task compares at once.
VECTOR_BLOCK, QUERY_BLOCK, QUERY_STEP = 4096, 512, 32


def best_of(cosine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest finite values, of equal ones those of smaller ids, in order."""
    held = np.where(np.isfinite(cosine), cosine, -np.inf)
    least = np.partition(held, held.shape[1] - min(k, held.shape[1]), axis=1)[:, -min(k, held.shape[1]), None]
    row, at = np.nonzero((held >= least) & (held > -np.inf))
    order = np.lexsort((ids[at], -held[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k]


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar vectors of each query. ``queries``: a stated set of rows, of any size; zero vectors are like none.

    Both sides are dealt into blocks of bounded size; a task multiplies one pair of blocks and keeps the best ``k`` of each
    query, so that a query has k rows a block of vectors when these are ranked. The pairs are joined by a shuffle: Spark takes
    the queries' size from before they are repeated for each block of vectors, and would send all repeats through the driver.
    """
    n, m = vectors.count(), queries.count()
    parts, asked = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))

    def blocks(df: DataFrame, of: int, name: str) -> DataFrame:
        rows = normalized(df).select(F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int").alias(name), F.struct("vec_id", "embedding").alias("r"))
        return rows.groupBy(name).agg(F.collect_list("r").alias(f"{name}_rows"))

    right = blocks(queries, asked, "q").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = blocks(vectors, parts, "v").join(right.hint("merge"), "v").select("v_rows", "q_rows")

    def unpacked(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray]:
        rows = column.slice(row, 1).flatten()
        ids = rows.field("vec_id").to_numpy()
        return ids, rows.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                ids, v = unpacked(batch.column(0), pair)
                asked_ids, q = unpacked(batch.column(1), pair)
                for first in range(0, len(q), QUERY_STEP):
                    some = asked_ids[first : first + QUERY_STEP]
                    cosine = np.round(q[first : first + QUERY_STEP] @ v.T, 6)
                    cosine[some[:, None] == ids[None, :]] = -np.inf
                    row, at = best_of(cosine, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(some[row]), pa.array(ids[at]), pa.array(cosine[row, at])], names=["query_id", "vec_id", "cosine"])

    best = map_arrow(pairs, run, "query_id long, vec_id long, cosine double", 1)
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
