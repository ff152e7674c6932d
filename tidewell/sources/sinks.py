"""Sinks: idempotent writes of the operators' results, and table copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import canonical_hash
from tidewell.operators.tables import new_rows


def append_new(items: DataFrame, path: str, partition: str = "day") -> DataFrame:
    """Append items whose identity is new at ``path`` (Parquet by day); returns what was stored."""
    spark = items.sparkSession
    keyed = items.withColumn("canonical_hash", canonical_hash(F.col("title"), F.col("url")))
    keyed = keyed.withColumn(partition, F.to_date("collected_at"))
    try:
        history = spark.read.parquet(path).select("canonical_hash")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        history = keyed.select("canonical_hash").limit(0)
    stored = new_rows(keyed, history, "canonical_hash", [F.col("collected_at"), F.col("external_id")])
    stored.write.mode("append").partitionBy(partition).parquet(path)
    return stored


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Rewrite just the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def copy_table(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, target: str) -> None:
    """Copy a database table by ranges of its key, the parts in parallel; the target is replaced."""
    rows = spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    rows.write.mode("overwrite").parquet(target)


def seeded(seeds: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The table and those seed rows whose key it lacks."""
    return table.unionByName(seeds.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def parsed_counters(counters: DataFrame) -> DataFrame:
    """Counters (``name`` of five parts, ``value``) as a row a domain and hour, a column a counter."""
    parts = F.split("name", ":")
    rows = counters.filter(F.size(parts) == 5).select(parts[2].alias("domain"), F.try_to_timestamp(parts[3], F.lit("yyyy-MM-dd-HH")).alias("hour"), parts[4].alias("counter"), "value")
    return rows.groupBy("domain", "hour").pivot("counter", ["direct_requests", "simulated_requests", "fallback_requests", "budget_blocked"]).agg(F.sum("value"))
