"""Status changes of items: skip marks, outcomes of translations, retries of failed rows, probes and backoff."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.policy import ordered_fold
from tidewell.operators.tables import updated


def outcome_status(has_result: Column, engine: Column, success: Column) -> Column:
    """Status that a translation's outcome gives; null leaves the row pending, as all engines are down."""
    return (
        F.when(~has_result, "failed")
        .when(engine.isin("system_stopped", "none_available"), F.lit(None).cast("string"))
        .when(F.coalesce(success, F.lit(False)), "complete")
        .otherwise("failed")
    )


def with_outcomes(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pending items (``id``, ``status``) with the status that their outcome (``id``, ``engine``, ``success``; a row an item) gives."""
    said = outcomes.select("id", F.lit(True).alias("__has"), F.col("engine").alias("__engine"), F.col("success").alias("__success"))
    found = items.join(said, "id", "left")
    new = outcome_status(F.coalesce("__has", F.lit(False)), F.col("__engine"), F.col("__success"))
    changed = F.when(F.col("status") == "pending", F.coalesce(new, F.col("status"))).otherwise(F.col("status"))
    return found.withColumn("status", changed).drop("__has", "__engine", "__success")


def skip_native(items: DataFrame, status: str, prefix: str, copies: dict[str, str], engine: str) -> DataFrame:
    """Pending items whose locale starts with ``prefix`` become skipped: ``copies`` (target: source) are filled, the engine is ``none``."""
    native = (F.col(status) == "pending") & F.col("original_locale").startswith(prefix)
    return updated(items, native, {status: F.lit("skipped"), engine: F.lit("none"), **{t: F.col(s) for t, s in copies.items()}})


def retry_failed_summaries(items: DataFrame) -> DataFrame:
    """Failed summaries start anew: Chinese ones as pending, all others (no language, too) as queued."""
    back = F.when(F.col("lang_group").eqNullSafe(F.lit("zh")), "pending").otherwise("queued")
    return updated(items, F.col("summary_status") == "failed", {"summary_status": back})


def retry_failed_translations(items: DataFrame) -> DataFrame:
    """Failed canonical translations start anew, without title, description and error."""
    empty = {c: F.lit(None).cast("string") for c in ("canonical_title", "canonical_description", "canonical_error")}
    return updated(items, F.col("canonical_status") == "failed", {"canonical_status": F.lit("pending"), **empty})


def retry_due(last_retry: Column, now: Column, seconds: int = 3600) -> Column:
    """Whether the interval between two retries or probes has passed; true before the first."""
    return last_retry.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last_retry) >= seconds)


def learnable(items: DataFrame, since: Column, until: Column) -> DataFrame:
    """Items that keywords are learned from: classified externally, with a category, collected in (since, until]."""
    at = F.col("collected_at")
    return items.filter((at > since) & (at <= until) & (F.col("classified_by") == "llm") & F.col("story_category").isNotNull())


def high_water(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: the largest id, null for an empty table."""
    return df.agg(F.max(key).alias("max_id"))


def replay_probes(log: DataFrame, interval: int = 300) -> DataFrame:
    """Health probes of a provider: at each tick (``provider``, ``seconds``, ``up``) of an unavailable provider a probe runs if
    ``interval`` seconds have passed since the last one; a probe that finds it up makes it available again. A tick with
    ``up`` null is a failed request and makes it unavailable."""

    def step(state: dict, event: dict) -> dict:
        probed = False
        if event["up"] is None:
            state["available"] = False
        elif not state["available"] and event["seconds"] - state["probed"] >= interval:
            probed, state["probed"] = True, event["seconds"]
            state["available"] = bool(event["up"])
        return {"probed": probed, "available": state["available"]}

    return ordered_fold(log, "provider", ["seconds"], lambda: {"available": True, "probed": -(10**12)}, step, "provider string, seconds long, probed boolean, available boolean")


def replay_quota_backoff(log: DataFrame, seconds: int = 1800) -> DataFrame:
    """Batches (``worker``, ``seconds``, ``quota_error``): after a quota error none is sent for ``seconds``."""

    def step(state: dict, event: dict) -> dict:
        sent = event["seconds"] >= state["until"]
        if sent and event["quota_error"]:
            state["until"] = event["seconds"] + seconds
        return {"sent": sent, "blocked_until": state["until"]}

    return ordered_fold(log, "worker", ["seconds"], lambda: {"until": 0}, step, "worker string, seconds long, sent boolean, blocked_until long")


def hashed_embedding(texts: pd.Series, size: int = 384) -> list[list[float]]:
    """The deterministic stand-in for a model: signed counts of hashed words."""
    import zlib

    import numpy as np

    out = np.zeros((len(texts), size))
    for k, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            out[k, h % size] += 1.0 if h >> 31 else -1.0
    return out.tolist()


def embedder(embed: Callable[[pd.Series], list[list[float]]] = hashed_embedding, batch: int = 64):
    """A pandas UDF around a model (texts of a batch -> vectors); vectors are scaled to length 1, zero vectors stay."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for texts in batches:
            found: list = []
            for at in range(0, len(texts), batch):
                v = np.asarray(embed(texts.iloc[at : at + batch]), dtype=float)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                found.extend((v / np.where(length > 0, length, 1.0)).tolist())
            yield pd.Series(found)

    return run
