"""State machines that replay an event log in order.

A machine's next state depends on its last one, so the events of a key are folded one by one. The
log is dealt by key and sorted; a task folds its keys as the rows stream by and holds one state and one
batch, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import ordered


def ordered_fold(log: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """Rows of the log with the columns that ``step`` returns for the state and each event.

    ``step`` changes the state it is given and returns the event's output columns.
    ``schema``: ``key``, ``order`` and those columns, as DDL.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        for batch in batches:
            out = []
            for event in batch.to_dict("records"):
                if event[key] != current:
                    current, state = event[key], start()
                out.append({key: event[key], **{c: event[c] for c in order}, **step(state, event)})
            if out:
                yield pd.DataFrame(out)

    return log.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def breaker_step(threshold: int = 5, cooldown: int = 300) -> Callable[[dict, dict], dict]:
    """Circuit breaker and backoff. Events: ``seconds``, ``outcome`` (success, rate_limit, forbidden, other)."""

    def step(state: dict, event: dict) -> dict:
        if state["circuit"] == "open" and event["seconds"] - state["opened"] >= cooldown:
            state["circuit"] = "half_open"
        blocked = state["circuit"] == "open"
        if not blocked:
            if event["outcome"] == "success":
                state["failures"] = 0
                state["backoff"] = max(1.0, state["backoff"] - 0.1)
                if state["circuit"] == "half_open":
                    state["circuit"], state["opened"] = "closed", 0
            else:
                state["failures"] += 1
                if event["outcome"] in ("rate_limit", "forbidden"):
                    state["backoff"] = min(5.0, state["backoff"] * 1.5)
                if state["failures"] >= threshold:
                    state["circuit"], state["opened"] = "open", event["seconds"]
        return {"blocked": blocked, "circuit": state["circuit"], "failures": state["failures"], "backoff": round(state["backoff"], 6)}

    return step


def breaker_start() -> dict:
    return {"circuit": "closed", "opened": 0, "failures": 0, "backoff": 1.0}


def replay_breaker(log: DataFrame, threshold: int = 5, cooldown: int = 300) -> DataFrame:
    """``domain``, ``seconds``, ``request_id`` with the breaker's state after each request."""
    schema = "domain string, seconds long, request_id long, blocked boolean, circuit string, failures int, backoff double"
    return ordered_fold(log, "domain", ["seconds", "request_id"], breaker_start, breaker_step(threshold, cooldown), schema)


def replay_budget(log: DataFrame, base: int = 5) -> DataFrame:
    """Simulated requests let through: blocked once the hour's count exceeds max(30 % of direct ones, base).

    ``log``: ``domain``, ``hour``, ``request_id``, ``simulated``. One more than the maximum passes, as the
    count is compared before it grows.
    """

    def step(state: dict, event: dict) -> dict:
        if state.get("hour") != event["hour"]:
            state.update(hour=event["hour"], direct=0, simulated=0)
        if not event["simulated"]:
            state["direct"] += 1
            return {"allowed": True, "used": state["simulated"]}
        allowed = state["simulated"] <= max(int(state["direct"] * 0.30), base)
        state["simulated"] += allowed
        return {"allowed": allowed, "used": state["simulated"]}

    return ordered_fold(log, "domain", ["hour", "request_id"], dict, step, "domain string, hour string, request_id long, allowed boolean, used int")


def replay_providers(log: DataFrame) -> DataFrame:
    """Provider states. ``log``: ``provider``, ``seq``, ``outcome`` (success, probe_ok, or the state an error puts it in)."""

    def step(state: dict, event: dict) -> dict:
        if event["outcome"] == "probe_ok":
            state.update(state="available", failures=0)
        elif event["outcome"] == "success":
            state["failures"] = 0 if state["state"] == "available" else state["failures"]
        else:
            state.update(state=event["outcome"], failures=state["failures"] + 1)
        return dict(state)

    return ordered_fold(log, "provider", ["seq"], lambda: {"state": "available", "failures": 0}, step, "provider string, seq long, state string, failures int")


def running_mean(log: DataFrame, key: str, order: list[str], value: str, value_type: str = "long") -> DataFrame:
    """The truncated running mean int((mean (n - 1) + x) / n), which depends on the order."""

    def step(state: dict, event: dict) -> dict:
        state["n"] = state.get("n", 0) + 1
        state["mean"] = int((state.get("mean", 0) * (state["n"] - 1) + event[value]) / state["n"])
        return {"n": state["n"], "mean": state["mean"]}

    schema = ", ".join(f"{c} {log.schema[c].dataType.simpleString()}" for c in (key, *order))
    return ordered_fold(log, key, order, dict, step, f"{schema}, n long, mean {value_type}")


def retry_action(attempts: DataFrame, most: int = 3) -> DataFrame:
    """What follows each attempt: ``done``, ``cached`` (304), ``stop`` (403, 404, other 4xx), ``retry`` or ``give_up``."""
    s = F.col("status")
    passing = (s == 429) | (s >= 500) | (s == 0)  # 0: timed out
    action = F.when(s == 304, "cached").when((s >= 200) & (s < 400), "done").when(passing, F.when(F.col("attempt") < most, "retry").otherwise("give_up")).otherwise("stop")
    return attempts.withColumn("action", action)


def penalties(log: DataFrame, minutes: int = 15) -> DataFrame:
    """Until when a domain is penalised: the last 429 or 403 plus a window."""
    hit = log.filter(F.col("status").isin(429, 403))
    return hit.groupBy("domain").agg((F.max("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("until"), F.count(F.lit(1)).alias("hits"))


def rate_violations(log: DataFrame, per_minute: int) -> DataFrame:
    """Requests that find more than ``per_minute`` of their domain in the last minute."""
    return ordered.sliding_counts(log, "domain", "ts", 60).filter(F.col("in_window") > per_minute)


def cached_response(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with what the cache held of their URL at their time: ``fresh``, ``revalidate`` or ``miss``.

    ``cache``: a row each time that an entry was stored or validated (``url_hash``, ``validated_at``, ``expires_at``, ``etag``). The last one
    at or before the request counts; of two at one time, the one that expires last.
    """
    held = cache.select("url_hash", "validated_at", "expires_at", "etag")
    joined = ordered.as_of(requests, held, "url_hash", "ts", "validated_at", ["expires_at", "etag"])
    e = F.col("found")
    state = F.when(e.isNull(), "miss").when(e["expires_at"] > F.col("ts"), "fresh").when(e["etag"].isNotNull(), "revalidate").otherwise("miss")
    return joined.select(*requests.columns, state.alias("cache"))
