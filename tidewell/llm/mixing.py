"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Documents fall into cells (source, language, topic). The cells' token masses are raked: one
margin after the other is scaled to its target shares until all margins agree. The ratio of a
cell's raked mass to its own, scaled to a budget, is the probability with which each of its documents
is sampled, by a seeded hash of its id; cells that reach 1 stay there while the others are raked again.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, cut, small, unit_interval

MARGINS = ("source", "lang", "topic")
#: Target shares by default: shares of tokens to this power, normalised; under 1 it lifts small groups.
TEMPERATURE = 0.7
#: Share of all tokens to sample.
KEEP = 0.8
#: Share of a value's tokens that default targets ask for at most; near 1 few tables of probabilities are left, and raking is slow.
HEADROOM = 0.9
TOLERANCE, MAX_ROUNDS = 1e-3, 100
#: Rounds of raking between two writes, which also give the gap that is left.
BATCH = 4
#: Rounds end with a warning, too, where so many in a row don't bring the gap under this share of the least before.
STALL_ROUNDS, STALLED = 4, 0.999


def form_topic(text: Column) -> Column:
    """Stand-in for tables without a topic column: the form of a text. Callers name a column by ``topic``."""
    lines = F.regexp_count(text, F.lit("\n")) + 1
    tokens = F.regexp_count(text, F.lit(WORD))
    return (
        F.when(tokens == 0, "empty")
        .when(F.regexp_count(text, F.lit(r"\|")) * 4 > tokens, "table")
        .when(tokens < lines * 5, "list")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("book")
    )


def _cells(docs: DataFrame, topic: str | None, seed: int, key: str, text: str) -> list[Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__tw_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__tw_lang"),
        (F.coalesce(F.col(topic).cast("string"), F.lit("")) if topic else form_topic(t)).alias("__tw_topic"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("__tw_tokens"),
        unit_interval(F.lit(seed), F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long"))).alias("__tw_u"),
    ]


def _factors(rows: DataFrame, wanted: dict[str, float]) -> dict[str, float]:
    """Per margin the factor f at which the sum of least(cap, f * m) over its values is ``wanted``, at most the sum of caps.

    ``rows``: ``margin``, ``m``, ``cap``, cut already. The values that f caps are found in rounds: each caps more of them and so raises
    f, until none is added. A round is one grouped sum, so a margin may have millions of values.
    """
    found: dict[str, float] = {}
    while True:
        f = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in found.items() for x in (k, float(v))]), F.col("margin")), F.lit(-1.0)) if found else F.lit(-1.0)
        capped = f * F.col("m") >= F.col("cap")
        sums = rows.groupBy("margin").agg(F.sum(F.when(capped, 0.0).otherwise(F.col("m"))).alias("free"), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("held"), F.max("m").alias("most")).collect()
        now = {r["margin"]: max(0.0, wanted[r["margin"]] - r["held"]) / r["free"] if r["free"] else math.inf for r in sums}
        if all(now[k] <= found.get(k, -1.0) * (1 + 1e-12) or now[k] == math.inf for k in now):
            return {k: min(found.get(k, now[k]), 1e300) if now[k] != math.inf else 1e300 for k in now}
        found = {k: max(v, found.get(k, -1.0)) if v != math.inf else 1e300 for k, v in now.items()}


def tempered_targets(cells: DataFrame, temperature: float = TEMPERATURE, keep: float = KEEP, repeats: float = 1.0) -> dict[str, DataFrame]:
    """Per margin ``value``, ``share``: natural token shares to the power ``temperature``, as far as a sample
    of the share ``keep`` of all tokens can have them: a value with too few tokens gets HEADROOM of them (times
    ``repeats``), and the others share the rest in proportion."""
    tokens, most = F.sum("tokens").cast("double"), max(keep, HEADROOM) * repeats
    parts = [cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.pow(tokens, F.lit(temperature)).alias("m"), (tokens * most).alias("cap")) for m in MARGINS]
    rows = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    f = _factors(rows, dict.fromkeys(MARGINS, total * keep))
    goal = lambda m: F.least("cap", F.col("m") * f.get(m, 0.0))
    sums = {m: rows.filter(F.col("margin") == m).agg(F.sum(goal(m))).first()[0] or 1.0 for m in MARGINS}
    return {m: rows.filter(F.col("margin") == m).select("value", (goal(m) / sums[m]).alias("share")) for m in MARGINS}


def _gathered(cells: DataFrame, rows: int = 100_000) -> DataFrame:
    """Cells, which are cut already, in one partition if they are few: windows over them then need no shuffle."""
    return cells.coalesce(1) if cells.count() <= rows else cells


class _Rounds:
    """Whether raking goes on: ``gap`` is the largest gap of a margin, relative to its target, after each round."""

    def __init__(self):
        self.done, self.stalled, self.gap, self.least = 0, 0, math.inf, math.inf  # done: batches

    def go_on(self) -> bool:
        if self.gap < TOLERANCE:
            return False
        self.stalled = self.stalled + 1 if self.done and self.gap > STALLED * self.least else 0
        if self.done * BATCH >= MAX_ROUNDS or self.stalled >= STALL_ROUNDS:
            warnings.warn(f"raking ended after {self.done * BATCH} rounds; a margin is off its target by {self.gap:.2%}", stacklevel=3)
            return False
        self.done, self.least = self.done + 1, min(self.least, self.gap)
        return True


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` (margins, ``tokens``) with ``mass``, whose margins have the target shares, which are kept as ``share_<margin>``.

    Each step divides by the sum of a margin's value over its cells. Documents were summed up to cells
    before, so a value has at most as many rows as the other margins have combinations, and
    Spark's window spills where they don't fit. BATCH rounds are one plan. Rounds go on until every margin is within TOLERANCE
    of its target; where a round gains nothing any more or MAX_ROUNDS are done (targets that contradict each
    other or the empty cells can't all be met), a warning gives the remaining gap. Cells of values that a target lacks are left
    out; those of a value whose share is 0 get no mass.
    """
    state = cells
    for margin, goal in targets.items():
        state = state.join(goal.select(F.col("value").alias(margin), F.col("share").alias(f"share_{margin}")), margin)
    state = _gathered(cut(state.withColumn("mass", F.col("tokens").cast("double"))))
    total = state.agg(F.sum("mass")).first()[0] or 0.0
    rounds = _Rounds()
    while rounds.go_on():
        for margin in list(targets) * BATCH:
            held = F.sum("mass").over(Window.partitionBy(margin))  # 0 where the target is
            state = state.withColumn(f"factor_{margin}", F.when(held > 0, F.col(f"share_{margin}") * total / held).otherwise(1.0))
            state = state.withColumn("mass", F.col("mass") * F.col(f"factor_{margin}"))
        state = cut(state)
        rounds.gap = state.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(f"factor_{m}") - 1) for m in targets]))).first()[0] or 0.0
    return state.select(*cells.columns, "mass", *[f"share_{m}" for m in targets])


def _least_factor(wanted: Column, value: str, cap: str, by: list[str], ties: list[str]) -> Column:
    """The factor f per group at which the sum of least(cap, f * value) is ``wanted``, at most the sum of caps.

    With the rows that f caps first in order, each prefix of capped rows gives a lower bound
    of f, and the right one gives f itself."""
    order = Window.partitionBy(*by).orderBy((F.col(value) / F.col(cap)).desc(), *ties)
    held = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double"))
    rest = F.sum(value).over(order.rowsBetween(0, Window.unboundedFollowing))
    return F.when(rest > 0, (wanted - held) / rest)


def _reachable(raked: DataFrame, keep: float, repeats: float) -> DataFrame:
    """``margin``, ``value``, ``want``, ``cap``, ``goal``: tokens to sample of each value. Values with fewer tokens than their share
    of the sample give all, the others share what they leave in proportion to the targets."""
    parts = [raked.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("mass").alias("m"), (F.sum(F.col("tokens").cast("double")) * repeats).alias("cap")) for m in MARGINS]
    rows = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    total = raked.agg(F.sum(F.col("tokens").cast("double"))).first()[0] or 0.0
    f = _factors(rows, dict.fromkeys(MARGINS, total * keep))
    at = F.element_at(F.create_map(*[F.lit(x) for k, v in f.items() for x in (k, float(v))]), F.col("margin"))
    return rows.select("margin", "value", F.col("m").alias("want"), "cap", F.least("cap", F.col("m") * at).alias("goal"))


def probabilities(raked: DataFrame, keep: float = KEEP, repeats: float = 1.0) -> DataFrame:
    """Adds ``probability``, which samples the share ``keep`` of all tokens and gives
    probability * tokens the margins of ``mass``: the expected number of copies of a document, ``repeats`` at most.

    Where the scale takes no cell above ``repeats`` it is all that is needed. Else cells that would exceed it are
    held there and the others raked again, until all margins hold. A value that has too few tokens for its
    share of the sample gives all it has, and the others keep their proportions; ``gap`` of :func:`mix` shows it.
    """
    ratio = F.col("mass") / F.col("tokens")
    whole = raked.agg(F.sum("tokens").alias("t"), F.sum("mass").alias("m"), F.max(ratio).alias("a")).first()
    if not whole["t"] or not whole["m"]:
        return raked.withColumn("probability", F.lit(1.0))
    scale = keep * whole["t"] / whole["m"]
    if scale * whole["a"] <= repeats:
        return raked.withColumn("probability", ratio * scale)
    state = raked.withColumn("__tw_x", F.col("mass") * scale).withColumn("__tw_cap", F.col("tokens").cast("double") * repeats)
    goals = cut(_reachable(raked, keep, repeats))
    short = goals.filter(F.col("want") * scale > F.col("cap") * (1 + TOLERANCE)).orderBy((F.col("cap") / F.col("want")).asc(), "margin", "value").limit(5)
    if names := [f"{r[0]} {r[1]}" for r in short.select("margin", "value").collect()]:  # five at most, for the message alone
        warnings.warn(f"targets out of reach with {repeats:g} copies of a document, sampled whole: {names}", stacklevel=2)
    for margin in MARGINS:
        state = state.join(goals.filter(F.col("margin") == margin).select(F.col("value").alias(margin), F.col("goal").alias(f"goal_{margin}")), margin)
    state = _gathered(cut(state))
    sampled = F.least("__tw_cap", "__tw_x")
    rounds = _Rounds()
    while rounds.go_on():
        for margin in MARGINS * BATCH:
            # the sum of caps may come out a little smaller in another order
            wanted = F.least(F.col(f"goal_{margin}"), F.sum("__tw_cap").over(Window.partitionBy(margin)))
            state = state.withColumn("__tw_f", _least_factor(wanted, "__tw_x", "__tw_cap", [margin], list(MARGINS)))
            state = state.withColumn("__tw_x", F.col("__tw_x") * F.coalesce(F.max("__tw_f").over(Window.partitionBy(margin)), F.lit(1.0)))
        state = cut(state.select(*raked.columns, "__tw_x", "__tw_cap", *[f"goal_{m}" for m in MARGINS]))
        off = [F.abs(F.sum(sampled).over(Window.partitionBy(m)) / F.greatest(F.col(f"goal_{m}"), F.lit(1e-9)) - 1) for m in MARGINS]
        rounds.gap = state.select(F.when(F.col("__tw_x") > 0, F.greatest(*off)).alias("off")).agg(F.max("off")).first()[0] or 0.0
    return state.withColumn("probability", repeats * sampled / F.col("__tw_cap")).select(*raked.columns, "probability")


def _with_gap(table: DataFrame) -> DataFrame:
    """Adds ``gap``: how far the sampled share of one of a cell's values is from its target, relative to that, at most."""
    total = table.agg(F.sum(F.col("probability") * F.col("tokens"))).first()[0] or 0.0
    reached = lambda m: F.sum(F.col("probability") * F.col("tokens")).over(Window.partitionBy(m)) / F.lit(total or 1.0)
    return table.withColumn("gap", F.greatest(*[F.when(F.col(f"share_{m}") > 0, F.abs(reached(m) / F.col(f"share_{m}") - 1)).otherwise(F.lit(0.0)) for m in MARGINS]))


def margin_gaps(table: DataFrame) -> DataFrame:
    """``margin``, ``value``, ``target``, ``reached``: shares of tokens that a table of
    :func:`probabilities` was to have and that it samples, a row a value of a margin."""
    parts = [
        table.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("mass").alias("target"), F.sum(F.col("probability") * F.col("tokens")).alias("reached"))
        for m in MARGINS
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    share = lambda c: (F.col(c) / F.sum(c).over(Window.partitionBy("margin"))).alias(c)
    return rows.select("margin", "value", share("target"), share("reached"))


def mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, keep: float = KEEP, topic: str | None = None,
            key: str = "doc_id", text: str = "text", repeats: float = 1.0) -> DataFrame:
    """:func:`margin_gaps` of the mix of ``docs``: the residual after raking, a row a value of a margin."""
    cells = docs.select(*_cells(docs, topic, 0, key, text))
    return margin_gaps(cut(_probabilities(cells, targets, temperature, keep, repeats)))


def _probabilities(slim: DataFrame, targets: dict[str, DataFrame] | None, temperature: float, keep: float, repeats: float) -> DataFrame:
    cells = cut(
        slim.groupBy(*[F.col(f"__tw_{m}").alias(m) for m in MARGINS])
        .agg(F.sum("__tw_tokens").alias("tokens"))
        .filter("tokens > 0")
    )
    return probabilities(rake(cells, targets or tempered_targets(cells, temperature, keep, repeats)), keep, repeats)


def _probability_table(slim: DataFrame, targets: dict[str, DataFrame] | None, temperature: float, keep: float, repeats: float) -> DataFrame:
    table = _with_gap(cut(_probabilities(slim, targets, temperature, keep, repeats)))
    return table.select(*[F.col(m).alias(f"__tw_{m}") for m in MARGINS], F.col("probability").alias("__tw_p"), F.col("gap").alias("__tw_gap"))


def _copies(p: Column) -> Column:
    """So many whole copies, and one more with the probability of the rest."""
    return (F.floor(p) + (F.col("__tw_u") < p - F.floor(p)).cast("long")).cast("int")


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, keep: float = KEEP, topic: str | None = None,
    seed: int = 29, key: str = "doc_id", text: str = "text", repeats: float = 1.0,
) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``,
    ``probability``, ``weight`` (its inverse), ``kept``, ``copies``, ``gap``.

    ``targets``: per margin a table (value, share); shares of a margin add up to 1, values it
    lacks are left out of the mix. Tokens are words. Null sources, languages and topics count
    as the empty string; null and empty texts have no tokens, so probability 0, and are not
    kept. The choice depends on seed and doc_id alone, so repeated rows are kept or left
    together; rows with a null doc_id share one draw. An empty table gives an empty result.

    With ``repeats`` above 1, a document may be taken several times: ``probability`` is then the expected number of ``copies``.
    ``gap`` is the largest relative gap between the share of tokens that the document's source, language or topic was
    to have and the expected share in the sample: where raking could not meet the targets, its rows say so.
    """
    slim = cut(docs.select(F.col(key).cast("long").alias("doc_id"), *_cells(docs, topic, seed, key, text)))
    on = [f"__tw_{m}" for m in MARGINS]
    out = slim.join(_probability_table(slim, targets, temperature, keep, repeats), on, "left")
    p = F.coalesce("__tw_p", F.lit(0.0))
    return out.select(
        "doc_id", *[F.col(c).alias(m) for c, m in zip(on, MARGINS, strict=True)], F.col("__tw_tokens").alias("n_tokens"),
        p.alias("probability"), F.when(p > 0, 1 / p).alias("weight"), (_copies(p) > 0).alias("kept"), _copies(p).alias("copies"), F.coalesce("__tw_gap", F.lit(0.0)).alias("gap"),
    )


def mixed_documents(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, keep: float = KEEP, topic: str | None = None,
    seed: int = 29, key: str = "doc_id", text: str = "text", repeats: float = 1.0,
) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` keeps, with all their columns, each as often as it has ``copies``.

    Cells are computed twice from the texts, so that texts are never shuffled when the table
    of probabilities (a row a cell) is small: it is counted, and broadcast up to 100,000 rows.
    """
    cells = _cells(docs, topic, seed, key, text)
    table = small(cut(_probability_table(docs.select(*cells), targets, temperature, keep, repeats)))
    joined = docs.select(F.struct(*docs.columns).alias("__tw_row"), *cells).join(table, [f"__tw_{m}" for m in MARGINS])
    if repeats <= 1:
        return joined.filter(_copies(F.col("__tw_p")) > 0).select("__tw_row.*")
    return joined.select("__tw_row", F.explode(F.array_repeat(F.lit(0), _copies(F.col("__tw_p"))))).select("__tw_row.*")
