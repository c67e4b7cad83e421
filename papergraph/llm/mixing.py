"""Mixing sources to target weights by temperature, with budgets realised as permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.llm.common import partitions, saved

BLOCKS = 64


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares to the power of the exponent, normalised; sources without tokens get none."""
    total = sum(tokens.values())
    raised = {s: (t / total) ** exponent if t else 0.0 for s, t in tokens.items()}
    norm = sum(raised.values())
    return {s: r / norm for s, r in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def epochs_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """How often each source is read, if the one that is read least is read once."""
    weights = weights_at(tokens, exponent)
    rates = {s: weights[s] / t for s, t in tokens.items() if t}
    least = min(rates.values())
    return {s: r / least for s, r in rates.items()}


def solve_exponent(tokens: dict[str, int], max_epochs: float | None = None, target_entropy: float | None = None, evenness: float | None = None) -> float:
    """The exponent in [0, 1] by bisection: the smallest that keeps to max_epochs, or the one whose weights have the entropy.

    An entropy out of reach gives the nearer end. evenness states the entropy between that of the sources as they are (0)
    and that of equal weights (1).
    """
    low, high = 0.0, 1.0
    if sum(x is not None for x in (max_epochs, target_entropy, evenness)) != 1:
        raise ValueError("give one of max_epochs, target_entropy and evenness")
    if evenness is not None:
        ends = entropy(weights_at(tokens, 1.0)), entropy(weights_at(tokens, 0.0))
        target_entropy = ends[0] + evenness * (ends[1] - ends[0])

    def flat_enough(a):
        if max_epochs is not None:
            return max(epochs_at(tokens, a).values()) <= max_epochs
        return entropy(weights_at(tokens, a)) <= target_entropy

    if flat_enough(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if flat_enough(middle) else (middle, high)
    return high


def mix_sources(docs: DataFrame, max_epochs: float | None = 2.0, target_entropy: float | None = None, evenness: float | None = None, seed: str = "mix", source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as its source's budget says, with mix_epoch (from 0), mix_block, mix_position (from 0),
    mix_weight, mix_budget and mix_tokens: the weight of the row's source, the tokens that it asks for and those it gets.

    A row's tokens are its words. The budget of a source is its weight times the tokens of the whole mix, which is sized
    so that every source is read once at least: no row is lost. A source's rows are dealt by a hash of id and text into
    BLOCKS blocks; each epoch puts the blocks in an order of its own (mix_position: the place of
    the row's block in it), and the last, unfinished epoch takes the blocks
    whose tokens, in that order, end within the budget (of those that remain, the one that the budget cuts is taken
    if at least half of it fits). Only totals for each source and block are gathered, and joined back by source and block.

    A null source is a source of its own. Null and empty texts have one token, so that sources of such rows can be
    weighted. Repeated rows stay and go together. An empty table gives an empty result; columns of docs that are named
    like the new ones are replaced. The number of sources must fit on the driver: a row for each, nothing for each document.
    """
    added = ("mix_epoch", "mix_block", "mix_position", "mix_weight", "mix_budget", "mix_tokens")
    kept = [c for c in docs.columns if c not in added]
    words = F.greatest(F.size(F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"\s+"), lambda w: w != "")), F.lit(1)).cast("long")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(BLOCKS)).cast("int")
    dealt = docs.select(*[F.col(f"`{c}`") for c in kept], block.alias("mix_block"))
    totals = docs.select(F.col(f"`{source_col}`").alias("_source"), block.alias("_block"), words.alias("_tokens")).groupBy("_source", "_block").agg(F.sum("_tokens").alias("_tokens"))
    totals = saved(totals, "mix-blocks")
    tokens = {r[0]: r[1] for r in totals.groupBy("_source").agg(F.sum("_tokens")).collect()}
    if not tokens:
        nothing = {"mix_epoch": F.lit(0), "mix_position": F.lit(0), "mix_weight": F.lit(0.0), "mix_budget": F.lit(0.0), "mix_tokens": F.lit(0).cast("long")}
        return dealt.withColumns(nothing).select(*kept, *added)
    exponent = solve_exponent(tokens, max_epochs, target_entropy, evenness)
    weights, epochs = weights_at(tokens, exponent), epochs_at(tokens, exponent)
    plan = docs.sparkSession.createDataFrame(
        [(s, float(weights[s]), float(epochs[s] * tokens[s]), int(epochs[s] + 1e-9), float((epochs[s] + 1e-9) % 1 * tokens[s])) for s in tokens],
        "_source string, mix_weight double, mix_budget double, _whole int, _left double",
    )
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), "_source", "_whole", "_block"), "_block")
    planned = totals.join(plan, totals["_source"].eqNullSafe(plan["_source"])).select(totals["_source"], "_block", "_tokens", "mix_weight", "mix_budget", "_whole", "_left")
    planned = planned.withColumn("_upto", F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    planned = planned.select("_source", "_block", "_tokens", "mix_weight", "mix_budget", (F.col("_whole") + (F.col("_upto") - F.col("_tokens") / 2 <= F.col("_left")).cast("int")).alias("_times"))
    read = F.sum(F.col("_tokens") * F.col("_times")).over(Window.partitionBy("_source"))
    planned = planned.select("_source", "_block", "_times", "mix_weight", "mix_budget", read.alias("mix_tokens"))
    planned = planned.select("_source", "_block", "mix_weight", "mix_budget", "mix_tokens", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("mix_epoch"))
    inside = Window.partitionBy("_source", "mix_epoch").orderBy(F.xxhash64(F.lit(seed), "_source", "mix_epoch", "_block"), "_block")
    planned = planned.withColumn("mix_position", F.row_number().over(inside) - 1)
    # BLOCKS rows for each source and epoch: broadcast while that is small, which a look at the number of sources settles.
    side = F.broadcast(planned) if sum(math.ceil(e) for e in epochs.values()) * BLOCKS <= 500_000 else planned
    met = dealt.alias("d").join(side.alias("s"), F.col(f"d.`{source_col}`").eqNullSafe(F.col("s._source")) & (F.col("d.mix_block") == F.col("s._block")))
    return met.select(*[F.col(f"d.`{c}`") for c in kept], "s.mix_epoch", "d.mix_block", "s.mix_position", "s.mix_weight", "s.mix_budget", "s.mix_tokens")
