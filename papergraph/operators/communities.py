"""Communities of a weighted graph by modularity, in rounds of moves that do not touch each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.operators.storage import forget, written


def communities(edges: DataFrame, nodes: DataFrame | None = None, min_gain: float = 1e-5) -> DataFrame:
    """node and community, the least node of each: moves for modularity until it no longer rises, then merged communities as nodes again.

    edges are undirected (src, dst, weight); parallel ones add up, loops and edges without weight count for nothing. In a
    round each node looks for the neighbouring community of the largest gain, ties to the smaller, and of the nodes that
    would move a half does, told by a hash. Once such a round adds less than min_gain it is taken back, and only those
    nodes move whose gain is larger than that of every neighbour that would move (equal ones by a hash): no two ends of an
    edge at once, so that modularity rises. A level ends when such a round adds less than min_gain, the whole when
    a level merges nothing or adds less than that. nodes (node) may name nodes without an edge: each is its own community.
    """
    weights = edges.where("src <> dst AND weight > 0").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    links = written(weights.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")), "community-links")
    total = links.agg(F.sum("weight")).first()[0]
    names = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if nodes is not None:
        names = names.union(nodes.where("node IS NOT NULL").select("node")).distinct()
    names = written(names.select("node", F.col("node").alias("community")), "community-names")
    reached = None
    while total:
        state, now, merged = settled(links, total, min_gain)
        if not merged or (reached is not None and now < reached + min_gain):
            break
        reached = now
        old = names, links
        after = names.join(state.toDF("community", "merged"), "community", "left").select("node", F.coalesce("merged", "community").alias("community"))
        names = written(after, "community-names")
        ends = links.join(state.toDF("src", "a"), "src").join(state.toDF("dst", "b"), "dst")
        inner = (F.col("a") == F.col("b")) & (F.col("src") != F.col("dst"))  # a loop has its edges' weight twice
        ends = ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.when(inner, 2 * F.col("weight")).otherwise(F.col("weight")).alias("weight"))
        links = written(ends.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "community-links")
        for table in (*old, state):
            forget(table)
    return names


def settled(links: DataFrame, total: float, min_gain: float) -> tuple[DataFrame, float, bool]:
    """Each node's community (named by its least node) after one level of moves, their modularity, and whether any have merged."""
    both = links.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionAll(links.where("src <> dst").select("dst", "src", "weight"))
    loops = links.where("src = dst").select(F.col("src").alias("node"), "weight", F.col("weight").alias("loop"))
    strength = both.select("node", "weight", F.lit(0.0).alias("loop")).unionAll(loops).groupBy("node")
    state = written(strength.agg(F.sum("weight").alias("k"), F.sum("loop").alias("loop")).select("node", F.col("node").alias("community"), "k", "loop"), "community-state")
    reached, careful, turn = None, False, 0
    kept = look = None
    while True:
        kept, look = look, written(best_moves(both, state, total).withColumn("place", F.struct("gain", F.xxhash64("node", F.lit(turn)).alias("draw"), "node")), "community-moves")
        by = look.groupBy("community").agg(F.sum("k").alias("k"), F.sum(F.col("own") + F.col("loop")).alias("inner"), F.count_if(F.col("to").isNotNull()).alias("moves"))
        now, moves = by.agg(F.sum(F.col("inner") / (2 * total) - F.pow(F.col("k") / (2 * total), 2)), F.sum("moves")).first()
        forget(state)
        over = reached is not None and now < reached + min_gain
        if over and now < reached:  # the last round is taken back
            kept, look, now = look, kept, reached
        if kept is not None:
            forget(kept)
        if not moves or (over and careful):
            break
        careful, reached, turn = careful or over, now, turn + 1
        moving = F.col("to").isNotNull() & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
        rows = look
        if careful:
            would = look.where("to IS NOT NULL").select(F.col("node").alias("other"), F.col("place").alias("rival"))
            rows = look.join(both.join(would, "other").groupBy("node").agg(F.max("rival").alias("rival")), "node", "left")
            moving = F.col("to").isNotNull() & (F.col("rival").isNull() | (F.col("place") > F.col("rival")))
        state = written(rows.select("node", F.when(moving, F.col("to")).otherwise(F.col("community")).alias("community"), "k", "loop"), "community-state")
    state = look
    least = state.groupBy("community").agg(F.min("node").alias("label"))
    named = written(state.join(least, "community").select("node", F.col("label").alias("community")), "community-settled")
    merged = not named.where("node <> community").isEmpty()
    forget(state)
    return named, now, merged


def best_moves(both: DataFrame, state: DataFrame, total: float) -> DataFrame:
    """node, community, k, loop, own (weight of its edges into its community), and to and gain where a move would raise modularity."""
    of = state.groupBy("community").agg(F.sum("k").alias("of"))
    near = both.join(state.select(F.col("node").alias("other"), F.col("community").alias("to")), "other").groupBy("node", "to").agg(F.sum("weight").alias("w"))
    mine = state.join(of, "community")
    seen = near.join(of.toDF("to", "of_to"), "to").join(mine, "node")
    worth = F.round(F.col("w") / total - F.col("k") * F.col("of_to") / (2 * total * total), 14)
    away = F.col("to") != F.col("community")
    best = seen.groupBy("node").agg(
        F.sum(F.when(~away, F.col("w")).otherwise(0.0)).alias("own"),
        F.min_by("to", F.when(away, F.struct((-worth).alias("worth"), F.col("to")))).alias("to"), F.max(F.when(away, worth)).alias("worth"),
    )
    rows = mine.join(best, "node", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    gain = F.round(F.col("worth") - F.col("own") / total + F.col("k") * (F.col("of") - F.col("k")) / (2 * total * total), 12)
    return rows.withColumn("gain", gain).select("node", "community", "k", "loop", "own", F.when(F.col("gain") > 0, F.col("to")).alias("to"), F.when(F.col("gain") > 0, F.col("gain")).alias("gain"))
