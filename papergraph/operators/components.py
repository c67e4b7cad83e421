"""Connected components of an edge table, by rounds of alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.operators.storage import forget, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """A row (id, component) for each end of an edge; component is the smallest id that it reaches.

    Rounds of large stars (each node's larger neighbours go to its least neighbour) and small stars (each node's
    smaller neighbours go to the least of them) shorten paths until the edges no longer change; the number of edges never
    grows. Edges with a null end, loops and repeated edges change nothing; an id that only has a loop gets no row.
    An empty table gives an empty result; other columns are not read. The ids must be of one orderable type.
    """
    current = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    current = written(current.distinct(), "components")
    seen = None
    for _ in range(max_rounds):
        both = current.union(current.select("v", "u")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, current = current, written(small, "components")
        forget(before)
        now = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(current.select(F.col("v"), F.col("v")).distinct())
