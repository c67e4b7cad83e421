"""Edges between nodes whose vectors are alike: exact, or through buckets of random planes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.operators.storage import forget, written

#: Rows of a block: a task compares two of them.
BLOCK_ROWS = 2000
#: Pairs of vectors that cost as much as a row in a table: it is hashed, written, dealt and put in a block.
ROW_PAIRS = 5000
#: Pairs of blocks that go to Python at a time.
PAIRS_AT_ONCE = 4
RELATION = "semantic_similarity"


def node_vectors(evidence: DataFrame, vectors: DataFrame) -> DataFrame:
    """node and vector: the mean of the vectors (doc_id, vector) of the distinct documents on a node's outgoing edges (src, doc_id).

    Means of a length below 1e-9, and nodes without a document that has a vector, are left out.
    """
    told = evidence.select(F.col("src").alias("node"), "doc_id").distinct().join(vectors.where("vector IS NOT NULL").select("doc_id", array_to_vector(F.col("vector").cast("array<double>")).alias("v")), "doc_id")
    means = told.groupBy("node").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("vector"))
    return means.where(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)) >= 1e-9)


def _units(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(width: int, table: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table]).normal(size=(width, bits))


def plan_tables(n: int, least: float, recall: float, bucket: int = BLOCK_ROWS // 4) -> tuple[int, int]:
    """Bits of a key and number of tables: buckets of some `bucket` rows, and a pair at the threshold meets in a table with a chance of `recall`."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / bucket))) if n > bucket else 1
    met = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 1


def tables_pay(n: int, bits: int, tables: int) -> bool:
    """Whether so many tables cost less than looking at every pair of n rows: each table holds all rows once more."""
    return tables * (ROW_PAIRS + n / 2 ** (bits + 1)) < n / 2


def similar_pairs(vectors: DataFrame, least: float = 0.85, exact: bool = True, recall: float = 0.95, seed: int = 42) -> DataFrame:
    """a < b and score of rows (node, vector) with a cosine of `least` at least, to six digits.

    Exact: every pair is looked at. Else a pair is looked at if the signs of its products with some random vectors are
    equal in one of several tables, whose number follows from the recall wanted; a low threshold wants so many tables that
    every pair is looked at instead where that costs less, which misses none. In either case rows lie in blocks of some
    BLOCK_ROWS inside their bucket, their number following from the bucket's size, and two blocks at a time are compared:
    a bucket with a third of all rows is as many tasks as it needs. Where every pair is looked at, pairs of blocks are met
    where they are read: no block is sent once for each other one. Null, empty and zero vectors have no pairs.
    """
    rows = vectors.select("node", F.col("vector").cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    kind = rows.schema["node"].dataType.simpleString()
    if not exact:
        n = rows.count()
        bits, tables = plan_tables(n, least, recall)
        exact = not tables_pay(n, bits, tables)

    def keyed(batches):
        for batch in batches:
            x = _units(batch.column(1))
            nodes, packed = batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())
            for t in range(1 if exact else tables):
                key = np.zeros(len(x), np.int64) if exact else (x @ _planes(x.shape[1], t, bits, seed) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key), nodes, packed], ["tab", "key", "node", "x"])

    dealt = written(rows.mapInArrow(keyed, f"tab int, key long, node {kind}, x binary"), "similarity-keys")
    sizes = dealt.groupBy("tab", "key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    placed = dealt.join(sizes, ["tab", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def packed(key, part):  # some BLOCK_ROWS rows
        nodes = pa.array([part["node"].to_pylist()], pa.list_(part["node"].type))
        return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), nodes, pa.array([b"".join(part["x"].to_pylist())], pa.binary())], ["tab", "key", "blocks", "block", "nodes", "xs"])

    blocks = written(placed.groupBy("tab", "key", "blocks", "block").applyInArrow(packed, f"tab int, key long, blocks int, block int, nodes array<{kind}>, xs binary"), "similarity-blocks")
    columns = {side: blocks.select(*[c for c in ("tab", "key") if not exact], "blocks", F.col("nodes").alias(f"n{side}"), F.col("xs").alias(f"x{side}"), F.col("block").alias(f"b{side}")) for side in (1, 2)}
    if exact:
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = columns[1].drop("blocks").repartition(parts, "b1").join(columns[2].drop("blocks"), F.col("b1") <= F.col("b2"))
    else:
        left = columns[1].withColumn("b2", F.explode(F.sequence("b1", F.col("blocks") - 1))).drop("blocks")
        pairs = left.join(columns[2].drop("blocks"), ["tab", "key", "b2"])

    def compared(batches):
        for batch in batches:
            for row in range(len(batch)):
                n1, x1, n2, x2, same = (batch.column(i)[row] for i in range(5))
                n1, n2, same = n1.as_py(), n2.as_py(), same.as_py()
                x, y = (np.frombuffer(b.as_buffer()).reshape(len(n), -1) for b, n in ((x1, n1), (x2, n2)))
                score = np.round(x @ y.T, 6)
                i, j = np.nonzero(np.triu(score >= least, 1) if same else score >= least)
                if len(i):
                    a, b = pd.Series(n1)[i].to_list(), pd.Series(n2)[j].to_list()
                    ordered = [(u, v) if u < v else (v, u) for u, v in zip(a, b, strict=True)]
                    yield pa.RecordBatch.from_pydict({"a": [u for u, _ in ordered], "b": [v for _, v in ordered], "score": pa.array(score[i, j])})

    met = pairs.select("n1", "x1", "n2", "x2", (F.col("b1") == F.col("b2")).alias("same"))
    scored = met.mapInArrow(compared, f"a {kind}, b {kind}, score double").where("a <> b")
    found = written(scored.groupBy("a", "b").agg(F.max("score").alias("score")), "similarity-pairs", PAIRS_AT_ONCE)
    forget(dealt)
    forget(blocks)
    return found


def similarity_edges(means: DataFrame, edges: DataFrame, least: float = 0.85, exact: bool = True, recall: float = 0.95) -> DataFrame:
    """a < b and score of nodes (node, vector) with a cosine of `least` at least and no edge from a to b."""
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return similar_pairs(means, least, exact, recall).join(known, ["a", "b"], "left_anti")


def with_similarity(edges: DataFrame, similar: DataFrame) -> DataFrame:
    """Edges (src, relation, dst, confidence, weight) and those of similar nodes (a, b, score), which have weight 1 and no evidence."""
    added = similar.select(F.col("a").alias("src"), F.lit(RELATION).alias("relation"), F.col("b").alias("dst"), F.col("score").alias("confidence"), F.lit(1).cast("long").alias("weight"))
    return edges.select(*added.columns).unionByName(added)
