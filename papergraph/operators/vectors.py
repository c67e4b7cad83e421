"""Cosine search and group means over vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Queries and rows of a block.
QUERY_ROWS = 500
CORPUS_ROWS = 2000


def unit(vector):
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """ids, width and xs of lists of at most `most` rows (id, vector: finite), as unit vectors filled up with zeros."""
    kind = rows.schema["id"].dataType.simpleString()

    def packed(batches):
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                x = pad(part.column(1).to_pylist())
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, norm, out=x, where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "width", "xs"])

    def pad(vectors):
        x = np.zeros((len(vectors), max(map(len, vectors))))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        return x

    return rows.select("id", "vector").mapInArrow(packed, f"ids array<{kind}>, width int, xs binary")


def _block_hits(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score: of each list of rows of corpus (vec_id, embedding) the k that are nearest each query, as products of matrices."""
    kinds = queries.schema["query_id"].dataType.simpleString(), corpus.schema["vec_id"].dataType.simpleString()

    def best(batches):
        for batch in batches:
            for qs, qw, qx, vs, vw, vx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = min(qw, vw)
                score = np.round(np.frombuffer(qx).reshape(-1, qw)[:, :width] @ np.frombuffer(vx).reshape(-1, vw)[:, :width].T, 6) + 0.0
                order = np.argsort(np.array(vs), kind="stable")
                top = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]  # ties to the smaller vec_id
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qs), top.shape[1])), pa.array(np.array(vs)[top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel())], ["query_id", "vec_id", "score"])

    asked = _packed(queries.toDF("id", "vector"), QUERY_ROWS).toDF("qs", "qw", "qx")
    met = F.broadcast(asked).join(_packed(corpus.toDF("id", "vector"), CORPUS_ROWS).toDF("vs", "vw", "vx"))
    return met.select("qs", "qw", "qx", "vs", "vw", "vx").mapInArrow(best, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int = 10, gate: float | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of corpus (vec_id, embedding) nearest each row of queries (query_id, embedding).

    With a gate, a query whose best score is lower gets nothing. The query set is stated and small against the corpus.
    Numbers as ids, and vectors of finite numbers, are compared in blocks; all others row by row.
    """
    corpus = corpus.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    numbers = all(isinstance(df.schema[c].dataType, IntegralType) for df, c in ((corpus, "vec_id"), (queries, "query_id")))
    finite = F.lit(numbers) & F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))
    plain, asked_plain = finite & F.col("vec_id").isNotNull(), finite & F.col("query_id").isNotNull()

    def by_row(rows, asked):
        met = rows.select("vec_id", unit(F.col("embedding")).alias("v")).join(asked.select("query_id", unit(F.col("embedding")).alias("q")))
        return met.select("query_id", "vec_id", F.round(dot("v", "q"), 6).alias("score"))

    scored = by_row(corpus.where(~plain), queries).unionByName(by_row(corpus.where(plain), queries.where(~asked_plain)))
    if numbers:
        scored = scored.unionByName(_block_hits(corpus.where(plain), queries.where(asked_plain), k))
    by = Window.partitionBy("query_id")
    best = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    if gate is not None:
        best = best.withColumn("_best", F.max("score").over(by)).where(F.col("_best") >= gate).drop("_best")
    return best.select("query_id", "rank", "vec_id", "score")


def group_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, at (place in the vector, from 0) and mean of each component."""
    parts = df.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.posexplode(vector).alias("at", "x"))
    return parts.groupBy("group", "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
