"""Where tables go: vectors by query, graphs as JSON, relations as CSV, append-only logs and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergraph.functions.text import query_hash


def save_vectors(df: DataFrame, path: str, query: str) -> None:
    """Replaces the vectors of a query; those of other queries stay."""
    df.withColumn("query_hash", query_hash(F.lit(query))).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("query_hash").parquet(path)


def load_vectors(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The vectors of a query; only its partition is read."""
    return spark.read.parquet(path).where(F.col("query_hash") == query_hash(F.lit(query))).drop("query_hash")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind and json: a line for each node and edge, and one with their numbers."""
    rows = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json")) for kind, df in (("node", nodes), ("edge", edges))]
    figures = nodes.agg(F.count("*").alias("node_count")).join(edges.agg(F.count("*").alias("edge_count")))
    return rows[0].unionByName(rows[1]).unionByName(figures.select(F.lit("statistics").alias("kind"), F.to_json(F.struct("node_count", "edge_count")).alias("json")))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines in a folder for each of nodes, edges and statistics."""
    graph_lines(nodes, edges).write.mode("overwrite").partitionBy("kind").text(path)


def save_relations(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_topics(summary: DataFrame, assigned: DataFrame, path: str) -> None:
    """Topics and their documents, outliers left out."""
    append(summary.where("topic_id >= 0"), f"{path}/topics")
    append(assigned.where("topic_id >= 0"), f"{path}/assignments")


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    """query_hash and n of the vector sets that are saved: their size, and whether one is there at all."""
    return spark.read.parquet(path).groupBy("query_hash").agg(F.count("*").alias("n"))
