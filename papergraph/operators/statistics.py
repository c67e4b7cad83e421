"""Figures of a corpus, exact and as sketches that are kept for each query and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers (2^PRECISION) of a distinct count: a relative error of about 0.8 %; k of the quantiles: about 0.7 % in rank.
PRECISION, QUANTILE_K = 14, 400


def corpus_counts(papers: DataFrame, authors: DataFrame, entities: DataFrame, relations: DataFrame, hypotheses: DataFrame, query: str | None = None) -> DataFrame:
    """One row: paper, author, entity, relationship and hypothesis counts; of one query's papers, authors and hypotheses if it is named.

    papers: doc_id, query; authors: doc_id, author; hypotheses: query. Entities and relations belong to no query.
    """
    if query is not None:
        papers, hypotheses = papers.where(F.col("query") == query), hypotheses.where(F.col("query") == query)
        authors = authors.join(papers.select("doc_id").distinct(), "doc_id", "left_semi")
    out = papers.agg(F.count("*").alias("paper_count")).join(authors.agg(F.countDistinct("author").alias("author_count")))
    for name, df in (("entity_count", entities), ("relationship_count", relations), ("hypothesis_count", hypotheses)):
        out = out.join(df.agg(F.count("*").alias(name)))  # one row each
    return out


def query_sketches(rows: DataFrame, distinct: list[str], measured: list[str]) -> DataFrame:
    """query, n, a distinct-count sketch of each column of `distinct` (d_...) and a quantile sketch of each of `measured` (q_...).

    Rows of a new batch make new sketches, which merge with those kept: nothing is counted twice or read again.
    """
    return rows.groupBy("query").agg(
        F.count("*").alias("n"), *[F.hll_sketch_agg(F.col(c).cast("string"), PRECISION).alias(f"d_{c}") for c in distinct], *[F.kll_sketch_agg_double(F.col(c).cast("double"), QUANTILE_K).alias(f"q_{c}") for c in measured]
    )


def merged_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketches of several batches or queries as one, for each value of `by` (none: of all)."""
    kept = [F.hll_union_agg(c).alias(c) if c.startswith("d_") else F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.startswith(("d_", "q_"))]
    return sketches.groupBy(*(by or [])).agg(F.sum("n").alias("n"), *kept)


def estimates(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.75, 0.9)) -> DataFrame:
    """The sketches' figures: distinct counts, and quantiles as name_p50 and so on; other columns stay."""
    columns = []
    for c in sketches.columns:
        if c.startswith("d_"):
            columns.append(F.hll_sketch_estimate(c).alias(f"n_{c[2:]}"))
        elif c.startswith("q_"):
            columns += [F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(p))).alias(f"{c[2:]}_p{int(100 * p)}") for p in shares]
        else:
            columns.append(F.col(c))
    return sketches.select(*columns)
