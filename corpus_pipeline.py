"""A corpus pipeline: language, near copies, benchmark leaks, mixture, shards. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from papergraph.llm.common import saved, table
from papergraph.llm.decontaminate import contaminated
from papergraph.llm.langid import fit_languages, identify_languages
from papergraph.llm.mixing import mix_sources
from papergraph.llm.ngram_join import ngram_components
from papergraph.llm.queries import remainder
from papergraph.llm.sharding import byte_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark, docs, sf_dir):
    """Keeps documents whose language the model knows; it learns from documents of crc32(doc_id) mod 3 other than 1.

    Null, empty and letterless texts have no language and go; repeated rows are judged alike and stay.
    """
    model = fit_languages(docs.where(remainder(3) != 1), "text", "lang", "doc_id")
    return identify_languages(docs, model, keep=COLUMNS).where("NOT rejected").select(*COLUMNS)


def keyed(docs, name):
    """The rows with a key of their own: the id, if all have one and none is repeated, else a number.

    Numbered rows are written, so that the numbers stay.
    """
    n, k = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == k:
        return docs.select(*COLUMNS, F.col("doc_id").alias("row_key"))
    return saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), name)


def near_copies(spark, docs, sf_dir):
    """Keeps one row of each component: the one with the smallest id; rows with a null id come last. Rows without words stay."""
    rows = keyed(docs, "pipeline-copies-keyed")
    named = ngram_components(rows, id_col="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    each = named.join(rows.select("row_key", "doc_id"), "row_key").groupBy("component_id")
    kept = each.agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("x")).select("x.row_key")
    return rows.join(kept, "row_key", "left_semi").select(*COLUMNS)


def benchmark_leaks(spark, docs, sf_dir):
    """Drops rows that hold a benchmark item, with or without an id. Null and empty texts stay."""
    rows = keyed(docs, "pipeline-leaks-keyed")
    held = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(held, "row_key", "left_anti").select(*COLUMNS)


def mixture(spark, docs, sf_dir):
    """Repeats documents of small sources, twice at most; every row stays once at least, a null source is one of its own."""
    return mix_sources(docs).select(*COLUMNS)


def shards(spark, docs, sf_dir):
    """Contiguous shards of equal bytes; rows with null ids come first."""
    return byte_shards(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture), ("shards", shards)]

#: Not stated in SQL: the language stage is a model.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
