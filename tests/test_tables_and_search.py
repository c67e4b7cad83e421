"""Retrieval by trigrams, marks and mentions, tables changed in place, sketches and reloaded sessions."""

import random

import pytest
from pyspark.sql import functions as F

from papergraph.operators import records, retrieval, statistics
from papergraph.sources import tables


def by_scan(questions, docs, k, least, cut):
    out = []
    for q, text in questions:
        low = (text or "").lower()
        words = {w for w in "".join(c if c.isalnum() or c == "_" else " " for c in low).split() if len(w) >= least} or {low[:cut]}
        hits = [d for d, t in sorted(docs) if any(w in t for w in words)]
        out += [(q, r, d) for r, d in enumerate(hits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("first,block", [(1024, 8192), (4, 3)])
def test_retrieval_against_a_scan(spark, monkeypatch, first, block):
    monkeypatch.setattr(retrieval, "FIRST_RANGE", first)
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    docs = [(i, " ".join([word() for _ in range(rng.randint(0, 12))] + ["common"] * (i % 2))) for i in range(60)]
    questions = [(j, " ".join(word() for _ in range(3))) for j in range(20)] + [(100, "common"), (101, ""), (102, None), (103, "a"), (104, "nowhere"), (105, "x COMMON; y")]
    asked = spark.createDataFrame(questions, "question_id long, question string")
    rows = spark.createDataFrame([(i, i, None, t) for i, t in docs], "ord long, doc_id long, title string, abstract string")
    searched = [(i, " " + t) for i, t in docs]
    for k, least, cut in ((5, 4, 20), (2, 3, None)):
        assert sorted(map(tuple, retrieval.keyword_retrieval(asked, rows, k, least, cut).collect())) == by_scan(questions, searched, k, least, cut)
    assert retrieval.keyword_retrieval(asked, rows.limit(0)).collect() == [] and retrieval.keyword_retrieval(asked.limit(0), rows).collect() == []


def test_marks(spark):
    rows = spark.createDataFrame(
        [(1, "Gene therapy with CELLS", "Genes, gene-cells: CELL cells."), (2, "gene", None), (3, None, "gene"), (4, "of", "of"), (5, "thera therapy", "Therapy"), (6, "a.c*d x", "see A.C*D")], "i int, query string, text string"
    )
    got = {r.i: r.marked for r in retrieval.marked_terms(rows).collect()}
    assert got == {1: "**Gene**s, **gene**-**cells**: CELL **cells**.", 2: None, 3: "gene", 4: "of", 5: "**Therapy**", 6: "see **A.C*D**"}
    words = retrieval.vocabulary(spark.createDataFrame([("Stem-cells / Therapy of X",), (None,)], "label string"))
    assert {r.word for r in words.collect()} == {"stem", "cells", "therapy"}
    assert {r.i: r.marked for r in retrieval.marked_terms(rows, words, marks=("<", ">")).collect()}[1] == "Genes, gene-<cells>: CELL <cells>."


def test_words_in_groups(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_WORDS", 2)
    labels = spark.createDataFrame([("Gene",), ("gene ",), ("stem cell",), ("cell",), ("",), (None,), ("é1",)], "label string")
    docs = spark.createDataFrame([(1, "Gene genes; a GENE. Stem cell cells cell"), (2, None), (3, ""), (3, "xé1 é1")], "doc_id long, text string")
    assert sorted(map(tuple, retrieval.label_mentions(docs, labels).collect())) == [(1, "cell", 2), (1, "gene", 2), (1, "stem cell", 1), (3, "é1", 1)]
    rows = spark.createDataFrame([("gene cell stem other", "gene cell stem other")], "query string, text string")
    words = spark.createDataFrame([(w,) for w in ("gene", "cell", "stem", "more", "some")], "word string")
    assert retrieval.marked_terms(rows, words).first().marked == "**gene** **cell** **stem** other"


def test_upsert_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(100)] + [(None, "null")], "k long, v string")
    tables.create_table(rows, path, ["k"], 8)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("*/*.parquet")}
    batch = spark.createDataFrame([(7, "new"), (500, "added"), (None, "none")], "k long, v string")
    n = tables.upsert_table(batch, path, ["k"], 8)
    want = {i: f"v{i}" for i in range(100)} | {7: "new", 500: "added", None: "none"}
    assert {r.k: r.v for r in tables.read_table(spark, path).collect()} == want and tables.read_table(spark, path).count() == len(want)
    after = {p.name for p in (tmp_path / "t").glob("*/*.parquet")}
    assert 1 <= n <= 3 and len(before.keys() - after) <= n  # other buckets' files are as they were
    tables.upsert_table(batch, path, ["k"], 8)
    assert tables.read_table(spark, path).count() == len(want)
    assert tables.upsert_table(batch.limit(0), path, ["k"], 8) == 0


def test_upsert_that_was_cut_short(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create_table(spark.createDataFrame([(i, "old") for i in range(20)], "k long, v string"), path, ["k"], 4)
    # a run that ended after it had written all buckets beside the table, and one that had not
    whole = spark.read.parquet(path).withColumn("v", F.lit("new")).where("_bucket = 1")
    whole.write.partitionBy("_bucket").parquet(f"{path}-pending")
    tables.recover(spark, path)
    got = {r.k: r.v for r in tables.read_table(spark, path).collect()}
    assert len(got) == 20 and set(got.values()) == {"old", "new"} and not (tmp_path / "t-pending").exists()
    (tmp_path / "t-pending").mkdir()
    tables.recover(spark, path)
    assert {r.k: r.v for r in tables.read_table(spark, path).collect()} == got and not (tmp_path / "t-pending").exists()


def test_sketches_merge(spark):
    rows = spark.range(0, 30_000).select((F.col("id") % 3).cast("string").alias("query"), (F.col("id") % 7001).alias("author"), F.col("id").cast("double").alias("x"))
    kept = statistics.query_sketches(rows.where("id % 2 = 0"), ["author"], ["x"]).unionByName(statistics.query_sketches(rows.where("id % 2 = 1"), ["author"], ["x"]))
    got = {r.query: r for r in statistics.estimates(statistics.merged_sketches(kept, ["query"])).collect()}
    assert set(got) == {"0", "1", "2"}
    for q, r in got.items():
        own = rows.where(F.col("query") == q)
        assert r.n == 10_000 and abs(r.n_author - own.select("author").distinct().count()) <= 0.03 * r.n_author
        assert all(abs(v - p * 30_000) <= 0.02 * 30_000 for v, p in ((r.x_p50, 0.5), (r.x_p75, 0.75), (r.x_p90, 0.9)))
    whole = statistics.estimates(statistics.merged_sketches(kept)).first()
    assert whole.n == 30_000 and abs(whole.n_author - 7001) <= 0.03 * 7001


def test_reloaded_session_is_the_first(spark):
    author = F.array(F.struct(F.lit("García, José").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("last_name", "fore_name", "initials", "affiliation", "normalized_name")]))
    rows = spark.createDataFrame([("1", "A title", ["Gene", "gene"], "q", 1), ("2", "Other title", None, "q", 2), ("3", "Third", ["x"], "r", 3)], "pmid string, title string, keywords array<string>, query_used string, row_ord long").withColumn("authors", author)
    kept = records.stored(rows)
    assert dict(kept.dtypes)["keywords"] == "string"
    first, again = (sorted(map(str, df.collect())) for df in (records.clean_records(rows.where("query_used = 'q'")), records.reload_session(kept, "q")))
    assert len(again) == 2 and [x.replace("keywords=None", "keywords=[]") for x in first] == again
    bad = kept.withColumn("authors", F.lit("[{")).withColumn("keywords", F.lit(None).cast("string"))
    assert {(r.pmid, r.author_count, r.keyword_count) for r in records.reload_session(bad, "q").collect()} == {("1", 0, 0), ("2", 0, 0)}


def test_cosine_search_in_blocks_against_rows(spark, monkeypatch):
    from papergraph.operators import vectors

    monkeypatch.setattr(vectors, "CORPUS_ROWS", 3)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 2)
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(20)] + [(20, [0.0, 0.0, 0.0]), (21, [1.0]), (22, [1.0, None, 2.0]), (23, None), (24, [])]
    queries = spark.createDataFrame([(i, v) for i, v in rows if i in (0, 7, 20, 21, 22)], "query_id long, embedding array<double>")
    ids = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    named = ids.selectExpr("lpad(string(vec_id), 3, '0') AS vec_id", "embedding")  # ids that are no numbers go row by row
    for k in (4, 30):
        got = sorted(tuple(r) for r in vectors.cosine_top_k(ids, queries, k).collect())
        want = sorted((r.query_id, r["rank"], int(r.vec_id), r.score) for r in vectors.cosine_top_k(named, queries, k).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == w[3] for g, w in zip(got, want, strict=True))


def test_one_search_builds_no_index(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i, None, f"common w{i:04d} é") for i in range(50)], "ord long, doc_id long, title string, abstract string")
    asked = spark.createDataFrame([(1, "w0049"), (2, "common"), (3, None), (4, "w0003 w0044")], "question_id long, question string")
    want = [(1, 1, 49), *((2, r, r - 1) for r in range(1, 6)), *((3, r, r - 1) for r in range(1, 6)), (4, 1, 3), (4, 2, 44)]
    index = retrieval.gram_index(rows.select("ord", retrieval.lowered_text().alias("text")))
    assert sorted(map(tuple, retrieval.keyword_retrieval(asked, rows, index=index).collect())) == want
    monkeypatch.setattr(retrieval, "FIRST_RANGE", 4)
    monkeypatch.setattr(retrieval, "MAX_WORDS", 2)
    monkeypatch.setattr(retrieval, "gram_index", None)
    assert sorted(map(tuple, retrieval.keyword_retrieval(asked, rows).collect())) == want
