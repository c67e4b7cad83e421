"""Clashing names, long texts, large numbers and other edges of the operators; registered queries on the smallest tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papergraph.llm import chat, langid, queries, quality, repeats, topk
from papergraph.llm.common import pieces
from papergraph.llm.mixing import entropy, mix_sources, solve_exponent, weights_at

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(i, f"alpha beta {i}", "en", "ab"[i % 2], 1) for i in range(8)], SCHEMA)
    rows = rows.withColumns({c: F.lit(1) for c in ("_times", "_source", "_block", "_tokens", "_text", "x", "x_", "mix_epoch")})
    assert set(mix_sources(rows).columns) >= {"_times", "_source", "_block", "_tokens"} and mix_sources(rows).count() >= 8
    assert quality.score_quality(rows, None).count() == 8
    model = langid.fit_languages(rows, "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.identify_languages(rows, model).collect()} == {"en"}


def test_entropy_of_a_mix():
    tokens = {"a": 900, "b": 90, "c": 10}
    target = 0.9
    assert abs(entropy(weights_at(tokens, solve_exponent(tokens, target_entropy=target))) - target) < 1e-6


def test_long_text_is_scored_as_short_runs(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t * 5, lang, "s", 1) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("le chat et la souris ", "fr")] * 20)], SCHEMA)
    model = langid.fit_languages(rows, "text", "lang", "doc_id")
    import pyarrow as pa

    texts = pa.array(["the cat and the dog " * 200, "", None, "le chat " * 300, "12 34"])
    whole = model.score(texts)
    monkeypatch.setattr(langid, "RUN_BYTES", 1000)
    parts = model.score(texts)
    assert whole[0] == parts[0] == ["en", "und", "und", "fr", "und"] and np.allclose(whole[1], parts[1], atol=1e-3)


def test_pieces_cut_long_texts_at_blanks():
    space = np.isin(np.arange(256), [32])
    data = np.frombuffer(b"ab cd ef gh" + b"x" * 30 + b" yz", np.uint8)
    cuts = [c for _, _, cs in pieces(data, np.array([0, len(data)]), 7, space) for c in cs]
    assert cuts[0] == 0 and cuts[-1] == len(data) and all(data[c] == 32 for c in cuts[1:-1])


def test_suffix_classes_against_brute_force():
    rng = np.random.default_rng(3)
    phrases = [bytes(rng.integers(97, 99, rng.integers(5, 40)).astype(np.uint8)) for _ in range(60)]
    for length in (5, 8, 13):
        owner, start, rank = repeats.suffix_classes(phrases, length)
        said = [phrases[o][s : s + length] for o, s in zip(owner, start, strict=True)]
        assert all(len(x) == length for x in said)
        order = sorted(set(said))
        assert [order.index(x) for x in said] == rank.tolist()


def test_repeats_of_a_long_text_null_and_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RUN_BYTES", 4000)
    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(97, 123, 12_000)))
    shared = long[3950:4150]
    rows = spark.createDataFrame([(None, shared), (1, long), (1, "x" + shared), (2, ""), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(rows).collect())
    assert got == sorted([(True, 200, 0), (False, 12_000, 200), (False, 201, 200), (False, 0, 0), (False, 0, 0)])
    assert repeats.remove_repeats(rows.limit(0)).count() == 0


def test_top_k_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.5]), (2, [0.5]), (3, None), (None, [1.0]), (4, [float("nan")]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(rows, rows.where("vec_id = 50")).orderBy("rank").collect()]
    assert got == [(1, 1, 256 * 256 + 128 * 256), (2, 2, 128 * 256), (3, 2, 128 * 256)]
    assert topk.exact_top_k(rows.limit(0), rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_top_k(rows.union(spark.createDataFrame([(9, [1e17])], rows.schema)), rows.where("vec_id = 50").withColumn("embedding", F.array(F.lit(1e17)))).collect()


def test_conversation_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_BYTES", 50)
    turns = [(7, i, "assistant" if i % 2 else "user", f"[INST] {i} </s>\n" * (i % 4)) for i in range(20)]
    got = chat.read_back(chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
    loss = "".join(t for _, _, r, t in turns if r == "assistant")
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (20, hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_training_of_preferences():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, quality.FEATURES))
    y = (x[:, 2] + 0.1 * rng.normal(size=400) > 0).astype(int)
    model = quality.train(x, y)
    assert ((model.score(x) >= quality.AT_THRESHOLD) == y).mean() > 0.95


def test_op6_query_against_every_window(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    seen, want = set(), {}
    for r in rows:
        b = (r.text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        want[r.doc_id] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op6_repeats(spark, SF).collect()} == want


def test_pipeline_stages_keep_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    n = docs.count()
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and 0.9 * n <= kept.count() <= n
    assert corpus_pipeline.mixture(spark, docs, SF).select("doc_id").distinct().count() == n
    assert corpus_pipeline.shards(spark, docs, SF).count() == n


def test_ngrams_of_different_fragments_stay_apart(spark, monkeypatch):
    from papergraph.llm import ngram_join

    def alike(texts, n):
        """One n-gram for each word, a number below 8: all have equal 48 bits and are in fragments of their own."""
        sets = [sorted({int(w) << 61 | 7 for w in (t or "").split()}) for t in texts.to_pylist()]
        yield 0, len(sets), np.array([g for s in sets for g in s], np.uint64), np.array([len(s) for s in sets], np.int64)

    monkeypatch.setattr(ngram_join, "shingles", alike)
    rows = spark.createDataFrame([(1, "0 1 2 3 4 5"), (2, "0 1 2 3 4"), (3, "5 6"), (4, "6 7"), (5, "7")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(rows).collect()}
    assert got == {1: (6, 1), 2: (5, 1), 3: (2, 3), 4: (2, 4), 5: (1, 5)}


def test_ngram_join_of_empty_tables_and_clashing_columns(spark):
    from papergraph.llm.ngram_join import ngram_components, ngram_links

    rows = spark.createDataFrame([(1, "a b c d e f", 1, 1, 1, 1), (2, "A b c d e f", 2, 2, 2, 2), (3, None, 3, 3, 3, 3)], "doc_id long, text string, set long, gram long, component_id long, hi long")
    assert {r.doc_id: r.component_id for r in ngram_components(rows).collect()} == {1: 1, 2: 1, 3: 3}
    assert ngram_components(rows.limit(0)).count() == 0
    links, members = ngram_links(rows.limit(0))
    assert links.count() == members.count() == 0


def test_budgets_of_a_mix(spark):
    tokens = {"a": 9000, "b": 900, "c": 90}
    ends = [entropy(weights_at(tokens, a)) for a in (1.0, 0.0)]
    exponent = solve_exponent(tokens, evenness=0.5)
    assert 0 < exponent < 1 and abs(entropy(weights_at(tokens, exponent)) - sum(ends) / 2) < 1e-9
    assert solve_exponent(tokens, evenness=1.0) < 1e-9 and solve_exponent(tokens, evenness=0.0) > 1 - 1e-9
    with pytest.raises(ValueError, match="one of"):
        solve_exponent(tokens, 2.0, evenness=0.5)
    rows = spark.createDataFrame([(i, f"w {i}", "en", "big" if i % 9 else "small", 1) for i in range(3000)], SCHEMA)
    rows = rows.union(rows.where("doc_id < 20"))  # repeated rows
    got = mix_sources(rows, max_epochs=None, evenness=0.5)
    for r in got.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("read"), F.first("mix_tokens").alias("said"), F.first("mix_budget").alias("asked"), F.first("mix_weight").alias("w")).collect():
        assert r["read"] == r.said and abs(r.said - r.asked) <= 0.02 * r.asked
    assert sorted((r.doc_id, r["count"]) for r in got.where("mix_epoch = 0").groupBy("doc_id").count().collect()) == [(i, 2 if i < 20 else 1) for i in range(3000)]


def test_sets_travel_in_few_bytes():
    import numpy as np

    from papergraph.llm.ngram_join import _keys, _packed_sets, _unpacked_sets

    keys = _keys(np.arange(6, dtype=np.uint64), np.array([2, 0, 3, 1]))
    for counts in (np.array([2, 0, 3, 65535]), np.array([2, 1, 3, 65536])):
        packed = _packed_sets(keys, counts)
        assert len(packed[0]) == 12 * 4 and len(packed[1]) == 4 * (2 if counts.max() < 65536 else 4)
        back = _unpacked_sets(*packed)
        assert (back[0] == keys).all() and (back[1] == counts).all()


def test_counts_of_sets_travel_in_one_byte_and_keys_once_for_several_fragments(spark, monkeypatch):
    from papergraph.llm import ngram_join

    keys = ngram_join._keys(np.arange(6, dtype=np.uint64), np.array([2, 0, 3, 1]))
    for most, width in ((255, 1), (256, 2), (65536, 4)):
        counts = np.array([2, 0, 3, most])
        packed = ngram_join._packed_sets(keys, counts)
        assert len(packed[1]) == 4 * width and (ngram_join._unpacked_sets(*packed)[1] == counts).all()
    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 3, 400 + i % 3))) for i in range(6)], "doc_id long, text string")
    found = {}
    for spans in (1, 4):  # also more than are usual
        monkeypatch.setattr(ngram_join, "SPANS", spans)
        parts = ngram_join.ngram_parts(rows, 5, "doc_id", "text")
        found[spans] = sorted(map(tuple, parts.where("kind = 2").select("hi", "lo", "gram", "df").collect()))
        counts = parts.where("kind = 1").groupBy("hi", "lo").agg(F.sum("df").alias("n"), F.count("*").alias("k")).collect()
        assert len(counts) == 3 and sum(r.n for r in counts) == len(found[spans]) and all(r.k <= 8 for r in counts)
    assert found[1] == found[4] and found[1]
