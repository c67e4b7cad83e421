"""Communities to convergence, similar nodes, neighbourhoods and closeness by sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papergraph.operators import knowledge, networks, similarity
from papergraph.operators.communities import communities


def graph(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight long")


def modularity(rows, part):
    m, inner, k = sum(w for *_, w in rows), {}, {}
    for a, b, w in rows:
        if part[a] == part[b]:
            inner[part[a]] = inner.get(part[a], 0) + w
        for x in (a, b):
            k[part[x]] = k.get(part[x], 0) + w
    return sum(inner.get(c, 0) / m - (k[c] / 2 / m) ** 2 for c in k)


def test_communities_of_a_long_path(spark):
    rows = [(i, i + 1, 1) for i in range(2000)]
    part = {r.node: r.community for r in communities(graph(spark, rows)).collect()}
    assert len(part) == 2001 and modularity(rows, part) >= 0.95
    assert all(part[c] == c == min(v for v in part if part[v] == c) for c in set(part.values()))


def test_communities_of_a_ring_of_cliques(spark):
    rows = [(c * 5 + i, c * 5 + j, 2) for c in range(12) for i in range(5) for j in range(i)] + [(c * 5, (c + 1) % 12 * 5 + 1, 1) for c in range(12)]
    edges = graph(spark, rows + [(7, 7, 9), (0, 1, 0), (None, 3, 1)])
    nodes = spark.createDataFrame([(i,) for i in (*range(60), 100, None)], "node long")
    part = {r.node: r.community for r in communities(edges, nodes).collect()}
    assert set(part) == {*range(60), 100} and part[100] == 100  # isolated nodes stay alone
    assert all(len({part[c * 5 + i] for i in range(5)}) == 1 for c in range(12)) and modularity(rows, part) >= 0.85
    assert {r.node: r.community for r in communities(edges, nodes).collect()} == part


def test_communities_without_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert communities(graph(spark, [])).collect() == []
    assert sorted(map(tuple, communities(graph(spark, [(1, 1, 1)]), nodes).collect())) == [(1, 1), (2, 2)]


def vectors(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "node long, vector array<double>")


def alike(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    return {(i, j): s[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least}


@pytest.mark.parametrize("block", [7, 2000])
def test_similar_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 90)] + 0.3 * rng.normal(size=(90, 6))
    x[5] = x[6]
    rows = vectors(spark, [*x, None, [0.0] * 6, []])
    got = {(r.a, r.b): r.score for r in similarity.similar_pairs(rows, 0.85).collect()}
    want = alike(x, 0.85)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in got)
    assert similarity.similar_pairs(rows.limit(0), 0.85).collect() == []


def test_recall_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 16))[rng.integers(0, 80, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[:400] = x[0] + 0.1 * rng.normal(size=(400, 16))  # a large bucket
    want = alike(x, 0.85)
    bits, tables = similarity.plan_tables(1500, 0.85, 0.95, 25)
    assert bits == 6 and tables > 1
    got = {(r.a, r.b) for r in similarity.similar_pairs(vectors(spark, x), 0.85, exact=False).collect()}
    assert got <= want.keys() and len(got) >= 0.9 * len(want)


def test_node_vectors_and_edges(spark):
    evidence = spark.createDataFrame([("a", "r", "b", 1), ("a", "s", "b", 1), ("a", "r", "c", 2), ("b", "r", "c", 3), ("c", "r", "a", 4), ("c", "r", "a", 5), ("d", "r", "a", 9)], "src string, relation string, dst string, doc_id long")
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.0])], "doc_id long, vector array<double>")
    means = similarity.node_vectors(evidence, docs)
    assert {r.node: r.vector for r in means.collect()} == {"a": [0.5, 0.5], "b": [1.0, 1.0]}
    edges = spark.createDataFrame([("b", "r", "a", 0.5, 3)], "src string, relation string, dst string, confidence double, weight long")
    found = similarity.similarity_edges(means, edges)  # an edge from b to a does not count
    assert [tuple(r) for r in found.collect()] == [("a", "b", 1.0)]
    assert similarity.similarity_edges(means, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).collect() == []
    assert sorted(map(tuple, similarity.with_similarity(edges, found).collect())) == [("a", "semantic_similarity", "b", 1.0, 1), ("b", "r", "a", 0.5, 3)]


def test_neighbourhoods_agree(spark):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))], "src long, dst long")
    starts = spark.createDataFrame([(int(edges.first().src),)], "node long")
    for depth in (0, 1, 3):
        by_rounds = knowledge.neighbourhood(edges, starts, depth).collect()
        assert sorted(map(tuple, knowledge.walked(edges, starts, depth).collect())) == sorted(map(tuple, by_rounds))
        inside = {r.node for r in by_rounds}
        assert sorted(map(tuple, knowledge.neighbourhood_graph(edges, starts, depth).collect())) == sorted((r.src, r.dst) for r in edges.collect() if {r.src, r.dst} <= inside)


def test_closeness_by_sketches(spark):
    rng = np.random.default_rng(6)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (420, 2))] + [(500, 501), (600, 600)], "src long, dst long")
    nodes = spark.range(0, 300).toDF("node").union(spark.createDataFrame([(500,), (501,), (600,)], "node long"))
    exact = {r.node: r.closeness for r in knowledge.closeness(edges, nodes).collect()}
    got = {r.node: r.closeness for r in knowledge.closeness_sketch(edges, nodes).collect()}
    assert got.keys() == exact.keys() and got[600] == 0.0 and got[500] == exact[500]
    assert all(abs(got[v] - exact[v]) <= 0.05 * exact[v] + 1e-6 for v in exact)


def test_nodes_without_counts_are_the_same_and_count_nothing(spark):
    rows = spark.createDataFrame([(1, "Abc", "G", None, 5), (2, "abc", "G", None, 6), (3, "Long name", "G", "C1", 5), (4, "ln", "G", "C1", 5), (5, "LN", None, "", 7)], "ord long, name string, entity_type string, concept_id string, doc_id long")
    (nodes, names), (bare, same) = knowledge.canonical_nodes(rows), knowledge.canonical_nodes(rows, counted=False)
    assert bare.columns == ["label", "entity_type", "concept_id"] and sorted(map(tuple, bare.collect()), key=str) == sorted(map(tuple, nodes.select(bare.columns).collect()), key=str)
    assert {r.label: r.paper_count for r in nodes.collect()} == {"Abc": 2, "ln": 1, "LN": 1}
    assert sorted(names.collect()) == sorted(same.collect())
    relations = spark.createDataFrame([("ABC", "ln", None, 1, None), ("abc ", "Long name", "", 1, 0.9), ("Abc", "ln", None, None, 0.95), ("no", "ln", None, 3, None)], "source_entity string, target_entity string, relationship_type string, doc_id long, confidence double")
    edges, evidence = knowledge.consolidated_edges(relations, names)
    assert [tuple(r) for r in edges.collect()] == [("Abc", "associated_with", "ln", 0.95, 1)] and [tuple(r) for r in evidence.collect()] == [("Abc", "associated_with", "ln", 1)]


def test_buckets_only_where_they_cost_less(spark, monkeypatch):
    assert not similarity.tables_pay(120_000, *similarity.plan_tables(120_000, 0.4, 0.95)) and similarity.tables_pay(5_000_000, *similarity.plan_tables(5_000_000, 0.85, 0.95))
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 600)] + 0.3 * rng.normal(size=(600, 16))
    rows, want = vectors(spark, x), alike(x, 0.85)
    wide = alike(x, 0.4)
    assert {(r.a, r.b) for r in similarity.similar_pairs(rows, 0.4, exact=False).collect()} == wide.keys()  # too many tables: every pair is looked at
    monkeypatch.setattr(similarity, "ROW_PAIRS", 0)
    got = {(r.a, r.b) for r in similarity.similar_pairs(rows, 0.85, exact=False).collect()}
    assert got <= want.keys() and len(got) >= 0.9 * len(want)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = sorted({(int(d), int(x)) for d, x in rng.integers(0, 40, (500, 2))})
    links = spark.createDataFrame(rows, "doc long, ref long")
    want, first = networks.shared_references(links, 3).collect(), networks.top_neighbours(networks.shared_references(links), 3).collect()
    monkeypatch.setattr(networks, "COUNTED_PAIRS", 100)
    many = networks.shared_references(links, 3)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, want)) and all(r.weight >= 3 for r in want)
    near = networks.top_neighbours(networks.shared_references(links), 3)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, first))
    assert near.rdd.getNumPartitions() >= 2 * networks.shared_references(links).count() // 100


def test_closeness_sketches_travel_in_slices_and_blocks(spark, monkeypatch):
    from papergraph.operators import sketches

    rng = np.random.default_rng(8)
    pairs = [(int(a), 1000 + int(b)) for a, b in rng.integers(0, 60, (900, 2))] + [(5000, 5001 + i) for i in range(300)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    whole = {r.node: r.closeness for r in knowledge.closeness_sketch(edges, nodes, 11).collect()}
    for name, value in (("SLICE_BYTES", 1), ("EDGE_BYTES", 1), ("LEAST_SLICE", 1024), ("SOME_EDGES", 500), ("CHUNK_EDGES", 50), ("MANY", 3)):
        monkeypatch.setattr(sketches, name, value)
    assert {r.node: r.closeness for r in knowledge.closeness_sketch(edges, nodes, 11).collect()} == whole
    n = len(whole)
    assert whole[5000] == round(300 / (n - 1), 6)  # neighbours are counted, not estimated
    exact = {r.node: r.closeness for r in knowledge.closeness(edges, nodes, 3000).collect()}
    assert all(abs(whole[v] - exact[v]) <= 0.1 * exact[v] + 1e-6 for v in exact)


def test_sketches_of_derived_nodes_stay_in_their_block(spark, monkeypatch):
    from papergraph.operators import sketches

    sizes, write = {}, sketches.written

    def counted(df, name, *args, **kw):
        table = write(df, name, *args, **kw)
        sizes.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(sketches, "written", counted)
    edges = spark.createDataFrame([(i % 4, 100 + i) for i in range(80)] + [((i + 1) % 4, 100 + i) for i in range(40)], "src long, dst long")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    got = {r.node: r.closeness for r in knowledge.closeness_sketch(edges, nodes, 10).collect()}
    assert set(sizes["closeness-state"]) == {4}  # the hubs, not the eighty leaves
    exact = {r.node: r.closeness for r in knowledge.closeness(edges, nodes, 3000).collect()}
    assert got.keys() == exact.keys() and all(abs(got[v] - exact[v]) <= 0.1 * exact[v] for v in exact)
