"""Betweenness by joins, network and graph reports, filters."""

import heapq
import itertools
import random

import pytest

from papergraph.operators import knowledge, networks, records


def brute_betweenness(nodes, edges):
    near = {v: {} for v in nodes}
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[b][a] = min(w, near[a].get(b, w))
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        best, heap, found = None, [(0, (s,))], []
        while heap:
            d, path = heapq.heappop(heap)
            if best is not None and d > best:
                break
            if path[-1] == t:
                best = d
                found.append(path)
                continue
            for v, w in near[path[-1]].items():
                if v not in path:
                    heapq.heappush(heap, (d + w, (*path, v)))
        for path in found:
            for v in path[1:-1]:
                out[v] += 1 / len(found)
    n = len(nodes)
    return {v: round(x / max((n - 1) * (n - 2), 1), 6) for v, x in out.items()}


def test_betweenness_against_brute_force(spark):
    edges = [("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("c", "d", 1), ("d", "e", 2), ("c", "e", 3), ("e", "f", 1), ("f", "g", 1), ("e", "g", 2), ("h", "i", 1), ("a", "a", 9)]
    nodes = list("abcdefghij")
    got = {r.node: r.betweenness for r in knowledge.betweenness(spark.createDataFrame(edges, "src string, dst string, weight long"), spark.createDataFrame([(v,) for v in nodes], "node string")).collect()}
    want = brute_betweenness(nodes, edges)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 2e-6 for v in nodes)


def test_network_report(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1)], "src string, dst string, weight long")
    nodes = spark.createDataFrame([(v,) for v in "abcde"], "node string")
    parts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 3)], "node string, community int")
    central = {"betweenness": knowledge.betweenness(edges, nodes), "closeness": knowledge.closeness(edges, nodes)}
    got = {(r.figure, r.rank): (r.node, r.value) for r in networks.network_report(edges, nodes, parts, central, 2).collect()}
    assert got["node_count", 0][1] == 5 and got["edge_count", 0][1] == 4 and got["density", 0][1] == 0.4 and got["community_count", 0][1] == 3
    assert got["avg_clustering", 0][1] == pytest.approx((1 + 1 + 1 / 3) / 5, abs=1e-6) and got["modularity", 0][1] == pytest.approx(3 / 4 - (7 / 8) ** 2 - (1 / 8) ** 2, abs=1e-5)
    assert got["top_degree", 1] == ("c", 0.75) and got["top_degree", 2] == ("a", 0.5) and got["top_betweenness", 1] == ("c", round(2 * 2 / 12, 6)) and got["top_closeness", 1] == ("c", 0.75)


def test_filter_drops_edges_of_little_evidence_and_weight(spark):
    nodes = spark.createDataFrame([("Gene A", "GENE"), ("gene b", "GENE"), ("Drug", None)], "label string, entity_type string")
    edges = spark.createDataFrame([("Gene A", "r", "gene b", 1), ("gene b", "r", "Gene A", 3), ("gene b", "s", "Gene A", 9), ("Gene A", "r", "Drug", 9)], "src string, relation string, dst string, weight long")
    evidence = spark.createDataFrame([("Gene A", "r", "gene b", 1), ("Gene A", "r", "gene b", 2)], "src string, relation string, dst string, doc_id long")
    kept, inner = knowledge.kg_filter(nodes, edges, evidence, ["GENE"], "GENE", ["r"], 3)
    assert {r.label for r in kept.collect()} == {"Gene A", "gene b"} and [tuple(r) for r in inner.collect()] == [("gene b", "r", "Gene A", 3)]
    assert len(knowledge.kg_filter(nodes, edges, evidence, least=2)[1].collect()) == 4
    assert [r.label for r in knowledge.kg_filter(nodes, edges, evidence, ["UNKNOWN"])[0].collect()] == ["Drug"]


def test_payload(spark):
    rows = spark.createDataFrame([("1", "t", "x\ny" * 200, ["A", "", "C", "D"], 0.879), ("2", None, None, ["A"], None)], "pmid string, title string, abstract string, names array<string>, score double")
    got = records.display_payload(rows).orderBy("pmid").collect()
    assert got[0].people == "A; C et al. (+1)" and got[0].excerpt == ("x y" * 100) + "…" and got[0].percent == 87
    assert got[1].people == "A" and got[1].excerpt == "" and got[1].percent is None


def test_keyword_report_ties_as_first_seen(spark):
    words = spark.createDataFrame([(1, 0, " Gene"), (1, 1, "cell"), (2, 0, "CELL"), (3, 0, "")], "doc long, at int, item string")
    heads = spark.createDataFrame([(1, 0, "drug"), (2, 0, "gene"), (2, 1, "drug"), (0, 0, "late")], "doc long, at int, item string")
    assert [tuple(r) for r in networks.keyword_report([("keyword", words), ("heading", heads)], 3).collect()] == [(1, "gene", 2, "keyword"), (2, "cell", 2, "keyword"), (3, "drug", 2, "heading")]


@pytest.mark.parametrize("chunk", [10**6, 3])
def test_clustering_in_groups_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(networks, "CHUNK_WEDGES", chunk)  # 3: paths are looked up in sorted pairs
    rng = random.Random(7)
    weights = {pair: rng.randint(1, 9) for pair in itertools.combinations(range(24), 2) if rng.random() < 0.4} | {(100, 101): 3}
    near, top = {}, max(weights.values())
    for (a, b), w in weights.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    edges = spark.createDataFrame([(f"n{b}", f"n{a}", w) for (a, b), w in weights.items()] + [("n0", "n0", 5)], "src string, dst string, weight long")
    for weighted in (False, True):
        got = {r.node: r.clustering for r in networks.clustering(edges, weighted, task_pairs=40).collect()}
        want = {}
        for v, ns in near.items():
            values = [(ns[a] * ns[b] * near[a][b]) ** (1 / 3) / top if weighted else 1 for a, b in itertools.combinations(ns, 2) if b in near[a]]
            want[f"n{v}"] = 2 * sum(values) / (len(ns) * (len(ns) - 1)) if len(ns) > 1 else 0.0
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 2e-6 for v in want)


def test_clustering_sends_few_bytes_for_a_pair(spark, monkeypatch):
    tables, write = {}, networks.written
    monkeypatch.setattr(networks, "written", lambda df, name, *args, **kw: tables.setdefault(name, []).append(write(df, name, *args, **kw)) or tables[name][-1])
    monkeypatch.setattr(networks, "forget", lambda df: None)
    rng = random.Random(5)
    weights = {pair: rng.choice([1, 2, 70000, 2.5]) for pair in itertools.combinations(range(120), 2) if rng.random() < 0.6}
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in weights.items()] + [(b, a, 0.5) for a, b in list(weights)[::3]] + [(3, 3, 9.0), (None, 4, 1.0)], "src long, dst long, weight double")
    near = {}
    for (a, b), w in weights.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    for weighted in (False, True):
        got = {r.node: r.clustering for r in networks.clustering(edges, weighted, task_pairs=1200).collect()}
        for v, ns in near.items():
            sums = sum((ns[a] * ns[b] * near[a][b]) ** (1 / 3) / 70000 if weighted else 1 for a, b in itertools.combinations(ns, 2) if b in near[a])
            assert got[v] == pytest.approx(2 * sums / (len(ns) * (len(ns) - 1)), abs=2e-6)
        assert got.keys() == near.keys()
    plain = tables["clustering-blocks"][0].collect()
    assert sum(sum(len(r[c]) for c in ("xs", "xc", "ys")) for r in plain) < 4 * len(weights)
    assert len(tables["clustering-corners"]) == 2 * 2  # two rounds of seven groups, plain and weighted: a block goes to four tasks at a time


def test_mean_of_clustering_half_way_between_digits(spark):
    # two nodes have 0.666667, two 1, four 0
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("a", "d", 1)], "src string, dst string, weight long")
    nodes = spark.createDataFrame([(v, 1) for v in "abcdefgh"], "node string, community int")
    got = {r.figure: r.value for r in networks.network_report(edges, nodes, nodes).where("rank = 0").collect()}
    assert got["avg_clustering"] == 0.416667  # (2 * 0.666667 + 2) / 8 = 0.41666675
