import hashlib

import duckdb
import pytest

from papergraph import queries as library
from papergraph.operators import gaps, networks, reports
from papergraph.operators.components import connected_components

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = db.execute(library.ORACLES[name])
    names = [c[0] for c in got.description]
    want = sorted(repr([plain(v) for _, v in sorted(zip(names, row, strict=True))]) for row in got.fetchall())
    df = library.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([plain(v) for _, v in sorted(r.asDict().items())]) for r in df.collect()) == want


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (None, 3), (60, 61)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(path).collect()}
    assert got == {**{i: 0 for i in range(31)}, 60: 60, 61: 60}
    assert connected_components(path.limit(0)).count() == 0


def test_empty_tables(spark):
    links = spark.createDataFrame([], "doc long, item string")
    edges = networks.cooccurrence(links, "doc", "item")
    assert edges.count() == 0
    assert networks.graph_statistics(edges).first().n_nodes == 0
    assert gaps.structural_gaps(edges).count() == 0
    assert reports.trend(links, "doc").count() == 0


def test_whole_edge_tables_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(gaps, "HOT_DEGREE", 5)  # most middle nodes in several parts
    near = {}
    for r in library._supplies(spark, SF).collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    shared = {(a, b): len(near[a] & near[b]) for a in near for b in near if a < b and b not in near[a]}
    got = library.QUERIES["gaps_structural"](spark, SF).collect()
    assert {(r.concept_a, r.concept_b): r.shared for r in got} == {p: n for p, n in shared.items() if n >= 3} and len(got) == len({(r.concept_a, r.concept_b) for r in got})
    reach = {}
    for start in sorted(near):
        todo = [] if start in reach else [start]
        while todo:
            at = todo.pop()
            if at not in reach:
                reach[at] = start
                todo.extend(near[at])
    assert {r.id: r.component for r in library.QUERIES["components"](spark, SF).collect()} == reach
    with_ = {}
    for r in library.QUERIES["coauthor_network"](spark, SF).collect():
        with_.setdefault(r.src, set()).add(r.dst)
        with_.setdefault(r.dst, set()).add(r.src)
    want = {v: round(sum(len(n & with_[u]) for u in n) / (len(n) * (len(n) - 1)), 6) if len(n) > 1 else 0.0 for v, n in with_.items()}
    assert {r.node: r.clustering for r in library.QUERIES["clustering_plain"](spark, SF).collect()} == want


def test_prompts_of_whole_questions(spark, tmp_path):
    start = "a question whose telling words come later "
    spark.createDataFrame([(1, start + "on zebrafish")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "Title\nof zebrafish"), (8, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 0, "user", "hello")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = f"Answer from the records below alone and cite their ids.\n\nRETRIEVED PAPERS:\nPMID:7 | Title\nTitle\nof zebrafish…\n\nUSER QUESTION: {start}on zebrafish"
    assert [tuple(r) for r in library.QUERIES["grounded_prompts"](spark, str(tmp_path)).collect()] == [(1, hashlib.sha256(want.encode()).hexdigest())]


def test_nodes_of_gaps_without_their_pairs(spark, monkeypatch):
    # a and b are alike, c shares three neighbours with them, d only two; e has no like
    edges = spark.createDataFrame([(x, y) for x, ys in {"a": "1234", "b": "1234", "c": "123", "d": "12", "e": "9"}.items() for y in ys], "src string, dst string")
    want = {v for r in gaps.structural_gaps(edges).collect() for v in (r.concept_a, r.concept_b)}
    scores = gaps.structural_gaps(edges, adjusted=True)
    assert {tuple(r) for r in scores.selectExpr("score", "adjusted_score").collect()} == {tuple(r) for r in gaps.structural_gaps(edges).selectExpr("score", "round(score * 1.5D, 4)").collect()}
    whole = {r.node for r in gaps.gap_nodes(library.QUERIES["gap_report"](spark, SF)).collect()}

    def never(*args, **kw):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(gaps, "_expanded", never)
    assert {r.node for r in gaps.structural_nodes(edges).collect()} == want == {"a", "b", "c", "1", "2", "3"} | ({"4"} & want)
    got = [r.node for r in library.QUERIES["gap_nodes"](spark, SF).collect()]
    assert set(got) == whole and len(got) == len(whole)
