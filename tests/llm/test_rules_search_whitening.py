"""Rule cascade, ranked lexical search and whitening: against plain Python, SQL and numpy, and their edges."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from papergraph.llm import lexical, rules, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n long, kept string, score long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts], DOCS)


# rules

WORDS = " ".join(f"word{i} alpha" for i in range(40))
TEXTS = [
    (0, None), (1, ""), (2, "few words"), (3, WORDS), (4, WORDS + "\n" + "\n".join(["same line here"] * 9)), (5, WORDS.upper()), (6, WORDS.replace("alpha", "##")), (7, "\n".join(f"- item{i} of list{i}" for i in range(60))),
    (8, "\n".join(f"alpha{i}b corr{i}d …" for i in range(60))), (9, "the cat " * 60), (10, WORDS), (10, WORDS), (None, WORDS), (11, " ".join(str(1000 + i) for i in range(80))), (12, WORDS + " x" * 40),
    (13, "ab\t\ncd\x0b\x0c\r " * 3), (14, "é" * 30 + " " + WORDS), (15, " ".join(f"w{i}" for i in range(200_000))), (16, "\n\n \n" + WORDS), (17, WORDS + "\n" + "a\nb\na\nb\na\nb\nc"),
]


def base_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_plain_python(spark):
    got = rules.judge(documents(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    want = sorted((i is None, i or 0, *base_by_hand(t)) for i, t in TEXTS)
    assert sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in rules.BASE_COLUMNS)) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert [by[i].rejected_by for i in (0, 1, 2, 3, 6, 8, 9, 10, 11)] == ["base", "base", "base", None, "symbols", "ellipses", "base", None, "letters"]
    assert not by[4].kept and by[5].rejected_by == "capitals" and by[7].rejected_by in ("bullets", "symbols") and by[15].kept
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (r.rejected_by is None) for r in got)


def test_small_runs_give_the_same(spark, monkeypatch):
    docs = documents(spark, TEXTS)
    want = sorted(map(str, rules.judge(docs).drop("rejected_by").collect()))
    monkeypatch.setattr(rules, "RUN_BYTES", 100)
    assert sorted(map(str, rules.judge(docs).drop("rejected_by").collect())) == want


def test_rules_of_empty_tables(spark):
    assert rules.judge(documents(spark, [])).collect() == []
    assert rules.plan(documents(spark, [])) and len(rules.plan(documents(spark, []))) == len(rules.RULES)


def test_order_by_rejections_for_cost():
    def rule(name, *measures):
        return rules.Rule(name, measures, lambda m: m)

    three = (rule("dear", "d"), rule("cheap", "c"), rule("shares", "d"))
    # dear rejects 60 rows for 10 s, cheap 30 for 1 s, shares 5 that dear leaves, once its measure is taken
    masks = {0b001: 50, 0b011: 10, 0b010: 20, 0b100: 5, 0: 15}
    assert rules.in_order(three, masks, {"d": 10.0, "c": 1.0}) == [1, 0, 2]
    assert rules.in_order(three, masks, {"d": 10.0, "c": 1.0}, ("d",)) == [0, 2, 1]
    assert rules.in_order(three, {0: 9}, {"d": 1.0, "c": 2.0}) == [0, 2, 1]


def test_short_circuit_measures_what_is_left(monkeypatch):
    seen = []

    def counted(name, out):
        def measure(texts):
            seen.append((name, len(texts)))
            return {name: np.diff(texts.offsets) if out is None else np.full(len(texts), out)}
        return measure

    monkeypatch.setattr(rules, "MEASURES", {"size": counted("size", None), "never": counted("never", 0)})
    data = np.frombuffer(b"aabbbbcc", np.uint8)
    two = (rules.Rule("long", ("size",), lambda m: m["size"] > 3), rules.Rule("never", ("never", "size"), lambda m: m["never"] > 0))
    verdict = rules.run_cascade(rules.Texts(data, np.array([0, 2, 6, 8])), two, [0, 1], {}, np.array([False, False, True]), ())
    assert verdict.tolist() == [-1, 0, -2] and seen == [("size", 2), ("never", 1)]


def test_rules_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).drop("rejected_by")
    want = con.sql(rules.RULES_SQL)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.fetchall())


# lexical search


def search_by_hand(docs, items, k=20):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := find(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = Counter(w for i, t in items if i == item for w in find(t))
        scores = []
        for doc, tf, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in held) + 1)))
            score = sum(times * weight(t) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, times in asked.items() if t in tf)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if u else d, -s) for rank, (s, u, d) in enumerate(sorted(scores)[:k], 1)]
    return out


SEARCHED = [(i, t) for i, t in enumerate(["Red fox", "red FOX!", "fox", "blue Éa éa", None, "", "...", "red red red fox", "x" * 50_000 + " fox", "zzz yy", "fox red"])] + [(20 + i, "red fox") for i in range(60)] + [(3, "blue"), (None, "blue"), (None, "blue")]
ITEMS = [(1, "fox RED"), (2, "blue"), (3, "unknown"), (4, None), (5, "éa Éa, fox fox"), (6, ""), (None, "fox"), (7, "red"), (7, "fox")]


@pytest.mark.parametrize("k,terms,cells", [(20, 200_000, 2_000_000), (3, 200_000, 2_000_000), (5, 2, 1)])
def test_search_against_plain_python(spark, monkeypatch, k, terms, cells):
    monkeypatch.setattr(lexical, "GROUP_TERMS", terms)
    monkeypatch.setattr(lexical, "BLOCK_CELLS", cells)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, score long")
    docs = documents(spark, SEARCHED).repartition(3)
    got = lexical.ranked_search(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(search_by_hand(SEARCHED, ITEMS, k), key=key)


def test_search_of_empty_tables(spark):
    docs, items = documents(spark, SEARCHED), spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).collect() == []
    assert lexical.ranked_search(docs, items.limit(0)).collect() == []


def test_copies_are_one_class(spark, monkeypatch):
    seen = []
    saved = lexical.saved
    monkeypatch.setattr(lexical, "saved", lambda df, name: seen.append((name, saved(df, name))) or seen[-1][1])
    monkeypatch.setattr(lexical, "discard", lambda *tables: None)
    docs = documents(spark, [(i, "red fox") for i in range(300)] + [(1000, "fox")])
    lexical.ranked_search(docs, spark.createDataFrame([(1, "fox red")], "item_id long, text string")).collect()
    classes = dict(seen)["lexical-classes"].collect()
    assert sorted(len(r.ids) for r in classes) == [1, 20]


# whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, component string")


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)).astype(np.float32)
    base[:, 3] = base[:, 1]
    rows = [(i, [float(c) for c in v], 7, "c") for i, v in enumerate(base)]
    bad = [(900, None, 1, "c"), (901, [float("nan")] + [0.0] * 11, 1, "c"), (902, [None] + [0.0] * 11, 1, "c"), (903, [float("inf")] + [0.0] * 11, 1, "c"), (904, [], 1, "c")]
    rows += [(5, rows[5][1], 7, "c"), (None, rows[6][1], 7, "c")]
    got = whitening.whiten(vectors(spark, rows + bad).repartition(5)).collect()
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(np.float64)) + 100_000
    n, exact = len(x), [[int(c) for c in v] for v in x]
    sums = [sum(v[d] for v in exact) for d in range(12)]
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9)) and max(r.identity_error for r in got) < 1e-9
    values = np.linalg.eigvalsh(cov)[::-1]
    for j in range(8):
        one = {(r.vec_id is None, r.vec_id or 0): r for r in got if r.component == j + 1}
        w = np.array([one[i is None, i or 0].whitened for i, *_ in rows])
        axis = centred.T @ w / n / np.sqrt(values[j])
        assert abs(np.linalg.norm(axis) - 1) < 1e-9 and np.abs(cov @ axis - values[j] * axis).max() < 1e-7 * values[0]
        assert abs(one[False, 0].explained - values[j] / values.sum()) < 1e-12
    deviations = {(r.vec_id is None, r.vec_id or 0): r.deviation for r in got}
    assert deviations == {(i is None, i or 0): sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, *_), v in zip(rows, exact, strict=True)}


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")])).collect() == []
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i], 0, "") for i in range(4)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0], 0, ""), (2, [1.0, 2.0], 0, "")]))
    with pytest.raises(Exception, match="2\\^53"):
        whitening.whiten(vectors(spark, [(1, [1e20], 0, ""), (2, [1.0], 0, "")])).collect()


@pytest.mark.parametrize("width,rank", [(1, 1), (2, 2), (7, 3), (33, 33), (40, 12)])
def test_factor_and_rotation(width, rank):
    rng = np.random.default_rng(width)
    a = rng.normal(size=(90, rank)) @ rng.normal(size=(rank, width))
    scatter = a.T @ a
    factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape == (width, rank) and np.allclose(factor @ factor.T, scatter, atol=1e-9 * np.trace(scatter))
    zeros = (factor == 0).sum(axis=1)
    assert sorted(zeros.tolist(), reverse=True)[: rank - 1] == list(range(rank - 1, 0, -1))  # a triangle, in the order of the pivots
    values, vectors = whitening.jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert np.allclose(scatter @ vectors, vectors * values, atol=1e-9 * values[0])
