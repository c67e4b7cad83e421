"""TF-IDF against plain Python, settings that fall back, dense topics and their outliers, topics over time."""

import math
from collections import Counter

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from papergraph.operators import topics


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tf_idf_against_plain_python(spark):
    texts = ["Gene therapy of cells", "cells and gene editing", None, "", "gene therapy gene THERAPY", "éclair of stem cells"]
    vectors, words = topics.tf_idf(docs_of(spark, texts), "doc_id", "text")
    tokens = [["gene", "therapy", "cells"], ["cells", "gene", "editing"], [], [], ["gene", "therapy", "gene", "therapy"], ["éclair", "stem", "cells"]]
    bags = [Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)]) for t in tokens]
    df = Counter(w for b in bags for w in b)
    assert set(words) == {w for w, n in df.items() if n >= 2}
    for r in vectors.collect():
        want = {w: bags[r.doc][w] * (math.log(7 / (1 + df[w])) + 1) for w in words if bags[r.doc][w]}
        norm = math.sqrt(sum(x * x for x in want.values())) or 1
        got = {words[int(i)]: v for i, v in zip(r.features.indices, r.features.values, strict=True)}
        assert got.keys() == want.keys() and all(abs(got[w] - x / norm) < 1e-12 for w, x in want.items())


def test_settings_that_fall_back(spark):
    assert set(topics.tf_idf(docs_of(spark, ["rare words", "never twice"]), "doc_id", "text")[1]) == {"rare", "words", "rare words", "never", "twice", "never twice"}
    assert set(topics.tf_idf(docs_of(spark, ["study of patients"]), "doc_id", "text")[1]) == {"study", "patients"}  # words of any study, without the English ones
    assert set(topics.tf_idf(docs_of(spark, ["É b", " "]), "doc_id", "text")[1]) == {"e", "b", " "}
    vectors, words = topics.tf_idf(docs_of(spark, ["", None]), "doc_id", "text")
    assert words == [] and vectors.count() == 2
    blanks = topics.terms(docs_of(spark, ["ab  c", "", None]), "doc_id", "text", 0, 0).orderBy("doc").collect()
    assert [r.terms for r in blanks] == [[" ", "a", "b", " ", " ", "c", " "], [], []]


def dense(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "doc long, v array<double>").select("doc", array_to_vector("v").alias("features"))


def test_dense_topics(spark):
    rng = np.random.default_rng(2)
    groups = [rng.normal(size=(n, 8)) * 0.1 + rng.normal(size=8) * 6 for n in (40, 25, 30)]
    x = np.concatenate([*groups, groups[0][:1] + 1.2])
    got = {r.doc: r for r in topics.dense_topics(dense(spark, x), 3, 5).collect()}
    sides = [[got[i].topic_id for i in range(a, b)] for a, b in ((0, 40), (40, 65), (65, 95))]
    assert [max(Counter(s)) for s in sides] == [0, 2, 1] and all(set(s) <= {max(s), -1} and s.count(-1) <= 4 for s in sides)
    assert got[95].topic_id == -1 and got[95].probability == 0.0 and all((r.probability == 1.0) == (r.topic_id >= 0) for r in got.values())
    again = {r.doc: r.topic_id for r in topics.dense_topics(dense(spark, x), 3, 5).collect()}
    assert again == {d: r.topic_id for d, r in got.items()}
    assert topics.dense_topics(dense(spark, x[:0]), 3).collect() == []


def test_outliers_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(c), float(d)) for i, (c, d) in enumerate(zip(rng.integers(0, 6, 300), rng.exponential(size=300), strict=True))] + [(900, 7, 1.0), (901, 7, 1.0)]
    got = {r.doc: r.topic_id for r in topics.cut_outliers(spark.createDataFrame(rows, "doc long, cluster int, distance double"), 5, 1.5).collect()}
    near = {}
    for c in {c for _, c, _ in rows}:
        own = [(i, d) for i, cc, d in rows if cc == c]
        most = 1.5 * math.sqrt(sum(d * d for _, d in own) / len(own))
        near[c] = [i for i, d in own if d <= most]
    order = sorted((c for c in near if len(near[c]) >= 5), key=lambda c: (-len(near[c]), c))
    want = {i: -1 for i, _, _ in rows} | {i: n for n, c in enumerate(order) for i in near[c]}
    assert got == want and 7 not in order
    placed = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0)], "doc long, cluster int, distance double")
    assert {r.topic_id for r in topics.cut_outliers(placed, 1, 1.0).collect()} == {0}


def test_outliers_are_in_no_summary_and_no_network(spark):
    assigned = spark.createDataFrame([(1, 0), (2, 0), (3, -1), (1, 1), (4, 5), (2, 5)], "doc long, topic_id int")
    words = spark.createDataFrame([(0, 1, "gene"), (0, 2, "7"), (1, 1, "cell"), (-1, 1, "cell")], "topic_id int, rank int, word string")
    assert [(r.topic_id, r.label, r.paper_count) for r in topics.topic_summary(assigned, words).collect()] == [(0, "gene", 2), (5, "Topic 5", 2), (1, "cell", 1)]
    assert [tuple(r) for r in topics.topic_network(assigned, words).collect()] == [(0, 1, 1)]  # topic 5 has no words
    apart = spark.createDataFrame([(1, 0), (2, 1), (3, -1)], "doc long, topic_id int")
    shared = spark.createDataFrame([(0, 1, "Gene"), (1, 1, "gene"), (-1, 1, "gene"), (0, 2, "x"), (1, 2, "x")], "topic_id int, rank int, word string")
    assert [tuple(r) for r in topics.topic_network(apart, shared).collect()] == [(0, 1, 1)]


def test_ten_starts_are_no_worse_than_one(spark):
    texts = [" ".join(np.random.default_rng(i).choice(["alpha", "beta", "gamma"] if i % 2 else ["delta", "kappa", "sigma"], 20)) for i in range(40)]
    vectors, words = topics.tf_idf(docs_of(spark, texts), "doc_id", "text")
    assigned, centres = topics.fit_topics(vectors, 2)
    by = {}
    for r in assigned.collect():
        by.setdefault(r.topic_id, set()).add(r.doc % 2)
    assert sorted(map(sorted, by.values())) == [[0], [1]] and len(centres[0]) == len(words)


def test_topics_by_ranges_of_years(spark):
    rows = spark.createDataFrame([(i, i % 2, 2000 + i) for i in range(10)] + [(99, 1, None)], "doc long, topic_id int, year int")
    got = topics.topics_over_time(rows.select("doc", "topic_id"), rows.select("doc", "year"), bins=5)
    assert sorted(map(tuple, got.collect())) == [(t, 2000 + 2 * b, 1) for t in (0, 1) for b in range(5)]
    words = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 9, "c")], "topic_id int, rank int, word string")
    with_words = topics.topics_over_time(rows.select("doc", "topic_id"), rows.select("doc", "year"), words, 1).where(F.col("topic_id") == 0).first()
    assert with_words.words == "a, b" and with_words.n == 5
