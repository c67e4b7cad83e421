"""Text functions, linkage, extraction and parsing on small fixtures, and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from papergraph.functions import text as T
from papergraph.operators import context, gaps, knowledge, linkage, mentions, records, topics
from papergraph.operators.communities import communities
from papergraph.sources import sinks
from papergraph.sources.articles import read_articles


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select(column("x").alias("y"), "i").orderBy("i").collect()]


def test_author_names(spark):
    got = values(spark, T.author_name, ["José García", "garcía, josé", "Wei", "mcDONALD, ANNE-marie", "A,B,C", "", None])
    assert got == ["Garcia, Jose", "Garcia, Jose", "Wei", "Mcdonald, Anne-marie", "A, B,c", "", ""]
    assert values(spark, T.author_short, ["Smith, John a", "Wei", None]) == ["Smith JA", "Wei", ""]


def test_partial_dates(spark):
    raw = ["2003-04-05", "2003-04", "2003", "2003 Nov 7", "2003 Nov-Dec", "2003 Spring", "May 2003", "7 May 2003", "2003/4/7", "2003-13", "x", None]
    want = ["2003-04-05", "2003-04", "2003", "2003-11-07", "2003", "2003", "2003-05", "2003-05-07", "2003-04-07", "2003-13", None, None]
    assert values(spark, T.partial_date, raw) == want


def test_abstracts_and_keywords(spark):
    assert values(spark, T.clean_abstract, ["A.\n© 2020 X. tail\nB", "All Rights Reserved.", "<b>p</b>&lt;0.05", "a\tb\r\nc", "", None]) == ["A.\n\nB", None, "p <0.05", "a\tb\nc", None, None]
    assert values(spark, T.keyword, [" «Élan»  vital. ", "e\u0301", None]) == ["élan» vital", "é", ""]
    assert values(spark, T.short_label, [["mutation", "mutations", "gene", "Gene x", "b", "c"]], "array<string>") == ["mutation, gene, b"]


def brute_ratio(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return round(200 * rows[-1][-1] / (len(a) + len(b)))


def test_titles_and_names_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "omega", "sigma", "theta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 14))) for _ in range(25)]
    titles = list(base)
    for t in base:
        for _ in range(3):
            i = rng.randrange(len(t))
            titles.append(t[:i] + rng.choice("abxyz") + t[i + rng.choice([0, 1]) :])
        titles.append(" ".join(reversed(t.split())).upper() + "!")
    titles += ["", None, "", "a"]
    rng.shuffle(titles)
    plain = [" ".join(sorted("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())) for t in titles]
    kept = []
    for i, t in enumerate(plain):
        if not t or not any(plain[j] and brute_ratio(plain[j], t) >= 95 for j in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(titles)), "i long, title string")
    assert sorted(r.i for r in linkage.dedup_titles(df, "title", "i").collect()) == kept

    names = sorted({f"{last}, {fore}" for last in ("Smith", "Smyth", "Wei", "Weiss") for fore in ("J", "John", "John A", "Jane", "Jonathan", "")} | {"John Smith", "Wei"})
    def match(a, b):
        if brute_ratio(*(" ".join(sorted("".join(c if c.isalnum() else " " for c in n.lower()).split())) for n in (a, b))) >= 90:
            return True
        (la, _, fa), (lb, _, fb) = a.lower().partition(","), b.lower().partition(",")
        fa, fb = fa.strip(), fb.strip()
        return la.strip() == lb.strip() and bool(fa) and bool(fb) and (fa.startswith(fb) or fb.startswith(fa))
    want, left = {}, list(names)
    while left:
        cluster = [n for n in left if n == left[0] or match(left[0], n)]
        want |= dict.fromkeys(cluster, max(cluster, key=len))
        left = [n for n in left if n not in cluster]
    df = spark.createDataFrame([(n,) for n in [*names, names[0], "", None]], "name string")
    assert {r.name: r.canonical for r in linkage.canonical_names(df, "name").collect()} == want


def test_entities_and_relations(spark):
    text = "TP53 drives carcinoma. TP53 and BRCA1 bind imatinib in melanoma! THE apoptosis of TP53."
    docs = spark.createDataFrame([(1, text), (2, None), (None, text), (3, "")], "doc_id long, text string")
    entities, relations = mentions.extract_corpus(docs, "doc_id", "text")
    got = [(r.doc_id, r.entity_text, r.entity_type) for r in entities.orderBy("doc_id", "ord").collect()]
    assert got == [(1, "TP53", "GENE_OR_GENOME"), (1, "carcinoma", "DISEASE"), (1, "BRCA1", "GENE_OR_GENOME"), (1, "melanoma", "DISEASE"), (1, "imatinib", "CHEMICAL"), (1, "apoptosis", "DISEASE"), (1, "apoptosis", "BIOLOGICAL_PROCESS")]
    pairs = {(r.source_entity, r.target_entity): r.relationship_type for r in relations.collect()}
    assert pairs[("TP53", "carcinoma")] == "associated_with" and pairs[("TP53", "imatinib")] == "interacts_with" and pairs[("TP53", "apoptosis")] == "regulates"
    assert pairs[("melanoma", "imatinib")] == "treated_by" and len(pairs) == 8


def test_articles(spark, tmp_path):
    good = "<PubmedArticle><PMID>1</PMID><ArticleTitle>A <i>b</i> &amp; c</ArticleTitle><Abstract><AbstractText Label='x' Label2='y'>no</AbstractText></Abstract><AuthorList><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>L</LastName></Author></AuthorList><PubDate><MedlineDate>2003 Nov-Dec</MedlineDate></PubDate></PubmedArticle>"
    issue = "<PubmedArticle><PMID>2</PMID><Journal><JournalIssue><PubDate><MedlineDate>2003 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f"<PubmedArticleSet>{good}<PubmedArticle><ArticleTitle>no id</ArticleTitle></PubmedArticle>{issue}</PubmedArticleSet>")
    rows = {r.pmid: r for r in read_articles(spark, str(tmp_path), "q").collect()}
    assert set(rows) == {"1", "2"} and rows["1"].title == "A b & c" and [a.name for a in rows["1"].authors] == ["Group", "L"]
    assert rows["2"].pub_date == "2003-11" and rows["2"].title is None and rows["2"].keywords == []


def test_clean_records_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "A title of some length here", "José García", 1), ("1", "Other", "x", 2), ("2", "A title of some length here!", "y", 3), ("3", None, None, 4)], "pmid string, title string, a string, row_ord long")
    author = F.struct(F.col("a").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("last_name", "fore_name", "initials", "affiliation", "normalized_name")])
    got = {r.pmid: r for r in records.clean_records(df.withColumn("authors", F.array(author)).drop("a")).collect()}
    assert set(got) == {"1", "3"} and got["1"].first_author == "Garcia, Jose" and got["3"].keyword_count == 0
    nodes, edges = spark.createDataFrame([("a",)], "label string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    assert {r.kind: r.json for r in sinks.graph_lines(nodes, edges).collect()}["statistics"] == '{"node_count":1,"edge_count":1}'
    sinks.save_relations(edges, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect() == edges.collect()


def test_gap_degrees_and_evidence(spark):
    edges = spark.createDataFrame([("a", "m"), ("a", "m"), ("m", "a"), ("a", "n"), ("a", "o"), ("b", "m"), ("b", "n"), ("b", "o"), ("c", "m"), ("c", "n")], "src string, dst string")
    rows = [r.asDict() for r in gaps.structural_gaps(edges).collect()]
    assert {"concept_a": "a", "concept_b": "b", "shared": 3, "degree_a": 4, "degree_b": 3, "score": 10.3923} in rows and all(r["concept_b"] != "c" for r in rows)
    evidence = spark.createDataFrame([("a", "r", "m", i) for i in range(12)] + [("b", "r", "n", 40)], "src string, relation string, dst string, doc_id long")
    got = {(r.concept_a, r.concept_b): r for r in gaps.gap_evidence(spark.createDataFrame([("a", "b")], "concept_a string, concept_b string"), edges, evidence).collect()}
    assert got["a", "b"].evidence == list(range(10)) and got["a", "b"].neighbours == ["m", "n", "o"]


def test_communities_and_closeness(spark):
    rows = [(f"a{i}", f"a{j}", 1) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 1) for i in range(5) for j in range(i)] + [("a0", "b0", 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight long")
    got = {}
    for r in communities(edges).collect():
        got.setdefault(r.community, set()).add(r.node[0])
    assert sorted(map(sorted, got.values())) == [["a"], ["b"]]
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, weight long")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert {r.node: r.closeness for r in knowledge.closeness(path, nodes).collect()} == {"a": 0.444444, "b": 0.666667, "c": 0.444444, "d": 0.0}


def test_responses_and_context(spark):
    full = "1. HYPOTHESIS: h\n2. BIOLOGICAL RATIONALE\nr\n3. SUPPORTING EVIDENCE\nPMID:12345 PMID 12345 pmid: 99999\n4. SUGGESTED EXPERIMENT\ne\n5. CONFIDENCE\nmoderate\n6. NOVELTY\nn"
    rows = spark.createDataFrame([(1, full), (2, "nothing"), (3, "1. HYPOTHESIS\nonly"), (4, None)], "gap_id long, response string")
    got = {r.gap_id: r for r in context.parse_responses(rows).collect()}
    assert set(got) == {1, 3} and got[1].cited == ["12345", "99999"] and got[1].confidence == "Medium" and got[3].confidence == "Low"
    docs = spark.createDataFrame([(i, i, f"t{i}", "apple" if i % 2 else "pear") for i in range(20)], "ord long, doc_id long, title string, abstract string")
    asked = spark.createDataFrame([(1, "apple", "pear", [3, 19])], "gap_id long, concept_a string, concept_b string, evidence array<long>")
    said = context.evidence_context(asked, docs).first().context
    assert [int(p.split("|")[0][6:]) for p in said.split("\n\n")] == [3, 19, 1, 5, 7, 9, 0, 2, 4, 6, 8]


@pytest.mark.parametrize("n, k", [(3, 2), (25, 5), (1000, 10)])
def test_topic_rules(n, k):
    assert topics.topic_count(n) == k and topics.least_topic_size(n) in (3, 5)


def test_isolated_communities_and_auto_trend(spark):
    from papergraph.operators import networks, reports

    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, weight long")
    parts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3)], "node string, community int")
    assert [r.community for r in networks.isolated_communities(edges, parts).collect()] == [3]
    dates = spark.createDataFrame([(d,) for d in ("2001-02", "2001", "2002-03-04", None)], "d string")
    assert {r.period: r.n for r in reports.auto_trend(dates, "d").collect()} == {"2001-02": 1, "2002-03": 1}
    assert {r.period: r.n for r in reports.auto_trend(dates.union(spark.createDataFrame([("2003",)], "d string")), "d").collect()} == {"2001": 2, "2002": 1, "2003": 1}


def test_betweenness_closed_forms(spark):
    from papergraph.operators import knowledge

    def of(rows):
        edges = spark.createDataFrame(rows, "src string, dst string, weight long")
        nodes = edges.selectExpr("src AS node").union(edges.selectExpr("dst")).distinct()
        return {r.node: r.betweenness for r in knowledge.betweenness(edges, nodes).collect()}

    assert of([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1)]) == {"a": 0.0, "b": 0.5, "c": 0.666667, "d": 0.5, "e": 0.0}
    assert of([("a", "b", 1), ("b", "d", 1), ("a", "c", 1), ("c", "d", 1)]) == {k: round(1 / 6, 6) for k in "abcd"}
    assert of([("a", "b", 5), ("a", "c", 1), ("c", "b", 1)]) == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_gaps_of_twins_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(gaps, "LIST_NODES", 3)  # classes in several lists
    names, edges = ["m1", "m2", "m3", "m4"], []
    for i in range(12):  # twelve twins, two other classes
        edges += [(f"s{i:02d}", m) for m in (names if i < 8 else names[:3] if i < 10 else names[1:])]
    edges += [("m4", "m1")]
    near, docs = {}, {}
    for i, (a, b) in enumerate(edges):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        docs.setdefault(a, set()).add(100 - i)
        docs.setdefault(b, set()).add(100 - i)
    want = {(a, b): near[a] & near[b] for a in near for b in near if a < b and b not in near[a] and len(near[a] & near[b]) >= 3}
    rows = spark.createDataFrame(edges, "src string, dst string")
    got = gaps.structural_gaps(rows).collect()
    assert {(r.concept_a, r.concept_b): (r.shared, r.degree_a, r.degree_b) for r in got} == {(a, b): (len(m), len(near[a]), len(near[b])) for (a, b), m in want.items()} and len(got) == len(want)
    kinds = {v: v[0] + v[-1] for v in near}
    types = spark.createDataFrame([*kinds.items(), ("s00", "second")], "label string, entity_type string")
    cross = gaps.cross_domain_gaps(rows, types).collect()
    both = {v: [k] + ["second"] * (v == "s00") for v, k in kinds.items()}
    assert sorted((r.concept_a, r.concept_b, r.type_a, r.type_b) for r in cross) == sorted((a, b, k, q) for a, b in want for k in both[a] for q in both[b] if k != q)
    evidence = spark.createDataFrame([(a, "r", b, 100 - i) for i, (a, b) in enumerate(edges)], "src string, relation string, dst string, doc_id long")
    found = gaps.gap_evidence(None, rows, evidence, k=4).collect()
    assert {(r.concept_a, r.concept_b): (r.n_neighbours, r.neighbours, r.evidence) for r in found} == {p: (len(m), sorted(m), sorted(set().union(*(docs[x] for x in m)))[:4]) for p, m in want.items()}
    asked = spark.createDataFrame([("s01", "s09"), ("s01", "m1"), ("s03", "s04")], "concept_a string, concept_b string")
    told = {(r.concept_a, r.concept_b): r.neighbours for r in gaps.gap_evidence(asked, rows, evidence).collect()}
    assert told == {("s01", "s09"): ["m1", "m2", "m3"], ("s03", "s04"): names, ("s01", "m1"): ["m4"]}


def test_evidence_of_hypotheses_does_not_hang_on_the_length_of_ids(spark):
    asked = spark.createDataFrame([(70000, "a", "b", ["7"])], "gap_id long, concept_a string, concept_b string, evidence array<string>")
    text = "1. HYPOTHESIS\nh\n2. BIOLOGICAL RATIONALE: r\n3. SUPPORTING EVIDENCE\nPMID:80000 PMID:12345\n4. SUGGESTED EXPERIMENT\ne\n5. CONFIDENCE\nhigh\n6. NOVELTY\nn"
    parsed = context.parse_responses(spark.createDataFrame([(70000, text)], "gap_id long, response string"))
    assert context.hypotheses(asked, parsed).first().evidence == ["80000", "12345", "7"]
