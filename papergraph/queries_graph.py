"""Registered queries of the knowledge graph, gaps, topics and contexts, on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from papergraph.operators import context, gaps, knowledge, networks, reports, similarity, topics, vectors
from papergraph.operators.communities import communities
from papergraph.operators.storage import written


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mentions(spark, sf_dir):
    """Suppliers (by their nation, as a concept) and part names are entities; an order is a document."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    at = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "s").otherwise(""))
    part = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    source = F.struct(at.alias("ord"), supplier.alias("name"), F.lit("SUPPLIER").alias("entity_type"), F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("concept_id"), F.col("l_orderkey").alias("doc_id"))
    return lines.select(F.explode(F.array(source, F.struct((at + 1).alias("ord"), part.alias("name"), F.lit("PART").alias("entity_type"), F.lit(None).cast("string").alias("concept_id"), F.col("l_orderkey").alias("doc_id")))).alias("m")).select("m.*")


def _kg(spark, sf_dir, counted=True):
    """Nodes, edges and evidence of suppliers that supply parts; every seventh relation has no document, every fifth no confidence."""
    nodes, names = knowledge.canonical_nodes(_mentions(spark, sf_dir), counted)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    relations = lines.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_entity"), F.col("p_name").alias("target_entity"), F.when(F.col("l_returnflag") == "A", "supplies").alias("relationship_type"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey")).alias("doc_id"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")).alias("confidence"),
    )
    return nodes, *knowledge.consolidated_edges(relations, names)


def _edges(spark, sf_dir, counted=False):
    nodes, edges, evidence = _kg(spark, sf_dir, counted)
    return nodes, written(edges, "kg-edges"), evidence


def _statistics(spark, sf_dir):
    nodes, edges, _ = _edges(spark, sf_dir)
    kinds = knowledge.histogram(nodes.withColumnRenamed("entity_type", "kind"), "kind").select(F.lit("entity_type").alias("figure"), "value", "n")
    relations = knowledge.histogram(edges, "relation").select(F.lit("relation").alias("figure"), "value", "n")
    top = knowledge.most_connected(edges).select(F.lit("most_connected").alias("figure"), F.col("node").alias("value"), F.col("degree").alias("n"))
    return kinds.unionByName(relations).unionByName(top)


def _near(spark, sf_dir):
    _, edges, _ = _edges(spark, sf_dir)
    starts = edges.agg(F.min("src").alias("node"))
    return knowledge.neighbourhood(edges, starts, 2)


def _subgraph(spark, sf_dir):
    nodes, edges, _ = _edges(spark, sf_dir, True)
    heavy = nodes.where("weight >= 20 OR lower(label) LIKE '%ring%'").select(F.col("label").alias("node"))
    return knowledge.induced(edges.where("weight >= 2"), heavy).select("src", "relation", "dst", "weight")


def _relation_table(spark, sf_dir):
    nodes, edges, evidence = _edges(spark, sf_dir)
    return knowledge.relation_table(edges, evidence, nodes)


def _suppliers_by_order(spark, sf_dir):
    return networks.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def _simple_edges(spark, sf_dir):
    """Part names that one order holds: a graph of few nodes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return networks.cooccurrence(lines, "l_orderkey", "p_name")


def _communities(spark, sf_dir):
    return communities(_simple_edges(spark, sf_dir))


def _closeness(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_name").alias("node")).distinct()
    return knowledge.closeness(_simple_edges(spark, sf_dir), nodes)


def _betweenness(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_name").alias("node")).distinct()
    return knowledge.betweenness(_simple_edges(spark, sf_dir), nodes)


def _semantic(spark, sf_dir):
    """Nodes are vectors of the embeddings table; every tenth pair of neighbours has an edge already."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("node"), F.col("embedding").alias("vector"))
    edges = rows.where("node % 10 = 0").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    return similarity.similarity_edges(rows, edges, 0.4)


def _semantic_buckets(spark, sf_dir):
    """As semantic_edges, through buckets of random planes."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("node"), F.col("embedding").alias("vector"))
    return similarity.similar_pairs(rows, 0.4, exact=False)


def _semantic_graph(spark, sf_dir):
    """The knowledge graph with edges between like suppliers: an order has the vector of its number in the embeddings."""
    _, edges, evidence = _edges(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), F.col("embedding").alias("vector"))
    return similarity.with_similarity(edges, similarity.similarity_edges(similarity.node_vectors(evidence, rows), edges, 0.25)).select("src", "relation", "dst", "confidence", "weight")


def _near_graph(spark, sf_dir):
    _, edges, _ = _edges(spark, sf_dir)
    return knowledge.neighbourhood_graph(edges, edges.agg(F.min("src").alias("node")), 2).select("src", "relation", "dst", "weight")


def _walked(spark, sf_dir):
    """Nations' customers and orders as a tree: what is within two edges of the largest nation."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    edges = customers.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey")).alias("dst")).unionAll(orders.select(F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("o"), F.col("o_orderkey"))))
    return knowledge.walked(edges, edges.sparkSession.range(1).select(F.lit("n1").alias("node")), 2)


def _closeness_sketch(spark, sf_dir):
    """Suppliers and single parts: more nodes than closeness takes."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    return knowledge.closeness_sketch(lines, lines.select(F.explode(F.array("src", "dst")).alias("node")))


def _typed_keywords(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand"), "l_partkey")
    return networks.typed_frequency([(kind, lines.select(F.col("l_orderkey").alias("doc"), F.col(c).alias("item"))) for kind, c in (("keyword", "p_name"), ("heading", "p_type"), ("substance", "p_brand"))], 3)


def _temporal(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year")), "l_orderkey")
    return networks.temporal_gaps(lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity"), F.col("l_orderkey").alias("doc"), "year"), 6, 1)


def _cross_domain(spark, sf_dir, edges=None, twins=None, adjusted=False):
    """Types of suppliers are their nations' regions."""
    edges = _supplies(spark, sf_dir) if edges is None else edges
    kinds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("label"), (F.col("s_nationkey") % 5).cast("string").alias("entity_type"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_name")).alias("label"), F.lit("part").alias("entity_type")).distinct()
    return gaps.cross_domain_gaps(edges, kinds.unionByName(parts), twins=twins, adjusted=adjusted)


def _supplies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("p_name")).alias("dst")).distinct()


def _report(spark, sf_dir):
    """Rows as they come: SQL asks for no order."""
    edges = written(_supplies(spark, sf_dir), "gaps-edges")
    twins = gaps.twin_classes(edges)
    return gaps.gap_report(gaps.structural_gaps(edges, twins=twins, adjusted=True), _cross_domain(spark, sf_dir, edges, twins, True), _temporal(spark, sf_dir), ranked=False)


def _gap_evidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    evidence = lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("p_name")).alias("dst"), F.col("l_orderkey").alias("doc_id")).distinct()
    return gaps.gap_evidence(None, _supplies(spark, sf_dir), evidence, columns=["n_neighbours", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence")])


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _record_table(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"))


def _retrieval(spark, sf_dir):
    """Questions are the first 40 characters of the items, as the SQL has it."""
    return context.keyword_retrieval(_questions(spark, sf_dir).withColumn("question", F.substring("question", 1, 40)), _record_table(spark, sf_dir))


def _prompts(spark, sf_dir):
    """Questions are whole items."""
    records, asked = _record_table(spark, sf_dir), _questions(spark, sf_dir)
    said = context.record_context(context.keyword_retrieval(asked, records), records)
    history = reports.last_turns(table(spark, sf_dir, "conversations"))
    asked = asked.withColumn("conv_id", F.col("question_id"))
    return context.grounded_prompts(asked, said, history).select("question_id", F.sha2("prompt", 256).alias("prompt_hash"))


def _responses(spark, sf_dir):
    """Responses made of the labelled documents: sections in order, a confidence from the label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    word = F.regexp_extract("text", r"^([A-Za-z]*)", 1)
    text = F.concat(
        F.lit("1. HYPOTHESIS\n"), word, F.lit("\n2. BIOLOGICAL RATIONALE: r\n\n3. SUPPORTING EVIDENCE\nPMID:"), (F.col("doc_id") + 10000).cast("string"), F.lit(" and pmid "), (F.col("doc_id") + 10000).cast("string"),
        F.lit("\n4. SUGGESTED EXPERIMENT\ne\n5. CONFIDENCE\n"), F.when(F.col("quality") == 1, "high").otherwise("Moderate"), F.lit("\n6. NOVELTY\nn"),
    )
    return docs.select(F.col("doc_id").alias("gap_id"), text.alias("response"))


def _parsed(spark, sf_dir):
    return context.parse_responses(_responses(spark, sf_dir)).withColumn("cited", F.array_join("cited", ","))


def _hypotheses(spark, sf_dir):
    parsed = context.parse_responses(_responses(spark, sf_dir))
    asked = parsed.select("gap_id", F.concat(F.lit("a"), F.col("gap_id").cast("string")).alias("concept_a"), F.lit("b").alias("concept_b"), F.array(F.lit("7")).alias("evidence"))
    rows = context.hypotheses(context.without_cached(asked, asked.where("gap_id % 3 = 0").select(F.upper("concept_a").alias("concept_a"), "concept_b")), parsed)
    return rows.select("gap_id", "concept_a", "confidence_score", F.array_join("evidence", ",").alias("evidence"))


def _topics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors, terms = topics.tf_idf(docs, "doc_id", "text")
    assigned, centres = topics.fit_topics(vectors, topics.topic_count(docs.count()))
    return topics.topic_summary(assigned, topics.centre_words(spark, centres, terms))


def _dense(spark, sf_dir):
    """Topics of the vectors; a vector stands for the document of its number."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("doc"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n = rows.count()
    return topics.dense_topics(rows, topics.topic_count(n), topics.least_topic_size(n))


def _dense_topics(spark, sf_dir):
    return _dense(spark, sf_dir).select("doc", "topic_id", "probability", F.round("distance", 6).alias("distance"))


def _dense_summary(spark, sf_dir):
    """The summary of the dense topics, with words from the documents' texts; outliers are left out."""
    assigned = written(_dense(spark, sf_dir), "topics-dense")
    texts = assigned.where("topic_id >= 0").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    words = topics.class_words(texts, "topic_id", "text").withColumnRenamed("topic", "topic_id")
    return topics.topic_summary(assigned, words)


def _binned(spark, sf_dir):
    """Topics by ten ranges of years, with words: the topics are order priorities, their words the priorities' own."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 6).cast("int").alias("topic_id"), F.year("o_orderdate").alias("year"), "o_orderpriority")
    words = topics.class_words(rows, "topic_id", "o_orderpriority", 3).withColumnRenamed("topic", "topic_id")
    return topics.topics_over_time(rows.select("doc", "topic_id"), rows.select("doc", "year"), words, 3, 2)


def _class_words(spark, sf_dir):
    return topics.class_words(table(spark, sf_dir, "documents"), "source", "text")


def _over_time(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 6).cast("int").alias("topic_id"), F.year("o_orderdate").alias("year"))
    return topics.topics_over_time(rows.select("doc", "topic_id"), rows.select("doc", "year"))


def _topic_network(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 12).cast("int").alias("topic_id"))
    return topics.topic_network(lines, lines.select("topic_id", F.lit("w").alias("word")))


def _valid_topic_network(spark, sf_dir):
    """Topics are parts' numbers mod 14, less one, of which only those below twelve have words; -1 are outliers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 14 - 1).cast("int").alias("topic_id"))
    return topics.topic_network(lines, lines.where("topic_id < 12").select("topic_id", F.lit("word").alias("word")).distinct())


def _trend(spark, sf_dir):
    """Events are of one month, orders of years: the one by month, the other by year."""
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("d"))
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("d"))
    return reports.auto_trend(events, "d").unionByName(reports.auto_trend(orders, "d"))


def _pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 6 - 1).alias("topic"), F.year("o_orderdate").alias("year"), F.concat(F.lit("topic of customers, number "), (F.col("o_custkey") % 6).cast("string"), F.lit(" of six")).alias("label"))
    return reports.topic_pivot(rows, "topic", "year", "label", 28)


def _common(spark, sf_dir):
    return reports.most_common(table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_partkey", "at")


def _by_topic(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 6).alias("topic"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("title"), "o_orderkey")
    return reports.records_by_topic(rows, "topic", "year", "title", "o_orderkey")


def _panel(spark, sf_dir):
    return reports.cluster_panel(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("community")))


def _isolated(spark, sf_dir):
    """Suppliers meet in orders; a nation is a community."""
    edges = networks.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
    return networks.isolated_communities(edges, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community")))


def _citations(spark, sf_dir):
    """Orders refer to the order of the number of each of their parts."""
    references = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("ref"))
    return networks.citations(references, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc")))


def _coupling(spark, sf_dir):
    return networks.shared_references(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("ref")), 2)


def _gap_filter(spark, sf_dir):
    return gaps.two_concepts(gaps.gaps_with(_report(spark, sf_dir), ["structural", "cross_domain"], "RING")).select("kind", "concept_a", "concept_b")


def _gap_nodes(spark, sf_dir):
    """Without the pairs: a structural gap's nodes are told by their classes, and a cross-domain gap is a structural one."""
    edges = written(_supplies(spark, sf_dir), "gaps-edges")
    return gaps.structural_nodes(edges).unionAll(_temporal(spark, sf_dir).select(F.col("entity").alias("node"))).distinct()


def _search(spark, sf_dir):
    """Rows of the hits, gated: a query whose best score is below 0.3 gets nothing."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    hits = vectors.cosine_top_k(rows.select("vec_id", "embedding"), rows.where("vec_id % 100 = 0").select((F.col("vec_id") + 0).alias("query_id"), F.transform("embedding", lambda x, i: F.when(i < 8, x).otherwise(0.0)).alias("embedding")), 5, 0.3)
    return hits.join(rows.select("vec_id", "label"), "vec_id").select("query_id", "rank", "vec_id", "score", "label")


QUERIES = {
    "kg_nodes": lambda s, d: _kg(s, d)[0], "kg_edges": lambda s, d: _kg(s, d)[1], "kg_evidence": lambda s, d: _kg(s, d)[2], "kg_statistics": _statistics, "neighbourhood": _near, "subgraph_filter": _subgraph, "relation_table": _relation_table,
    "top_relations": lambda s, d: knowledge.top_relations(_kg(s, d)[1]), "top_connected": lambda s, d: knowledge.top_connected(_kg(s, d)[1]), "communities": _communities, "closeness": _closeness, "betweenness": _betweenness, "semantic_edges": _semantic, "semantic_edges_buckets": _semantic_buckets, "kg_with_similarity": _semantic_graph, "neighbourhood_graph": _near_graph, "neighbourhood_walked": _walked, "closeness_sketch": _closeness_sketch,
    "typed_keywords": _typed_keywords, "gaps_cross_domain": _cross_domain, "gap_report": _report, "gap_evidence": _gap_evidence, "keyword_retrieval": _retrieval, "grounded_prompts": _prompts, "parsed_responses": _parsed, "hypotheses": _hypotheses,
    "topics": _topics, "topics_dense": _dense_topics, "topics_dense_summary": _dense_summary, "topics_binned": _binned, "topic_class_words": _class_words, "topics_over_time": _over_time, "topic_network": _topic_network, "topic_network_valid": _valid_topic_network,
    "trend_auto": _trend, "topic_pivot": _pivot, "most_common": _common, "records_by_topic": _by_topic, "cluster_panel": _panel, "isolated_communities": _isolated, "citations": _citations, "shared_references": _coupling,
    "gap_filter": _gap_filter, "gap_nodes": _gap_nodes, "semantic_search": _search,
}

_MENTIONS = """l AS (SELECT *, l_orderkey * 100 + l_linenumber * 10 AS at0 FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT at0 AS ord, 'S' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN 's' ELSE '' END AS name, 'SUPPLIER' AS kind, 'C' || l_suppkey AS concept, l_orderkey AS doc FROM l
  UNION ALL SELECT at0 + 1, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END, 'PART', NULL, l_orderkey FROM l),
k AS (SELECT *, coalesce(concept, lower(name)) || '||' || kind AS key FROM m),
c AS (SELECT key, arg_min(name, length(name) * 1000000000000 + ord) AS label, any_value(kind) AS entity_type, any_value(concept) AS concept_id, count(DISTINCT doc) AS paper_count FROM k GROUP BY key)"""
_EDGES = f"""{_MENTIONS}, r AS (SELECT s.label AS src, CASE WHEN l_returnflag = 'A' THEN 'supplies' ELSE 'associated_with' END AS relation, t.label AS dst,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey END AS doc_id, CASE WHEN l_orderkey % 5 <> 0 AND l_discount <> 0 THEN l_discount ELSE 0.7 END AS conf
  FROM l JOIN c s ON s.concept_id = 'C' || l_suppkey JOIN c t ON t.key = lower(p_name) || '||PART'),
e AS (SELECT src, relation, dst, max(conf) AS confidence, count(DISTINCT doc_id) AS weight FROM r GROUP BY ALL HAVING count(doc_id) > 0)"""
_GAPS = """e AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || p_name AS dst FROM lineitem JOIN part ON p_partkey = l_partkey), near AS (SELECT src AS node, dst AS mid FROM e UNION SELECT dst, src FROM e),
d AS (SELECT node, count(*) AS d FROM near GROUP BY node),
w AS (SELECT x.node AS a, y.node AS b, count(*) AS shared FROM near x JOIN near y ON x.mid = y.mid AND x.node < y.node WHERE NOT EXISTS (SELECT 1 FROM near z WHERE z.node = x.node AND z.mid = y.node) GROUP BY ALL HAVING count(*) >= 3),
kinds AS (SELECT 'S' || s_suppkey AS label, (s_nationkey % 5)::VARCHAR AS kind FROM supplier UNION SELECT 'P' || p_name, 'part' FROM part),
g AS (SELECT a, b, shared, round(shared * sqrt(x.d * y.d), 4) AS score FROM w JOIN d x ON x.node = a JOIN d y ON y.node = b),
x AS (SELECT a, b, shared, p.kind AS type_a, q.kind AS type_b FROM w JOIN kinds p ON p.label = a JOIN kinds q ON q.label = b WHERE p.kind <> q.kind)"""

ORACLES = {
    "kg_nodes": f"WITH {_MENTIONS} SELECT label, entity_type, concept_id, paper_count, greatest(paper_count, 1) AS weight FROM c",
    "kg_edges": f"WITH {_EDGES} SELECT src, relation, dst, confidence, weight FROM e",
    "kg_evidence": f"WITH {_EDGES} SELECT DISTINCT src, relation, dst, doc_id FROM r WHERE doc_id IS NOT NULL",
    "kg_statistics": f"""WITH {_EDGES}, g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT 'entity_type' AS figure, entity_type AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'relation', relation, count(*) FROM e GROUP BY ALL
UNION ALL (SELECT 'most_connected', node, n FROM g ORDER BY n DESC, node LIMIT 1)""",
    "neighbourhood": f"""WITH {_EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT min(src) AS node FROM e), h1 AS (SELECT DISTINCT y AS node FROM b JOIN h0 ON x = node),
h2 AS (SELECT DISTINCT y AS node FROM b JOIN h1 ON x = node) SELECT node, min(hops)::INT AS hops FROM (SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node""",
    "subgraph_filter": f"""WITH {_EDGES}, n AS (SELECT label FROM c WHERE greatest(paper_count, 1) >= 20 OR lower(label) LIKE '%ring%') SELECT src, relation, dst, weight FROM e WHERE weight >= 2 AND src IN (FROM n) AND dst IN (FROM n)""",
    "relation_table": f"""WITH {_EDGES}, v AS (SELECT src, relation, dst, array_to_string(list_sort(list(DISTINCT doc_id))[1:3], ',') AS evidence FROM r WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT src, 'SUPPLIER' AS source_type, relation, dst, 'PART' AS target_type, round(confidence, 3) AS confidence, weight, evidence FROM e JOIN v USING (src, relation, dst)""",
    "top_relations": f"WITH {_EDGES}, n AS (SELECT src AS node, relation, count(*) AS n FROM e GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, relation)::INT AS rank FROM n) SELECT * FROM q WHERE rank <= 3",
    "top_connected": f"""WITH {_EDGES}, n AS (SELECT node, other, sum(weight)::BIGINT AS weight FROM (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other)::INT AS rank FROM n) SELECT * FROM q WHERE rank <= 3""",
    "semantic_edges": """WITH v AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM v a JOIN v b ON a.id < b.id)
SELECT * FROM s WHERE score >= 0.4 AND NOT (a % 10 = 0 AND b = a + 1)""",
    "kg_with_similarity": f"""WITH {_EDGES}, v AS (SELECT DISTINCT src AS node, r.doc_id, embedding::DOUBLE[] AS x FROM r JOIN embeddings ON vec_id = r.doc_id),
u AS (SELECT node, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v), n AS (SELECT node, list(a ORDER BY i) AS x FROM (SELECT node, i, avg(x) AS a FROM u GROUP BY ALL) GROUP BY node),
s AS (SELECT p.node AS a, q.node AS b, list_cosine_similarity(p.x, q.x) AS score FROM n p JOIN n q ON p.node < q.node)
SELECT src, relation, dst, confidence, weight FROM e UNION ALL SELECT a, 'semantic_similarity', b, round(score, 6), 1 FROM s WHERE round(score, 6) >= 0.25 AND NOT EXISTS (SELECT 1 FROM e WHERE src = a AND dst = b)""",
    "neighbourhood_graph": f"""WITH {_EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT min(src) AS node FROM e), h1 AS (SELECT y AS node FROM b JOIN h0 ON x = node UNION FROM h0),
h2 AS (SELECT y AS node FROM b JOIN h1 ON x = node UNION FROM h1) SELECT src, relation, dst, weight FROM e WHERE src IN (FROM h2) AND dst IN (FROM h2)""",
    "neighbourhood_walked": """SELECT 'n1' AS node, 0 AS hops UNION ALL SELECT DISTINCT 'c' || c_custkey, 1 FROM customer WHERE c_nationkey = 1
UNION ALL SELECT DISTINCT 'o' || o_orderkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 1""",
    "typed_keywords": """WITH l AS (SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey), k AS (SELECT l_orderkey AS doc, lower(trim(p_name)) AS item, 0 AS at0 FROM l UNION ALL SELECT l_orderkey, lower(trim(p_type)), 1 FROM l UNION ALL SELECT l_orderkey, lower(trim(p_brand)), 2 FROM l)
SELECT item, count(*) AS n, ['keyword', 'heading', 'substance'][arg_min(at0, doc * 10 + at0) + 1] AS source_type FROM k WHERE item <> '' GROUP BY item HAVING count(*) >= 3""",
    "gaps_cross_domain": f"WITH {_GAPS} SELECT a AS concept_a, b AS concept_b, shared, type_a, type_b, shared::DOUBLE AS score FROM x",
    "gap_report": f"""WITH {_GAPS}, r AS (SELECT 'S' || l_suppkey AS entity, l_orderkey AS doc, year(o_orderdate) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), q AS (SELECT max(year) AS last FROM r),
t AS (SELECT entity, 2.0::DOUBLE * count(*) FILTER (year >= last - 6 AND year < last - 1) AS score FROM r, q GROUP BY entity HAVING count(*) FILTER (year >= last - 6 AND year < last - 1) >= 3 AND count(*) FILTER (year >= last - 1) = 0)
SELECT 'structural' AS kind, a AS concept_a, b AS concept_b, score, round(score * 1.5, 4) AS adjusted_score FROM g UNION ALL SELECT 'cross_domain', a, b, shared::DOUBLE, round(shared * 1.2, 4) FROM x UNION ALL SELECT 'temporal', entity, NULL, score, round(score, 4) FROM t""",
    "gap_evidence": f"""WITH {_GAPS}, ev AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || p_name AS dst, l_orderkey AS doc FROM lineitem JOIN part ON p_partkey = l_partkey), near_docs AS (SELECT src AS mid, doc FROM ev UNION SELECT dst, doc FROM ev),
first AS (SELECT mid, doc FROM near_docs QUALIFY row_number() OVER (PARTITION BY mid ORDER BY doc) <= 10), mids AS (SELECT w.a, w.b, x.mid FROM w JOIN near x ON x.node = w.a JOIN near y ON y.node = w.b AND y.mid = x.mid)
SELECT a AS concept_a, b AS concept_b, count(DISTINCT mids.mid)::INT AS n_neighbours, array_to_string(list_sort(list(DISTINCT doc))[1:10], ',') AS evidence FROM mids JOIN first USING (mid) GROUP BY ALL""",
    "keyword_retrieval": """WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(substr(text, 1, 40)), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) >= 4)) AS t, lower(substr(text, 1, 20)) AS whole FROM benchmark),
s AS (SELECT item_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [whole] END) AS t FROM q), d AS (SELECT doc_id, lower(coalesce(split_part(text, chr(10), 1), '') || ' ' || coalesce(text, '')) AS text FROM documents),
h AS (SELECT DISTINCT item_id, doc_id FROM s JOIN d ON contains(d.text, s.t)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id)::INT AS rank FROM h) SELECT item_id AS question_id, rank, doc_id FROM r WHERE rank <= 5""",
    "parsed_responses": """WITH r AS (SELECT doc_id AS gap_id, regexp_extract(text, '^([A-Za-z]*)', 1) AS hypothesis, quality FROM documents JOIN labels USING (doc_id))
SELECT gap_id, hypothesis, 'r' AS rationale, 'PMID:' || (gap_id + 10000) || ' and pmid ' || (gap_id + 10000) AS supporting_evidence, 'e' AS suggested_experiment, CASE WHEN quality = 1 THEN 'High' ELSE 'Medium' END AS confidence, 'n' AS novelty, (gap_id + 10000)::VARCHAR AS cited
FROM r WHERE hypothesis <> ''""",
    "hypotheses": """SELECT doc_id AS gap_id, 'a' || doc_id AS concept_a, CASE WHEN quality = 1 THEN 0.85 ELSE 0.55 END::DOUBLE AS confidence_score, (doc_id + 10000) || ',7' AS evidence
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0 AND regexp_extract(text, '^([A-Za-z]*)', 1) <> ''""",
    "topic_class_words": """WITH w AS (SELECT source AS topic, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]{2,}')) AS word FROM documents WHERE source IS NOT NULL), c AS (SELECT topic, word, count(*) AS tf FROM w GROUP BY ALL),
t AS (SELECT word, sum(tf) AS f FROM c GROUP BY word), m AS (SELECT sum(tf) / count(DISTINCT topic) AS a FROM c), s AS (SELECT topic, word, round(tf * ln(1 + a / f), 6) AS score FROM c JOIN t USING (word), m),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word)::INT AS rank FROM s) SELECT topic, rank, word, score FROM r WHERE rank <= 10""",
    "topics_over_time": "SELECT (o_custkey % 6)::INT AS topic_id, year(o_orderdate)::INT AS period, count(*) AS n FROM orders GROUP BY ALL",
    "topics_binned": """WITH o AS (SELECT (o_custkey % 6)::INT AS topic_id, year(o_orderdate)::INT AS y, o_orderpriority AS p FROM orders), s AS (SELECT min(y) AS low, max(y) - min(y) + 1 AS span FROM o),
n AS (SELECT topic_id, floor(low + floor((y - low) * 3 / span) * span / 3)::INT AS period, count(*) AS n FROM o, s GROUP BY ALL),
t AS (SELECT topic_id, unnest(regexp_extract_all(lower(p), '[\\p{L}\\p{N}]{2,}')) AS word FROM o), c AS (SELECT topic_id, word, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT word, sum(tf) AS f FROM c GROUP BY word),
a AS (SELECT sum(tf) / count(DISTINCT topic_id) AS a FROM c), r AS (SELECT topic_id, word, row_number() OVER (PARTITION BY topic_id ORDER BY round(tf * ln(1 + a / f), 6) DESC, word) AS rank FROM c JOIN f USING (word), a)
SELECT topic_id, words, period, n FROM n LEFT JOIN (SELECT topic_id, string_agg(word, ', ' ORDER BY rank) AS words FROM r WHERE rank <= 2 GROUP BY 1) USING (topic_id)""",
    "topic_network": "WITH t AS (SELECT DISTINCT l_orderkey AS doc, (l_partkey % 12)::INT AS topic FROM lineitem) SELECT x.topic AS src, y.topic AS dst, count(*) AS weight FROM t x JOIN t y ON x.doc = y.doc AND x.topic < y.topic GROUP BY ALL",
    "topic_network_valid": "WITH t AS (SELECT DISTINCT l_orderkey AS doc, (l_partkey % 14 - 1)::INT AS topic FROM lineitem WHERE l_partkey % 14 BETWEEN 1 AND 12) SELECT x.topic AS src, y.topic AS dst, count(*) AS weight FROM t x JOIN t y ON x.doc = y.doc AND x.topic < y.topic GROUP BY ALL",
    "trend_auto": "SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT strftime(o_orderdate, '%Y'), count(*) FROM orders GROUP BY 1",
    "topic_pivot": """WITH r AS (SELECT year(o_orderdate)::INT AS period, substr('topic of customers, number ' || (o_custkey % 6) || ' of six', 1, 28) AS topic FROM orders WHERE o_custkey % 6 <> 0),
g AS (SELECT * FROM (SELECT DISTINCT period FROM r), (SELECT DISTINCT topic FROM r)), c AS (SELECT period, topic, count(*) AS n FROM r GROUP BY ALL) SELECT g.period, g.topic, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.period = g.period AND c.topic = g.topic""",
    "most_common": "SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, min(l_orderkey * 10 + l_linenumber), item LIMIT 20",
    "records_by_topic": """WITH r AS (SELECT o_custkey % 6 AS topic, o_orderkey AS doc, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey % 6 ORDER BY year(o_orderdate) DESC, o_orderkey)::INT AS rank FROM orders WHERE o_orderkey % 3 <> 0)
SELECT topic, rank, doc, title FROM r WHERE rank <= 5""",
    "cluster_panel": "WITH s AS (SELECT s_nationkey AS c, count(*) AS n FROM supplier GROUP BY 1) SELECT count(*) AS n_communities, max(n) AS largest_size, (SELECT c FROM s ORDER BY n DESC, c LIMIT 1) AS largest FROM s",
    "isolated_communities": """WITH a AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS item, s_nationkey AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
j AS (SELECT unnest([x.c, y.c]) AS c FROM a x JOIN a y ON x.doc = y.doc AND x.item < y.item WHERE x.c <> y.c) SELECT DISTINCT s_nationkey AS community FROM supplier WHERE s_nationkey NOT IN (SELECT c FROM j)""",
    "citations": "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, 1::BIGINT AS weight FROM lineitem WHERE l_orderkey <> l_partkey AND l_partkey IN (SELECT o_orderkey FROM orders)",
    "shared_references": "WITH a AS (SELECT DISTINCT l_suppkey AS doc, l_partkey AS ref FROM lineitem) SELECT x.doc AS src, y.doc AS dst, count(*) AS weight FROM a x JOIN a y ON x.ref = y.ref AND x.doc < y.doc GROUP BY ALL HAVING count(*) >= 2",
    "gap_filter": f"""WITH {_GAPS}, u AS (SELECT 'structural' AS kind, a, b FROM g UNION ALL SELECT 'cross_domain', a, b FROM x) SELECT kind, a AS concept_a, b AS concept_b FROM u WHERE contains(lower(a || ' ' || b), 'ring')""",
    "gap_nodes": f"""WITH {_GAPS}, r AS (SELECT 'S' || l_suppkey AS entity, l_orderkey AS doc, year(o_orderdate) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), q AS (SELECT max(year) AS last FROM r),
t AS (SELECT entity FROM r, q GROUP BY entity HAVING count(*) FILTER (year >= last - 6 AND year < last - 1) >= 3 AND count(*) FILTER (year >= last - 1) = 0) SELECT DISTINCT node FROM (SELECT unnest([a, b]) AS node FROM w UNION ALL SELECT entity FROM t)""",
    "semantic_search": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings), q AS (SELECT vec_id AS query_id, list_concat(x[1:8], list_transform(x[9:], lambda y: 0.0::DOUBLE)) AS y FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(x, y), 6) AS score, label FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM s)
SELECT query_id, rank, vec_id, score, label FROM r WHERE rank <= 5 AND best >= 0.3""",
}
