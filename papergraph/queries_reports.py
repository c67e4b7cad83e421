"""Registered queries of filters, panels, reports and sinks, on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papergraph.operators import context, knowledge, linkage, mentions, networks, records
from papergraph.operators.storage import shared_folder, written
from papergraph.queries_graph import _EDGES, _edges, _simple_edges, _suppliers_by_order, table
from papergraph.sources import sinks


def _folder(spark, sf_dir, name):
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"


def _kg_filter(spark, sf_dir):
    """Entities with an s in their name, in relations of two documents or a weight of two."""
    nodes, edges, evidence = _edges(spark, sf_dir)
    return knowledge.kg_filter(nodes, edges, evidence, ["SUPPLIER", "PART"], "S", ["supplies"], 2)[1].select("src", "relation", "dst", "weight")


def _kg_filter_types(spark, sf_dir):
    nodes, edges, evidence = _edges(spark, sf_dir)
    return knowledge.kg_filter(nodes, edges, evidence, None, "", ["supplies"], 3)[1].select("src", "relation", "dst", "weight")


def _relation_filter(spark, sf_dir):
    nodes, edges, evidence = _edges(spark, sf_dir)
    return knowledge.relations_with(knowledge.relation_table(edges, evidence, nodes), ["SUPPLIER"], ["PART"], ["associated_with"]).select("src", "dst", "weight", "evidence")


def _detail(spark, sf_dir):
    nodes, edges, evidence = _edges(spark, sf_dir)
    return knowledge.entity_detail(knowledge.relation_table(edges, evidence, nodes), "S1")


def _domains(spark, sf_dir):
    nodes, edges, _ = _edges(spark, sf_dir)
    nations = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("community"))
    return knowledge.filter_domains(nodes, edges, nations, table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")))


def _kg_report(spark, sf_dir):
    """Communities are entities with names of equal length, mod 3."""
    nodes, edges, _ = _edges(spark, sf_dir)
    return knowledge.kg_report(nodes, edges, nodes.select(F.col("label").alias("node"), (F.length("label") % 3).alias("community")))


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))


def _network_report(spark, sf_dir):
    edges = _suppliers_by_order(spark, sf_dir)
    edges = edges if hasattr(edges, "written_to") else written(edges, "network-edges")
    return networks.network_report(edges, _suppliers(spark, sf_dir), _suppliers(spark, sf_dir))


def _full_report(spark, sf_dir):
    """All three centralities of part names that meet in orders; communities are names of one first letter."""
    edges = _simple_edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "part").where("p_name IS NOT NULL").select(F.col("p_name").alias("node")).distinct()
    central = {"betweenness": knowledge.betweenness(edges, nodes), "closeness": knowledge.closeness(edges, nodes)}
    return networks.network_report(edges, nodes, nodes.select("node", F.substring("node", 1, 1).alias("community")), central)


def _panel(spark, sf_dir):
    weights = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("weight"))
    return networks.network_panel(_suppliers(spark, sf_dir).join(weights, "node", "left").select("node", F.coalesce("weight", F.lit(0)).alias("weight"), "community"), _suppliers_by_order(spark, sf_dir))


def _keyword_report(spark, sf_dir):
    """Five sources: names, types, brands, segments of the buyers, priorities."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand"), "l_partkey")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    of_lines = [(kind, lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("at"), F.col(c).alias("item"))) for kind, c in (("author_keyword", "p_name"), ("mesh_descriptor", "p_type"), ("mesh_qualifier", "p_brand"))]
    of_orders = [(kind, orders.select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("at"), F.col(c).alias("item"))) for kind, c in (("chemical", "c_mktsegment"), ("publication_type", "o_orderpriority"))]
    return networks.keyword_report(of_lines + of_orders)


def _payload(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = F.array(*[F.concat(F.col("source"), F.lit(f"-{i}")) for i in range(5)])
    return records.display_payload(docs.select(F.col("doc_id").alias("pmid"), F.col("lang").alias("title"), F.col("text").alias("abstract"), F.slice(names, 1, (F.col("doc_id") % 5 + 1).cast("int")).alias("names"), (F.col("doc_id") % 101 / 100).alias("score")))


def _lookup(spark, sf_dir):
    return records.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", [1, 7, 10])


def _newest(spark, sf_dir):
    return records.newest(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 10).select("o_orderkey")


def _subgraph_communities(spark, sf_dir):
    """Suppliers of some nations and 3 orders or more, and the edges among them of weight 2 or more."""
    weights = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("weight"))
    kept = _suppliers(spark, sf_dir).where(F.col("community").isin([0, 1, 2, 3, 5, 8, 13, 21])).join(weights.where("weight >= 3"), "node", "left_semi")
    return knowledge.induced(_suppliers_by_order(spark, sf_dir).where("weight >= 2"), kept)


def _vector_index(spark, sf_dir):
    path = _folder(spark, sf_dir, "vector-index")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    for i in range(3):
        sinks.save_vectors(rows.where(F.col("label") % 3 == i), path, f"query {i}")
    return sinks.vector_index(spark, path)


def _isolated(spark, sf_dir):
    """Orders meet in their customer. Those of odd customers are a community each, the others mix by their number."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("item"))
    group = F.when(F.col("doc") % 2 == 1, F.col("doc")).otherwise(-1 - F.col("item") % 50)
    return networks.isolated_communities(networks.cooccurrence(orders, "doc", "item"), orders.select(F.col("item").alias("node"), group.alias("community")))


def _graph_export(spark, sf_dir):
    """The graph as JSON lines, written and read again."""
    nodes, edges, _ = _edges(spark, sf_dir)
    path = _folder(spark, sf_dir, "graph")
    sinks.save_graph(nodes.select("label", "entity_type"), edges.select("src", "relation", "dst", "weight"), path)
    back = spark.read.text(path)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.min("value").alias("first"))


def _topic_save(spark, sf_dir):
    path = _folder(spark, sf_dir, "topics")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 7 - 1).cast("int").alias("topic_id"))
    summary = rows.groupBy("topic_id").agg(F.count("*").alias("paper_count"))
    spark.createDataFrame([], summary.schema).write.mode("overwrite").parquet(f"{path}/topics")
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}/assignments")
    sinks.save_topics(summary, rows, path)
    saved = spark.read.parquet(f"{path}/assignments").groupBy("topic_id").agg(F.count("*").alias("n"))
    return spark.read.parquet(f"{path}/topics").join(saved, "topic_id")


def _prompts(spark, sf_dir):
    """Prompts on pairs of suppliers and regions, with a document as context."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    asked = docs.select(F.col("doc_id").alias("gap_id"), F.col("source").alias("concept_a"), F.col("lang").alias("concept_b"))
    return context.gap_prompts(asked, docs.select(F.col("doc_id").alias("gap_id"), F.col("text").alias("context"))).select("gap_id", F.length("prompt").alias("n_chars"), F.contains("prompt", F.lit("6. NOVELTY")).alias("asks_all"))


def _canonical(spark, sf_dir):
    """Each order's suppliers with the names of a map that has two of three of them."""
    people = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    author = F.struct(F.col("s_name").alias("name"), F.lit(None).cast("string").alias("normalized_name"))
    rows = people.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", author.alias("a"))))["a"].alias("authors"))
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"), F.concat(F.lit("c-"), F.col("s_suppkey") % 10).alias("canonical"))
    return linkage.with_canonical_authors(rows, names, "l_orderkey").select("l_orderkey", F.array_join(F.col("authors")["normalized_name"], ";").alias("names"))


def _names_match(spark, sf_dir):
    """Names of customers of a nation against each other's short forms: equal surnames, one forename beginning the other."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("L"), F.col("c_nationkey"), F.lit(", "), F.substring(F.lit("abcdefghij"), 1, F.col("c_custkey").cast("int") % 4)).alias("a"), F.concat(F.lit("l"), F.col("c_nationkey"), F.lit(", ABX")).alias("b"))
    return names.select("c_custkey", linkage.names_match("a", "b").alias("same"))


def _entity_types(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("organism", "TAXON", "Procedure", "unheard of"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", mentions.entity_type(kinds).alias("kind"))


QUERIES = {
    "kg_filter": _kg_filter, "kg_filter_relations": _kg_filter_types, "relation_filter": _relation_filter, "entity_detail": _detail, "filter_domains": _domains, "kg_report": _kg_report, "network_report": _network_report,
    "network_report_full": _full_report, "network_panel": _panel, "keyword_report": _keyword_report, "display_payload": _payload, "lookup": _lookup, "newest": _newest, "subgraph_communities": _subgraph_communities,
    "vector_index": _vector_index, "isolated_some": _isolated, "graph_export": _graph_export, "topic_save": _topic_save, "gap_prompts": _prompts, "canonical_authors": _canonical, "names_match": _names_match, "entity_types": _entity_types,
}

_TABLE = f"""WITH {_EDGES}, v AS (SELECT src, relation, dst, array_to_string(list_sort(list(DISTINCT doc_id))[1:3], ',') AS evidence FROM r WHERE doc_id IS NOT NULL GROUP BY ALL)"""
_PAIRS = """a AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS item FROM lineitem WHERE l_suppkey IS NOT NULL),
e AS (SELECT x.item AS src, y.item AS dst, count(*) AS weight FROM a x JOIN a y ON x.doc = y.doc AND x.item < y.item GROUP BY ALL), bw AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""

ORACLES = {
    "kg_filter": f"WITH {_EDGES} SELECT src, relation, dst, weight FROM e WHERE relation = 'supplies' AND weight >= 2 AND contains(lower(src), 's') AND contains(lower(dst), 's')",
    "kg_filter_relations": f"WITH {_EDGES} SELECT src, relation, dst, weight FROM e WHERE relation = 'supplies' AND weight >= 3",
    "relation_filter": f"{_TABLE} SELECT src, dst, weight, evidence FROM e JOIN v USING (src, relation, dst) WHERE relation = 'associated_with'",
    "entity_detail": f"{_TABLE} SELECT relation, dst, 'PART' AS target_type, round(confidence, 3) AS confidence, weight, evidence FROM e JOIN v USING (src, relation, dst) WHERE src = 'S1'",
    "filter_domains": f"""WITH {_EDGES} SELECT DISTINCT 'entity_type' AS domain, entity_type AS value FROM c UNION ALL SELECT DISTINCT 'relation', relation FROM e UNION ALL SELECT DISTINCT 'community', s_nationkey::VARCHAR FROM supplier
UNION ALL SELECT 'first_year', min(year(o_orderdate))::VARCHAR FROM orders UNION ALL SELECT 'last_year', max(year(o_orderdate))::VARCHAR FROM orders""",
    "kg_report": f"""WITH {_EDGES}, g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), kk AS (SELECT length(node) % 3 AS c, sum(n) AS k FROM g GROUP BY 1),
i AS (SELECT length(src) % 3 AS c, count(*) AS i FROM e WHERE length(src) % 3 = length(dst) % 3 GROUP BY 1), mm AS (SELECT count(*) AS m FROM e)
SELECT 'node_count' AS figure, NULL AS value, count(*)::DOUBLE AS n FROM c UNION ALL SELECT 'edge_count', NULL, m FROM mm UNION ALL SELECT 'entity_type', entity_type, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'relation', relation, count(*) FROM e GROUP BY ALL
UNION ALL (SELECT 'most_connected', node, n FROM g ORDER BY n DESC, node LIMIT 1) UNION ALL SELECT 'modularity', NULL, round(sum(round(coalesce(i, 0) / m - pow(k / (2 * m), 2), 6)), 5) FROM kk LEFT JOIN i USING (c), mm""",
    "network_report": f"""WITH {_PAIRS}, n AS (SELECT count(*) AS n FROM supplier), m AS (SELECT count(*) AS m, sum(weight) AS w, max(weight) AS top FROM e), d AS (SELECT node, count(*) AS d FROM bw GROUP BY node),
t AS (SELECT unnest([x.src, x.dst, y.dst]) AS node, cbrt(x.weight * y.weight * z.weight) / top AS v FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst, m), s AS (SELECT node, sum(v) AS t FROM t GROUP BY node),
cl AS (SELECT s_suppkey, CASE WHEN d > 1 THEN round(2 * coalesce(t, 0) / (d * (d - 1)), 6) ELSE 0.0 END AS x FROM supplier LEFT JOIN d ON d.node = s_suppkey LEFT JOIN s ON s.node = s_suppkey),
i AS (SELECT x.s_nationkey AS c, sum(weight) AS i FROM e JOIN supplier x ON x.s_suppkey = src JOIN supplier y ON y.s_suppkey = dst WHERE x.s_nationkey = y.s_nationkey GROUP BY 1), k AS (SELECT s_nationkey AS c, sum(weight) AS k FROM bw JOIN supplier ON s_suppkey = node GROUP BY 1),
q AS (SELECT round(sum(round(coalesce(i, 0) / w - pow(k / (2 * w), 2), 6)), 5) AS q FROM k LEFT JOIN i USING (c), m), r AS (SELECT s_suppkey AS node, round(coalesce(d, 0) / (n - 1), 6) AS x, row_number() OVER (ORDER BY round(coalesce(d, 0) / (n - 1), 6) DESC, s_suppkey)::INT AS rank FROM supplier LEFT JOIN d ON d.node = s_suppkey, n)
SELECT 'node_count' AS figure, 0 AS rank, NULL AS node, n::DOUBLE AS value FROM n UNION ALL SELECT 'edge_count', 0, NULL, m FROM m UNION ALL SELECT 'density', 0, NULL, round(2 * m / (n * (n - 1)), 6) FROM n, m UNION ALL SELECT 'avg_clustering', 0, NULL, round(avg(x), 6) FROM cl
UNION ALL SELECT 'community_count', 0, NULL, count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'modularity', 0, NULL, q FROM q UNION ALL SELECT 'top_degree', rank, node::VARCHAR, x FROM r WHERE rank <= 10""",
    "network_panel": f"""WITH {_PAIRS}, w AS (SELECT s_suppkey AS node, count(l_suppkey) AS weight FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1), f AS (FROM w ORDER BY weight DESC, node LIMIT 5)
SELECT (SELECT count(*) FROM supplier) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT round(2 * (SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 6) FROM supplier) AS density, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS n_communities,
(SELECT string_agg(node || ' (' || weight || ')', ', ' ORDER BY weight DESC, node) FROM f) AS top, (SELECT node FROM bw GROUP BY node ORDER BY count(*) DESC, node LIMIT 1) AS most_connected""",
    "keyword_report": """WITH l AS (SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey), o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey),
k AS (SELECT l_orderkey AS doc, 0 AS s, l_linenumber AS place, lower(trim(p_name)) AS item FROM l UNION ALL SELECT l_orderkey, 1, l_linenumber, lower(trim(p_type)) FROM l UNION ALL SELECT l_orderkey, 2, l_linenumber, lower(trim(p_brand)) FROM l
  UNION ALL SELECT o_orderkey, 3, 0, lower(trim(c_mktsegment)) FROM o UNION ALL SELECT o_orderkey, 4, 0, lower(trim(o_orderpriority)) FROM o),
g AS (SELECT item, count(*) AS n, min(doc * 1000 + s * 100 + place) AS seen FROM k WHERE item <> '' GROUP BY item), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, seen)::INT AS rank FROM g)
SELECT rank, item, n, ['author_keyword', 'mesh_descriptor', 'mesh_qualifier', 'chemical', 'publication_type'][(seen // 100) % 10 + 1] AS source_type FROM r WHERE rank <= 20""",
    "display_payload": """WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)
SELECT doc_id AS pmid, lang AS title, array_to_string(list_transform(range(least(doc_id % 5 + 1, 3)), lambda i: source || '-' || i), '; ') || CASE WHEN doc_id % 5 + 1 > 3 THEN ' et al. (+' || (doc_id % 5 - 2) || ')' ELSE '' END AS people,
  trim(replace(substr(t, 1, 300), chr(10), ' ')) || CASE WHEN length(t) > 300 THEN '…' ELSE '' END AS excerpt, floor(doc_id % 101 / 100 * 100)::INT AS percent FROM d""",
    "lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (1, 7, 10)",
    "newest": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10",
    "subgraph_communities": f"""WITH {_PAIRS}, n AS (SELECT s_suppkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey IN (0, 1, 2, 3, 5, 8, 13, 21) GROUP BY 1 HAVING count(*) >= 3)
SELECT src, dst, weight FROM e WHERE weight >= 2 AND src IN (FROM n) AND dst IN (FROM n)""",
    "vector_index": "SELECT substr(sha256('query ' || label % 3), 1, 12) AS query_hash, count(*) AS n FROM embeddings WHERE label >= 0 GROUP BY 1",
    "isolated_some": """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS item, CASE WHEN o_custkey % 2 = 1 THEN o_custkey ELSE -1 - o_orderkey % 50 END AS c FROM orders),
j AS (SELECT unnest([x.c, y.c]) AS c FROM o x JOIN o y ON x.doc = y.doc AND x.item < y.item WHERE x.c <> y.c) SELECT DISTINCT c AS community FROM o WHERE c NOT IN (SELECT c FROM j)""",
    "graph_export": f"""WITH {_EDGES}, nj AS (SELECT '{{"label":"' || label || '","entity_type":"' || entity_type || '"}}' AS j FROM c), ej AS (SELECT '{{"src":"' || src || '","relation":"' || relation || '","dst":"' || dst || '","weight":' || weight || '}}' AS j FROM e)
SELECT 'node' AS kind, count(*) AS n, min(j) AS first FROM nj UNION ALL SELECT 'edge', count(*), min(j) FROM ej UNION ALL SELECT 'statistics', 1, '{{"node_count":' || (SELECT count(*) FROM c) || ',"edge_count":' || (SELECT count(*) FROM e) || '}}'""",
    "topic_save": "SELECT (o_custkey % 7 - 1)::INT AS topic_id, count(*) AS paper_count, count(*) AS n FROM orders WHERE o_custkey % 7 >= 1 GROUP BY ALL",
    "canonical_authors": """SELECT l_orderkey, string_agg(CASE WHEN s_suppkey % 3 <> 0 THEN 'c-' || s_suppkey % 10 ELSE s_name END, ';' ORDER BY l_linenumber, l_suppkey) AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""",
    "names_match": "SELECT c_custkey, c_custkey % 4 IN (1, 2) AS same FROM customer",
    "entity_types": "SELECT p_partkey, ['ORGANISM', 'ORGANISM', 'LABORATORY_PROCEDURE', 'unheard of'][p_partkey % 4 + 1] AS kind FROM part",
}
