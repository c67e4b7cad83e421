"""The registered queries of the library's own operators, on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papergraph import queries_graph, queries_records, queries_reports
from papergraph.operators import gaps, networks, reports, vectors
from papergraph.operators.components import connected_components


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keywords(spark, sf_dir):
    """A record is an order, a keyword the name of a part in it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), lines["l_partkey"] == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("p_name").alias("item"))


def _authors(spark, sf_dir):
    """A record is an order, its authors the suppliers of its lines."""
    return networks.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def _supplies(spark, sf_dir):
    """All edges between suppliers and part names, weighted by orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), lines["l_partkey"] == F.col("p_partkey"))
    edges = named.groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("p_name")).alias("dst"))
    return edges.agg(F.countDistinct("l_orderkey").alias("weight"))


def _suppliers(spark, sf_dir):
    """Every author, those without a co-author too."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))


def _corpus_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.agg(
        F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"),
        F.round(100 * F.avg((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).cast("int")), 6).alias("pct_with_text"),
    )


def _top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.cosine_top_k(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def _evolution(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), lines["l_partkey"] == F.col("p_partkey"))
    rows = rows.join(_orders(spark, sf_dir).select("o_orderkey", "year"), rows["l_orderkey"] == F.col("o_orderkey"))
    return reports.topic_evolution(rows, "p_type", "year")


def _modularity(spark, sf_dir):
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    return networks.modularity(_authors(spark, sf_dir), nations)


def _temporal(spark, sf_dir):
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("doc"), "year")
    return networks.temporal_gaps(rows, early=6, recent=1)


QUERIES = {
    "keyword_cooccurrence": lambda s, d: networks.cooccurrence(_keywords(s, d), "doc", "item", 3),
    "keyword_frequency": lambda s, d: networks.item_frequency(_keywords(s, d), "doc", "item", 3),
    "coauthor_network": _authors,
    "author_degrees": lambda s, d: networks.degrees(_authors(s, d), _suppliers(s, d)),
    "network_statistics": lambda s, d: networks.graph_statistics(_authors(s, d), _suppliers(s, d)),
    "top_neighbours": lambda s, d: networks.top_neighbours(_authors(s, d)),
    "clustering_plain": lambda s, d: networks.clustering(_authors(s, d)),
    "clustering_weighted": lambda s, d: networks.clustering(_authors(s, d), weighted=True),
    "modularity_by_nation": _modularity,
    "components": lambda s, d: connected_components(_supplies(s, d)),
    "gaps_structural": lambda s, d: gaps.structural_gaps(_supplies(s, d)),
    "gaps_temporal": _temporal,
    "publication_trend": lambda s, d: reports.trend(_orders(s, d), "year"),
    "momentum": lambda s, d: reports.momentum(_orders(s, d), "year"),
    "topic_evolution": _evolution,
    "author_productivity": lambda s, d: reports.author_productivity(table(s, d, "lineitem"), "l_suppkey", "l_linenumber"),
    "corpus_statistics": _corpus_statistics,
    "dedup_exact": lambda s, d: reports.keep_first(table(s, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id"),
    "chat_history": lambda s, d: reports.last_turns(table(s, d, "conversations")),
    "text_search": lambda s, d: reports.text_search(table(s, d, "documents"), "the", ["text"]).select("doc_id"),
    "vector_topk": _top_k,
    "group_means": lambda s, d: vectors.group_means(table(s, d, "embeddings"), "label", "embedding"),
} | queries_records.QUERIES | queries_graph.QUERIES | queries_reports.QUERIES

_KEYWORDS = "k AS (SELECT l_orderkey AS doc, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IS NOT NULL)"
_AUTHORS = """a AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS item FROM lineitem WHERE l_suppkey IS NOT NULL),
e AS (SELECT x.item AS src, y.item AS dst, count(*) AS weight FROM a x JOIN a y ON x.doc = y.doc AND x.item < y.item GROUP BY ALL),
bw AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""
_SUPPLIES = """e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || p_name AS dst FROM lineitem JOIN part ON l_partkey = p_partkey),
near AS (SELECT src AS node, dst AS mid FROM e UNION SELECT dst, src FROM e)"""

ORACLES = {
    "keyword_cooccurrence": f"""WITH {_KEYWORDS}, f AS (SELECT item FROM k GROUP BY item HAVING count(*) >= 3), g AS (SELECT DISTINCT k.* FROM k SEMI JOIN f USING (item))
SELECT x.item AS src, y.item AS dst, count(*) AS weight FROM g x JOIN g y ON x.doc = y.doc AND x.item < y.item GROUP BY ALL""",
    "keyword_frequency": f"WITH {_KEYWORDS} SELECT item, count(*) AS n FROM k GROUP BY item HAVING count(*) >= 3",
    "coauthor_network": f"WITH {_AUTHORS} SELECT src, dst, weight FROM e",
    "author_degrees": f"""WITH {_AUTHORS}, d AS (SELECT node, count(*) AS d, sum(weight)::BIGINT AS s FROM bw GROUP BY node), n AS (SELECT count(*) AS n FROM supplier)
SELECT s_suppkey AS node, coalesce(d, 0) AS degree, coalesce(s, 0) AS strength, CASE WHEN n > 1 THEN round(coalesce(d, 0) / (n - 1), 6) ELSE 0.0 END AS centrality FROM supplier LEFT JOIN d ON node = s_suppkey, n""",
    "network_statistics": f"""WITH {_AUTHORS}, n AS (SELECT (SELECT count(*) FROM supplier) AS n_nodes, count(*) AS n_edges FROM e)
SELECT n_nodes, n_edges, CASE WHEN n_nodes > 1 THEN round(2 * n_edges / (n_nodes * (n_nodes - 1)), 6) ELSE 0.0 END AS density,
  CASE WHEN n_nodes > 0 THEN round(2 * n_edges / n_nodes, 6) ELSE 0.0 END AS avg_degree FROM n""",
    "top_neighbours": f"""WITH {_AUTHORS}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other)::INT AS rank FROM bw)
SELECT node, other, weight, rank FROM r WHERE rank <= 5""",
    "clustering_weighted": f"""WITH {_AUTHORS}, m AS (SELECT max(weight) AS m FROM e), d AS (SELECT node, count(*) AS d FROM bw GROUP BY node),
t AS (SELECT unnest([x.src, x.dst, y.dst]) AS node, cbrt(x.weight * y.weight * z.weight) / m AS v FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst, m),
n AS (SELECT node, sum(v) AS t FROM t GROUP BY node)
SELECT d.node, CASE WHEN d > 1 THEN round(2 * coalesce(t, 0) / (d * (d - 1)), 6) ELSE 0.0 END AS clustering FROM d LEFT JOIN n ON n.node = d.node""",
    "clustering_plain": f"""WITH {_AUTHORS}, c AS (SELECT src, dst FROM e), d AS (SELECT node, count(*) AS d FROM bw GROUP BY node),
t AS (SELECT unnest([x.src, x.dst, y.dst]) AS node FROM c x JOIN c y ON x.dst = y.src JOIN c z ON z.src = x.src AND z.dst = y.dst),
n AS (SELECT node, count(*) AS t FROM t GROUP BY node)
SELECT d.node, CASE WHEN d > 1 THEN round(2 * coalesce(t, 0) / (d * (d - 1)), 6) ELSE 0.0 END AS clustering FROM d LEFT JOIN n ON n.node = d.node""",
    "modularity_by_nation": f"""WITH {_AUTHORS}, c AS (SELECT s_suppkey AS node, s_nationkey AS community FROM supplier), m AS (SELECT sum(weight) AS m FROM e),
i AS (SELECT x.community, sum(weight) AS i FROM e JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.community = y.community GROUP BY ALL),
k AS (SELECT community, sum(weight) AS k FROM bw JOIN c USING (node) GROUP BY ALL)
SELECT k.community, round(coalesce(i, 0) / m - pow(k / (2 * m), 2), 6) AS modularity FROM k LEFT JOIN i ON i.community = k.community, m""",
    "components": f"""WITH RECURSIVE {_SUPPLIES}, r AS (SELECT DISTINCT node AS id, node AS reached FROM near UNION SELECT r.id, near.mid FROM r JOIN near ON near.node = r.reached)
SELECT id, min(reached) AS component FROM r GROUP BY id""",
    "gaps_structural": f"""WITH {_SUPPLIES}, d AS (SELECT node, count(*) AS d FROM near GROUP BY node),
w AS (SELECT x.node AS a, y.node AS b, count(*) AS shared FROM near x JOIN near y ON x.mid = y.mid AND x.node < y.node GROUP BY ALL HAVING count(*) >= 3)
SELECT a AS concept_a, b AS concept_b, shared, x.d AS degree_a, y.d AS degree_b, round(shared * sqrt(x.d * y.d), 4) AS score FROM w JOIN d x ON x.node = a JOIN d y ON y.node = b
WHERE NOT EXISTS (SELECT 1 FROM near z WHERE z.node = a AND z.mid = b)""",
    "gaps_temporal": """WITH r AS (SELECT o_custkey AS entity, year(o_orderdate) AS year FROM orders), l AS (SELECT max(year) AS last FROM r)
SELECT entity, count(*) FILTER (year >= last - 6 AND year < last - 1) AS early_count, 2.0::DOUBLE * count(*) FILTER (year >= last - 6 AND year < last - 1) AS score
FROM r, l GROUP BY entity HAVING count(*) FILTER (year >= last - 6 AND year < last - 1) >= 3 AND count(*) FILTER (year >= last - 1) = 0""",
    "publication_trend": """WITH c AS (SELECT year(o_orderdate)::INT AS period, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT *, lag(n) OVER (ORDER BY period) AS p FROM c)
SELECT period, n, sum(n) OVER (ORDER BY period)::BIGINT AS cumulative, round(avg(n) OVER (), 6) AS mean, CASE WHEN n > p THEN 'up' WHEN n < p THEN 'down' ELSE 'neutral' END AS direction FROM b""",
    "momentum": """WITH c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY year(o_orderdate) DESC) AS back FROM orders GROUP BY year(o_orderdate)),
m AS (SELECT avg(n) FILTER (back <= 3) AS recent, avg(n) FILTER (back BETWEEN 4 AND 6) AS prior, count(*) AS k FROM c)
SELECT round(recent, 6) AS recent, round(prior, 6) AS prior, CASE WHEN k < 6 OR prior <= 0 THEN 'unknown' WHEN recent / prior > 1.1 THEN 'rising' WHEN recent / prior < 0.9 THEN 'falling' ELSE 'stable' END AS momentum FROM m""",
    "topic_evolution": """WITH c AS (SELECT p_type AS topic, year(o_orderdate)::INT AS period, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT topic, period, n, round(100 * n / sum(n) OVER (PARTITION BY period), 6) AS share FROM c""",
    "author_productivity": """SELECT l_suppkey AS author, count(*) FILTER (l_linenumber = 1) AS n_first, count(*) FILTER (l_linenumber > 1) AS n_co, count(*) AS n
FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, author LIMIT 15""",
    "corpus_statistics": """SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs,
  round(100 * avg((length(trim(coalesce(text, ''))) > 0)::INT), 6) AS pct_with_text FROM documents""",
    "dedup_exact": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "chat_history": """WITH r AS (SELECT conv_id, upper(coalesce(role, 'user')) AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, upper(coalesce(role, 'user')) DESC, coalesce(text, '') DESC) AS back FROM conversations)
SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 400), chr(10) ORDER BY back DESC) AS history FROM r WHERE back <= 4 GROUP BY conv_id""",
    "text_search": "SELECT doc_id FROM documents WHERE text ILIKE '%the%'",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "group_means": """WITH p AS (SELECT label AS g, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS "at" FROM embeddings WHERE label IS NOT NULL)
SELECT g AS "group", "at", round(avg(x), 6) AS mean FROM p GROUP BY ALL""",
} | queries_records.ORACLES | queries_graph.ORACLES | queries_reports.ORACLES
