"""Knowledge graph tables: canonical nodes, consolidated edges with their evidence, neighbourhoods, figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papergraph.operators.networks import modularity
from papergraph.operators.sketches import closeness_sketch  # noqa: F401
from papergraph.operators.storage import forget, written


def canonical_key(name: Column, kind: Column, concept: Column) -> Column:
    """Concept id and type; lower-cased name and type where there is no concept id."""
    return F.concat(F.coalesce(F.nullif(concept, F.lit("")), F.lower(name)), F.lit("||"), kind)


def canonical_nodes(mentions: DataFrame, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and the names that lead to them, from mentions (ord, name, entity_type, concept_id, doc_id; ord is unique).

    A node's label is the shortest name of its key, the first of equally short ones; its concept id the first there is;
    paper_count its distinct documents, weight the same, 1 at least (neither unless counted). Keys of one label are one node, with the attributes
    of the key that comes last. A name leads to the key it has last; its lower-cased form to that of the name seen last.
    Mentions are summed up by name and key first, in numbers alone; everything but the count is chosen from that table.
    """
    rows = mentions.select("ord", F.trim("name").alias("name"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), "concept_id", "doc_id").where("name <> ''")
    seen = written(rows.groupBy("name", "entity_type", "concept_id").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")), "kg-mentions")
    seen = seen.withColumn("key", canonical_key(F.col("name"), F.col("entity_type"), F.col("concept_id")))
    keyed = seen.groupBy("key").agg(
        F.min_by("name", F.struct(F.length("name"), "lo")).alias("label"), F.first("entity_type").alias("entity_type"), F.min("lo").alias("first_ord"),
        F.min_by("concept_id", F.when(F.coalesce("concept_id", F.lit("")) != "", F.col("lo"))).alias("concept_id"),
    )
    told = ["entity_type", "concept_id"]
    every = keyed
    if counted:
        papers = rows.select(canonical_key(F.col("name"), F.col("entity_type"), F.col("concept_id")).alias("key"), "doc_id").groupBy("key").agg(F.countDistinct("doc_id").alias("paper_count"))
        every, told = keyed.join(papers, "key"), [*told, "paper_count"]
    nodes = every.groupBy("label").agg(F.max_by(F.struct(*told), "first_ord").alias("x")).select("label", "x.*")
    if counted:
        nodes = nodes.withColumn("weight", F.greatest("paper_count", F.lit(1)))
    names = seen.groupBy("name").agg(F.max_by("key", "hi").alias("key"), F.min("lo").alias("name_ord")).join(keyed.select("key", "label"), "key")
    lowered = names.groupBy(F.lower("name").alias("name")).agg(F.max_by("label", "name_ord").alias("label"))
    exact = names.select("name", "label")
    return nodes, exact.unionByName(lowered.join(exact.select("name"), "name", "left_anti"))


def consolidated_edges(relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, relation, dst, confidence, weight) and their evidence (src, relation, dst, doc_id), between canonical nodes.

    Relations are source_entity, target_entity, relationship_type, doc_id and confidence. Names lead to nodes as they
    are, else in lower case; unknown names and loops go. The evidence holds every document; weight counts them. The
    confidence is the highest, 0.7 where it is null or 0. A relation without a document raises it but makes no edge.
    Each name is led to its node once, in a table of the names that relations have.
    """
    rows = relations.select(
        F.trim("source_entity").alias("s"), F.trim("target_entity").alias("t"), F.trim(F.coalesce(F.nullif("relationship_type", F.lit("")), F.lit("associated_with"))).alias("relation"),
        "doc_id", F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.7)).alias("confidence"),
    )
    ends = rows.select("s").distinct().unionAll(rows.select("t").distinct()).toDF("end").distinct()
    low = names.select(F.col("name").alias("n2"), F.col("label").alias("l2"))
    led = ends.join(names.select(F.col("name").alias("end"), F.col("label").alias("l1")), "end", "left").join(low, F.lower("end") == low["n2"], "left")
    led = written(led.select("end", F.coalesce("l1", "l2").alias("label")).where("label IS NOT NULL"), "kg-ends")
    rows = rows.join(led.toDF("s", "src"), "s").join(led.toDF("t", "dst"), "t").where("src <> dst")
    each = rows.groupBy("src", "relation", "dst", "doc_id").agg(F.max("confidence").alias("confidence"))
    edges = each.groupBy("src", "relation", "dst").agg(F.max("confidence").alias("confidence"), F.count("doc_id").alias("weight")).where("weight > 0")
    return edges, each.where("doc_id IS NOT NULL").select("src", "relation", "dst", "doc_id")


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """node and hops: what is within `depth` edges, whatever their direction, of the nodes of starts (node)."""
    near = edges.select("src", "dst").unionAll(edges.select("dst", "src")).toDF("node", "next").distinct()
    reached = starts.select("node", F.lit(0).alias("hops")).distinct()
    for hop in range(1, depth + 1):
        front = reached.where(F.col("hops") == hop - 1).join(near, "node").select(F.col("next").alias("node")).distinct()
        reached = reached.unionAll(front.join(reached.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops")))
    return reached


def neighbourhood_graph(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """The edges among the nodes within `depth` edges of the starts (node), whatever their direction."""
    return induced(edges, written(neighbourhood(edges, starts, depth), "neighbourhood").select("node"))


def walked(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int = 1_000_000) -> DataFrame:
    """node and hops as neighbourhood gives them, in one recursive query.

    Each walk of up to `depth` edges is a row on the way, and more than `most` of them are an error: for starts without
    hubs about them. neighbourhood keeps each node once.
    """
    spark = edges.sparkSession
    near = edges.select("src", "dst").unionAll(edges.select("dst", "src")).toDF("node", "next").distinct()
    spark.conf.set("spark.sql.cteRecursionRowLimit", most)
    return spark.sql(
        f"""WITH RECURSIVE reached(node, hops) AS (
          SELECT node, 0 FROM {{starts}} UNION ALL SELECT near.next, hops + 1 FROM reached JOIN {{near}} near ON near.node = reached.node WHERE hops < {int(depth)})
        SELECT node, min(hops) AS hops FROM reached GROUP BY node""", starts=starts.select("node").distinct(), near=near,
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """value and n of each value; nulls count as UNKNOWN."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("UNKNOWN")).alias("value")).agg(F.count("*").alias("n"))


def total_degrees(edges: DataFrame) -> DataFrame:
    """node and degree: edges that leave or enter it; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def most_connected(edges: DataFrame) -> DataFrame:
    """The node with most edges (the least of equal ones) and its degree."""
    return total_degrees(edges).orderBy(F.desc("degree"), "node").limit(1)


def top_relations(edges: DataFrame, k: int = 3) -> DataFrame:
    """Each node's k most frequent outgoing relations: node, relation, n, rank; ties by name."""
    counts = edges.groupBy(F.col("src").alias("node"), "relation").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "relation"))).where(F.col("rank") <= k)


def top_connected(edges: DataFrame, k: int = 3) -> DataFrame:
    """Each node's k neighbours by summed weight of the edges in either direction: node, other, weight, rank."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionAll(edges.select("dst", "src", "weight"))
    sums = both.groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other"))).where(F.col("rank") <= k)


def relation_table(edges: DataFrame, evidence: DataFrame, nodes: DataFrame, shown: int = 3) -> DataFrame:
    """Edges with the types of their ends, confidence to three digits, and the first `shown` documents of evidence."""
    place = Window.partitionBy("src", "relation", "dst").orderBy("doc_id")
    first = evidence.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= shown)
    listed = first.groupBy("src", "relation", "dst").agg(F.array_join(F.array_sort(F.collect_list(F.col("doc_id"))).cast("array<string>"), ",").alias("evidence"))
    kinds = nodes.select("label", "entity_type")
    rows = edges.join(listed, ["src", "relation", "dst"]).join(kinds.toDF("src", "source_type"), "src", "left").join(kinds.toDF("dst", "target_type"), "dst", "left")
    return rows.select("src", "source_type", "relation", "dst", "target_type", F.round("confidence", 3).alias("confidence"), "weight", "evidence")


def distances(edges: DataFrame, most: int = 2000) -> DataFrame:
    """source, node and hops between all pairs of reachable nodes; nothing for graphs of more than `most` nodes."""
    near = edges.select("src", "dst").unionAll(edges.select("dst", "src")).toDF("node", "next").where("node <> next").distinct()
    near = written(near, "distance-near")
    nodes = near.select("node").distinct()
    if nodes.count() > most:
        nodes = nodes.limit(0)
    reached = written(nodes.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")), "distance-reached")
    hop = 0
    while True:
        hop += 1
        front = reached.where(F.col("hops") == hop - 1).join(near, "node").select("source", F.col("next").alias("node")).distinct()
        front = written(front.join(reached.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(hop).alias("hops")), "distance-front")
        if front.isEmpty():
            return reached
        reached = reached.unionAll(front)


def closeness(edges: DataFrame, nodes: DataFrame, most: int = 2000) -> DataFrame:
    """node and closeness ((r - 1) / sum of distances, times (r - 1) / (n - 1), r nodes being reached); 0 for isolated nodes."""
    n = nodes.select("node").distinct().count()
    sums = distances(edges, most).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("r"), F.sum("hops").alias("d"))
    value = F.when(F.col("d") > 0, F.round((F.col("r") - 1) / F.col("d") * (F.col("r") - 1) / max(n - 1, 1), 6)).otherwise(0.0)
    return nodes.select("node").distinct().join(sums, "node", "left").select("node", value.alias("closeness"))


def betweenness(edges: DataFrame, nodes: DataFrame, most: int = 2000) -> DataFrame:
    """node and betweenness: the share of shortest paths between others that pass it, weights (positive) being distances.

    All by joins, for all sources at once: distances by rounds of relaxing, then the edges that shortest paths take, the
    numbers of paths along them edge by edge, and back along them what each node passes on. With more than `most` nodes that many are
    sources, told by a hash, and the sums are scaled: an estimate. Values are normalised by the number of pairs of other nodes.
    """
    ends = edges.where("src <> dst AND weight > 0").select("src", "dst", F.col("weight").cast("double").alias("length"))
    near = written(ends.unionAll(ends.select("dst", "src", "length")).toDF("node", "next", "length").groupBy("node", "next").agg(F.min("length").alias("length")), "between-near")
    every = written(nodes.select("node").distinct(), "between-nodes")
    n = every.count()
    sources = every if n <= most else every.orderBy(F.xxhash64("node"), "node").limit(most)
    far = written(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.lit(True).alias("new")), "between-far")
    while not far.where("new").isEmpty():
        step = far.where("new").join(near, "node").select("source", F.col("next").alias("node"), (F.col("dist") + F.col("length")).alias("dist"))
        best = step.groupBy("source", "node").agg(F.min("dist").alias("reached"))
        after = far.join(best, ["source", "node"], "full_outer")
        closer = F.col("reached").isNotNull() & (F.col("dist").isNull() | (F.col("reached") < F.col("dist")))
        before, far = far, written(after.select("source", "node", F.when(closer, F.col("reached")).otherwise(F.col("dist")).alias("dist"), closer.alias("new")), "between-far")
        forget(before)
    taken = far.select("source", "node", "dist").join(near, "node").join(far.select("source", F.col("node").alias("next"), F.col("dist").alias("whole")), ["source", "next"])
    taken = written(taken.where("dist + length = whole").select("source", "node", "next"), "between-taken")

    def summed(first, step, name):
        """The sum over all rounds of what first (source, node, x) becomes as step leads it on; null if there is none."""
        found, now = first, written(first, name)
        parts = [now]
        while True:
            now = written(step(now), name)
            if now.isEmpty():
                break
            parts.append(now)
            if len(parts) > 8:  # sums are taken on the way, so that the plan stays short
                whole = written(reduce(DataFrame.unionAll, parts).groupBy("source", "node").agg(F.sum("x").alias("x")), name)
                parts = [whole]
        found = reduce(DataFrame.unionAll, parts).groupBy("source", "node").agg(F.sum("x").alias("x"))
        return written(found, name)

    paths = summed(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("x")), lambda now: now.join(taken, ["source", "node"]).groupBy("source", F.col("next").alias("node")).agg(F.sum("x").alias("x")), "between-paths")
    shares = taken.join(paths.toDF("source", "node", "here"), ["source", "node"]).join(paths.toDF("source", "next", "there"), ["source", "next"]).select("source", "node", "next", (F.col("here") / F.col("there")).alias("share"))
    shares = written(shares, "between-shares")
    units = far.where("source <> node").select("source", "node", F.lit(1.0).alias("x"))
    passed = summed(units, lambda now: now.withColumnRenamed("node", "next").join(shares, ["source", "next"]).groupBy("source", "node").agg(F.sum(F.col("x") * F.col("share")).alias("x")), "between-passed")
    scale = n / min(n, most) / max((n - 1) * (n - 2), 1) if n else 0.0
    sums = passed.where("source <> node").groupBy("node").agg(F.sum(F.col("x") - 1).alias("x"))  # less the unit that it began with
    return every.join(sums, "node", "left").select("node", F.round(F.coalesce(F.col("x"), F.lit(0.0)) * scale, 6).alias("betweenness"))


def kg_filter(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, types: list[str] | None = None, name: str = "", relations: list[str] | None = None, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types whose label holds name, whatever the case, and edges among them of the relations.

    An edge goes if it has fewer than `least` documents of evidence and a weight below `least`. None lets all types or relations pass.
    """
    kept = nodes if types is None else nodes.where(F.coalesce("entity_type", F.lit("UNKNOWN")).isin(types))
    if name:
        kept = kept.where(F.contains(F.lower("label"), F.lit(name.lower())))
    inner = induced(edges if relations is None else edges.where(F.col("relation").isin(relations)), kept.select(F.col("label").alias("node")))
    counts = evidence.groupBy("src", "relation", "dst").agg(F.countDistinct("doc_id").alias("_n"))
    enough = (F.coalesce("_n", F.lit(0)) >= least) | (F.col("weight") >= least)
    return kept, inner.join(counts, ["src", "relation", "dst"], "left").where(enough).select(*edges.columns)


def relations_with(table: DataFrame, sources: list[str] | None = None, targets: list[str] | None = None, relations: list[str] | None = None) -> DataFrame:
    """Rows of a relation table of the source types, target types and relations given (None: all)."""
    for column, wanted in (("source_type", sources), ("target_type", targets), ("relation", relations)):
        if wanted is not None:
            table = table.where(F.col(column).isin(wanted))
    return table


def entity_detail(table: DataFrame, node: str) -> DataFrame:
    """The outgoing relations of a node in a relation table, by falling confidence."""
    return table.where(F.col("src") == node).select("relation", "dst", "target_type", "confidence", "weight", "evidence").orderBy(F.desc("confidence"), "relation", "dst")


def filter_domains(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None, years: DataFrame | None = None) -> DataFrame:
    """domain and value: entity types, relations, communities and the first and last year that a filter may choose from."""
    out = nodes.select(F.lit("entity_type").alias("domain"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("value")).distinct()
    out = out.unionByName(edges.select(F.lit("relation").alias("domain"), F.col("relation").alias("value")).distinct())
    if communities is not None:
        out = out.unionByName(communities.select(F.lit("community").alias("domain"), F.col("community").cast("string").alias("value")).distinct())
    if years is not None:
        ends = years.agg(F.min("year").alias("low"), F.max("year").alias("high"))
        out = out.unionByName(ends.select(F.stack(F.lit(2), F.lit("first_year"), F.col("low").cast("string"), F.lit("last_year"), F.col("high").cast("string")).alias("domain", "value")))
    return out


def kg_report(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """figure, value and n: node and edge counts, types, relations, the node with most edges, and modularity of the communities (node, community).

    Modularity is that of the undirected graph in which each edge counts once, whatever its weight.
    """
    total = lambda df, name: df.agg(F.count("*").cast("double").alias("n")).select(F.lit(name).alias("figure"), F.lit(None).cast("string").alias("value"), "n")
    out = total(nodes, "node_count").unionByName(total(edges, "edge_count"))
    for name, df in (("entity_type", histogram(nodes, "entity_type")), ("relation", histogram(edges, "relation")), ("most_connected", most_connected(edges).toDF("value", "n"))):
        out = out.unionByName(df.select(F.lit(name).alias("figure"), "value", F.col("n").cast("double").alias("n")))
    ones = edges.select("src", "dst", F.lit(1).alias("weight"))
    return out.unionByName(modularity(ones, communities).agg(F.round(F.coalesce(F.sum("modularity"), F.lit(0.0)), 5).alias("n")).select(F.lit("modularity").alias("figure"), F.lit(None).cast("string").alias("value"), "n"))
