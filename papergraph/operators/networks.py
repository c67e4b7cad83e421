"""Graph tables from link tables: weighted co-occurrence, neighbours, degrees, gaps, knowledge-graph edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.operators.storage import forget, written

#: Pairs that a task makes and counts, or sorts.
COUNTED_PAIRS = 4_000_000
#: Pairs that a task gets for its triangles; up to so few are one task.
TASK_PAIRS = 6_000_000
SOME_PAIRS = 20_000
#: Tasks of a round that get a block, and parts that a round's shuffle has at most.
SENT_COPIES, MOST_PARTS = 4, 4000
#: Paths of two edges that a task looks at in one go.
CHUNK_WEDGES = 1_000_000


def item_frequency(links: DataFrame, doc: str, item: str, least: int = 1, per_document: bool = False) -> DataFrame:
    """item and n, how often it occurs (or in how many documents), for items with at least that many; nulls are left out."""
    rows = links.where(F.col(doc).isNotNull() & F.col(item).isNotNull()).select(F.col(doc).alias("doc"), F.col(item).alias("item"))
    return rows.groupBy("item").agg((F.countDistinct("doc") if per_document else F.count("*")).alias("n")).where(F.col("n") >= least)


def typed_frequency(sources: list[tuple[str, DataFrame]], least: int = 1) -> DataFrame:
    """item, n and source_type of the items (doc, item) of several sources: occurrences, and where it is first seen.

    Items are trimmed and in lower case; empty ones are left out. Documents come in ascending order, and in a document
    the sources in the order given.
    """
    rows = None
    for i, (name, df) in enumerate(sources):
        one = df.select("doc", F.lower(F.trim("item")).alias("item"), F.lit(i).alias("at"), F.lit(name).alias("source_type")).where("item <> ''")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("item").agg(F.count("*").alias("n"), F.min_by("source_type", F.struct("doc", "at")).alias("source_type")).where(F.col("n") >= least)


def cooccurrence(links: DataFrame, doc: str, item: str, least: int = 1, least_weight: int = 1) -> DataFrame:
    """src < dst and weight: in how many documents both items are (`least_weight` at least), for items that occur at least `least` times.

    Pairs are made inside a document, from its distinct items. Rows are dealt by the number of pairs that they make, not
    by their size: a task counts some COUNTED_PAIRS.
    """
    rows = links.where(F.col(doc).isNotNull() & F.col(item).isNotNull()).select(F.col(doc).alias("doc"), F.col(item).alias("item")).distinct()
    if least > 1:
        rows = rows.join(item_frequency(links, doc, item, least).select("item"), "item", "left_semi")
    rows = written(rows, "cooccurrence-rows")
    c = F.col("count")
    many = rows.groupBy("doc").count().agg(F.sum((c * (c - 1) / 2).cast("long"))).first()[0] or 0
    parts = -(-many // COUNTED_PAIRS)
    large = parts > rows.sparkSession.sparkContext.defaultParallelism  # with fewer, tasks have no more pairs anyway
    dealt = rows.repartition(parts, "doc") if large else rows
    pairs = dealt.join(dealt.select("doc", F.col("item").alias("dst")), "doc").where(F.col("item") < F.col("dst"))
    counts = pairs.groupBy(F.col("item").alias("src"), "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least_weight)
    if not large:
        return counts
    counts = written(counts, "cooccurrence", parts=parts)
    forget(rows)
    return counts


def cooccurrence_network(links: DataFrame, doc: str, item: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, weight: occurrences), those without a neighbour too, and edges between them."""
    return item_frequency(links, doc, item, least).select(F.col("item").alias("node"), F.col("n").alias("weight")), cooccurrence(links, doc, item, least)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, degree, strength (summed weight) and centrality (degree / (n - 1)) in an undirected edge table.

    The nodes are those given (node), isolated ones too, else the ends of the edges.
    """
    ends = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    if nodes is not None:
        zero = F.lit(0).cast("long")
        ends = nodes.select("node").distinct().join(ends, "node", "left").select("node", F.coalesce("degree", zero).alias("degree"), F.coalesce("strength", zero).alias("strength"))
    n = ends.agg(F.count("*").alias("n_nodes"))
    return ends.join(F.broadcast(n)).select("node", "degree", "strength", F.when(F.col("n_nodes") > 1, F.round(F.col("degree") / (F.col("n_nodes") - 1), 6)).otherwise(0.0).alias("centrality"))


def graph_statistics(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """One row: n_nodes, n_edges, density (2m / (n (n - 1)), half of it if directed; 0 with fewer than two nodes), average degree."""
    m = edges.agg(F.count("*").alias("n_edges"))
    ends = nodes.select("node") if nodes is not None else both_ways(edges).select("node")
    table = ends.distinct().agg(F.count("*").alias("n_nodes")).join(F.broadcast(m))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return table.select(
        "n_nodes", "n_edges", F.when(n > 1, F.round((1 if directed else 2) * m / (n * (n - 1)), 6)).otherwise(0.0).alias("density"), F.when(n > 0, F.round(2 * m / n, 6)).otherwise(0.0).alias("avg_degree")
    )


def top_neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    """The k neighbours of each node with the largest weight, ties to the smaller: node, other, weight, rank."""
    edges = edges if hasattr(edges, "written_to") else written(edges, "neighbour-edges")
    parts = -(-2 * edges.count() // COUNTED_PAIRS)
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    # dealt once by node: the rows that a task sorts do not grow with the table
    return both_ways(edges).repartition(max(parts, edges.sparkSession.sparkContext.defaultParallelism), "node").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _least(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes for each, or doubles."""
    top = values.max(initial=0)
    for kind in (np.uint8, np.uint16, np.uint32):
        if top <= np.iinfo(kind).max and values.min(initial=0) >= 0 and (values.dtype.kind != "f" or np.array_equal(values, np.floor(values))):
            return values.astype(kind).tobytes()
    return values.astype(np.float64).tobytes()


def _read(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64}[len(data) // n] if n else np.uint8)


def _block(key, part):
    """The pairs (xy: both places; w) of two groups, once each with the largest weight: xs with the numbers of their ys, ys by x, weights; and the ys with the numbers of their xs."""
    xy = part["xy"].to_numpy()
    order = np.argsort(xy, kind="stable")
    xy = xy[order]
    first = np.flatnonzero(np.diff(xy, prepend=~xy[:1]) != 0)
    w = _least(np.maximum.reduceat(part["w"].to_numpy()[order], first)) if "w" in part.column_names else None
    x, y = xy[first] >> 32, xy[first] & 0xFFFFFFFF
    xs, xc = np.unique(x, return_counts=True)
    ends, ec = np.unique(y, return_counts=True)
    data = [key[0].as_py(), key[1].as_py(), xs.astype(np.int32).tobytes(), xc.astype(np.int32).tobytes(), _least(y), w, ends.astype(np.int32).tobytes(), ec.astype(np.int32).tobytes()]
    return pa.table([pa.array([v], t) for v, t in zip(data, [pa.int32()] * 2 + [pa.binary()] * 6, strict=True)], names=["g1", "g2", "xs", "xc", "ys", "w", "ends", "ec"])


def _corners(weighted: bool):
    """What a task does with the blocks of one triple of groups i <= j <= k: of each group its nodes' places, and the sums over their triangles.

    Pairs lead from the smaller group, or the smaller place, to the other. For each x of i and y of j the neighbours z of y
    in k are looked up among those of x.
    """
    def counted(key, part):
        i, j, k = (key[c].as_py() for c in range(3))
        held = {(row["g1"], row["g2"]): row for row in part.to_pylist()}

        def side(a, b):
            row = held.get((a, b))
            if row is None:
                return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
            many = np.frombuffer(row["xc"], np.int32)
            n = int(many.sum())
            return np.repeat(np.frombuffer(row["xs"], np.int32), many), _read(row["ys"], n).astype(np.int32), _read(row["w"], n).astype(np.float64) if weighted else np.zeros(0)

        (x1, y1, w1), (x2, z2, w2), (y3, z3, w3) = side(i, j), side(i, k), side(j, k)
        xs, ys, zs = np.unique(x1), np.unique(y1), np.unique(np.concatenate([z2, z3]))
        keep2, keep3 = np.isin(x2, xs), np.isin(y3, ys)
        x1, y1 = np.searchsorted(xs, x1), np.searchsorted(ys, y1)
        x2, z2 = np.searchsorted(xs, x2[keep2]), np.searchsorted(zs, z2[keep2])
        y3, z3 = np.searchsorted(ys, y3[keep3]), np.searchsorted(zs, z3[keep3])
        if weighted:
            w1, w2, w3 = np.cbrt(w1), np.cbrt(w2[keep2]), np.cbrt(w3[keep3])
        first = np.searchsorted(y3, np.arange(len(ys) + 1))
        many = np.diff(first)[y1]
        before = np.concatenate([[0], np.cumsum(many)])
        sums = [np.zeros(len(nodes)) for nodes in (xs, ys, zs)]
        keys = x2 * max(len(zs), 1) + z2
        s = 0
        while s < len(x1) and len(x2):
            e = max(s + 1, int(np.searchsorted(before, before[s] + CHUNK_WEDGES, "right")) - 1)
            edge = np.repeat(np.arange(s, e), many[s:e])
            at = np.arange(len(edge)) + np.repeat(first[y1[s:e]] - (before[s:e] - before[s]), many[s:e])
            x, z = x1[edge], z3[at]
            low, high = x1[s], x1[e - 1] + 1
            if (high - low) * len(zs) <= 8 * CHUNK_WEDGES:
                told = np.full((high - low) * len(zs), -1, np.int32)
                a, b = np.searchsorted(x2, (low, high))
                told[keys[a:b] - low * len(zs)] = np.arange(a, b)
                found = told[(x - low) * len(zs) + z]
                hit = np.flatnonzero(found >= 0)
                found = found[hit]
            else:
                wanted = x * len(zs) + z
                found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = np.flatnonzero(keys[found] == wanted)
                found = found[hit]
            value = w1[edge[hit]] * w2[found] * w3[at[hit]] if weighted else None
            for total, node in zip(sums, (x[hit], y1[edge[hit]], z[hit]), strict=True):
                total += np.bincount(node, value, len(total))
            s = e
        kept = [(g, nodes[total > 0].astype(np.int32).tobytes(), total[total > 0].tobytes()) for g, nodes, total in zip((i, j, k), (xs, ys, zs), sums, strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["g", "places", "t"])

    return counted


def _summed(key, part):
    """Of one group: each place, its degree and its sum over triangles."""
    places = [np.frombuffer(b, np.int32) for b in part["places"].to_pylist()]
    n = 1 + max(int(at.max(initial=-1)) for at in places)
    d, t = np.zeros(n, np.int64), np.zeros(n)
    for at, many, sums in zip(places, part["d"].to_pylist(), part["t"].to_pylist(), strict=True):
        if many is not None:
            d[at] += np.frombuffer(many, np.int32)
        else:
            t[at] += np.frombuffer(sums, np.float64)
    return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(d), pa.array(t)], names=["g", "place", "d", "t"])


def clustering(edges: DataFrame, weighted: bool = False, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """node and its clustering coefficient: triangles / possible ones; 0 for nodes of degree below two.

    Weighted, a triangle counts by the cubic root of the product of its weights, each against the largest of all.
    Nodes are dealt to groups, the pairs of two groups are one block of some bytes for a pair, and a task gets the blocks among three groups, some
    `task_pairs` pairs: the paths of two edges, of which a dense graph has very many, are only made inside a task. A block
    goes to as many tasks as there are groups, but to few (SENT_COPIES) at a time, one round of tasks after another.
    """
    own = not hasattr(edges, "written_to")
    edges = written(edges, "clustering-edges") if own else edges
    pairs = edges.where("src <> dst")
    n_pairs = pairs.count()
    p = max(4 if n_pairs > SOME_PAIRS else 1, math.ceil(math.sqrt(6 * n_pairs / task_pairs)))
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.pmod(F.xxhash64("node"), F.lit(p)).cast("int").alias("g"))
    nodes = written(ends.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("node")) - 1), "clustering-nodes")
    at = nodes.select("node", F.struct("g", "place").alias("n"))
    told = pairs.join(at.toDF("src", "n_src"), "src").join(at.toDF("dst", "n_dst"), "dst").select(F.least("n_src", "n_dst").alias("n1"), F.greatest("n_src", "n_dst").alias("n2"), F.col("weight").cast("double").alias("w"))
    told = told.select(F.col("n1.g").alias("g1"), F.col("n2.g").alias("g2"), (F.shiftleft(F.col("n1.place").cast("long"), 32) + F.col("n2.place")).alias("xy"), *["w"] * weighted)
    blocks = written(told.groupBy("g1", "g2").applyInArrow(_block, "g1 int, g2 int, xs binary, xc binary, ys binary, w binary, ends binary, ec binary"), "clustering-blocks", parts=min(p * (p + 1), MOST_PARTS))
    top = pairs.agg(F.max("weight").cast("double")).first()[0] if weighted else 1.0
    if own:
        forget(edges)
    rounds = -(-p // SENT_COPIES)
    triple = F.array_sort(F.array("g1", "g2", "other"))
    sent = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).select(*[F.get(triple, F.lit(c)).alias(f"i{c}") for c in range(3)], "g1", "g2", "xs", "xc", "ys", "w")
    counted = blocks.select(F.explode(F.array(F.struct(F.col("g1").alias("g"), F.col("xs").alias("places"), F.col("xc").alias("d")), F.struct(F.col("g2").alias("g"), F.col("ends").alias("places"), F.col("ec").alias("d")))).alias("x")).select("x.*", F.lit(None).cast("binary").alias("t"))
    for i in range(rounds):
        now = sent.where((F.col("i0") + F.col("i1") + F.col("i2")) % rounds == i)
        corners = written(now.groupBy("i0", "i1", "i2").applyInArrow(_corners(weighted), "g int, places binary, t binary"), "clustering-corners", parts=max(1, min(p * (p + 1) * (p + 2) // 3 // rounds, MOST_PARTS)))
        counted = counted.unionByName(corners.withColumn("d", F.lit(None).cast("binary")))
    shares = written(counted.groupBy("g").applyInArrow(_summed, "g int, place int, d long, t double"), "clustering-shares", parts=min(2 * p, MOST_PARTS))
    forget(blocks)
    share = F.when(F.col("d") > 1, F.round(2 * (F.col("t") / F.lit(top)) / (F.col("d") * (F.col("d") - 1)), 6)).otherwise(0.0)
    return nodes.join(shares, ["g", "place"]).select("node", share.alias("clustering"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """community, modularity share: inner weight / m - (degree weight / 2m) squared. communities has node and community."""
    m = edges.agg(F.sum("weight").alias("m"))
    by = communities.select("node", "community")
    ends = edges.join(by.toDF("src", "c_src"), "src").join(by.toDF("dst", "c_dst"), "dst")
    inner = ends.where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.sum("weight").alias("inner"))
    outer = both_ways(edges).join(by, "node").groupBy("community").agg(F.sum("weight").alias("k"))
    share = F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)
    return outer.join(inner, "community", "left").join(F.broadcast(m)).select("community", F.round(share, 6).alias("modularity"))


def temporal_gaps(mentions: DataFrame, early: int = 10, recent: int = 3, least: int = 3) -> DataFrame:
    """entity, early_count and score of entities with at least `least` documents in the early window and none in the recent one.

    mentions has entity, doc and year; the windows end at the last year there is: [last - early, last - recent) and
    [last - recent, last].
    """
    rows = mentions.where("entity IS NOT NULL AND year IS NOT NULL").select("entity", "doc", "year").distinct()
    last = rows.agg(F.max("year").alias("last"))
    both = rows.join(F.broadcast(last))
    old = (F.col("year") >= F.col("last") - early) & (F.col("year") < F.col("last") - recent)
    counted = both.groupBy("entity").agg(F.count_if(old).alias("early_count"), F.count_if(F.col("year") >= F.col("last") - recent).alias("n_recent"))
    return counted.where((F.col("early_count") >= least) & (F.col("n_recent") == 0)).select("entity", "early_count", (2.0 * F.col("early_count")).alias("score"))


def isolated_communities(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """community of those without an edge to another one; communities has node and community."""
    ends = edges.join(communities.toDF("src", "c_src"), "src").join(communities.toDF("dst", "c_dst"), "dst").where("c_src <> c_dst")
    joined = ends.select(F.explode(F.array("c_src", "c_dst")).alias("community")).distinct()
    return communities.select("community").distinct().join(joined, "community", "left_anti")


def citations(references: DataFrame, records: DataFrame) -> DataFrame:
    """src, dst and weight 1 of references (doc, ref) to another record (doc) of the corpus, once each."""
    known = records.select(F.col("doc").alias("ref")).distinct()
    return references.join(known, "ref", "left_semi").where("doc <> ref").select(F.col("doc").alias("src"), F.col("ref").alias("dst")).distinct().withColumn("weight", F.lit(1).cast("long"))


def shared_references(references: DataFrame, least: int = 1) -> DataFrame:
    """src < dst and weight: how many references two records share."""
    return cooccurrence(references, "ref", "doc", least_weight=least)


def top_central(values: DataFrame, column: str, k: int = 10) -> DataFrame:
    """rank, node and value of the k nodes with the highest value of a column, equal ones by name."""
    first = values.orderBy(F.desc(column), "node").limit(k)
    return first.select(F.row_number().over(Window.orderBy(F.desc(column), "node")).alias("rank"), "node", F.col(column).cast("double").alias("value"))  # k rows


def network_report(edges: DataFrame, nodes: DataFrame, communities: DataFrame, central: dict[str, DataFrame] | None = None, k: int = 10) -> DataFrame:
    """figure, rank, node and value: counts, density, mean clustering (weighted), communities, modularity, and the k nodes highest in each centrality.

    nodes: node; communities: node, community. Degree centrality is always there; central holds others by name, as tables of
    node and a column of that name (betweenness, closeness or its sketch). A figure of the whole has rank 0 and no node.
    """
    def one(df, name, value):
        return df.select(F.lit(name).alias("figure"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("node"), value.cast("double").alias("value"))

    whole = graph_statistics(edges, nodes)
    out = one(whole, "node_count", F.col("n_nodes")).unionByName(one(whole, "edge_count", F.col("n_edges"))).unionByName(one(whole, "density", F.col("density")))
    # a mean half way between two digits must not hang on the order of a sum of doubles: whole millionths are summed
    share = nodes.select("node").distinct().join(clustering(edges, weighted=True), "node", "left").agg((F.round(F.avg(F.round(F.coalesce("clustering", F.lit(0.0)) * 1e6).cast("long"))) / 1e6).alias("x"))
    out = out.unionByName(one(share, "avg_clustering", F.coalesce("x", F.lit(0.0)))).unionByName(one(communities.agg(F.countDistinct("community").alias("x")), "community_count", F.col("x")))
    out = out.unionByName(one(modularity(edges, communities).agg(F.round(F.sum("modularity"), 5).alias("x")), "modularity", F.coalesce("x", F.lit(0.0))))
    for name, df in [("degree", degrees(edges, nodes).select("node", F.col("centrality").alias("degree"))), *(central or {}).items()]:
        out = out.unionByName(top_central(df, name, k).select(F.lit(f"top_{name}").alias("figure"), "rank", F.col("node").cast("string").alias("node"), "value"))
    return out


def keyword_report(sources: list[tuple[str, DataFrame]], k: int = 20) -> DataFrame:
    """rank, item, n and source_type: the k items that several sources (doc, at, item) have most often, and where each is first seen.

    Items are trimmed and in lower case. Documents are read in ascending order, in each the sources in the order given, in
    each of these its items by at; equally frequent items come as they are first seen.
    """
    rows = None
    for i, (name, df) in enumerate(sources):
        one = df.select(F.struct("doc", F.lit(i).alias("source"), "at").alias("seen"), F.lower(F.trim("item")).alias("item"), F.lit(name).alias("source_type")).where("item <> ''")
        rows = one if rows is None else rows.unionByName(one)
    counted = rows.groupBy("item").agg(F.count("*").alias("n"), F.min("seen").alias("seen"), F.min_by("source_type", "seen").alias("source_type"))
    first = counted.orderBy(F.desc("n"), "seen").limit(k)
    return first.select(F.row_number().over(Window.orderBy(F.desc("n"), "seen")).alias("rank"), "item", "n", "source_type")  # k rows


def network_panel(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """One row of a network's panel: nodes, edges, communities, density, the k heaviest nodes as "name (weight)", and the one with most edges.

    nodes: node, weight, community; equal nodes go by name.
    """
    top = nodes.orderBy(F.desc("weight"), "node").limit(k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "node"))), lambda x: F.concat(x["node"].cast("string"), F.lit(" ("), (-x["w"]).cast("string"), F.lit(")"))), ", ").alias("top"))  # k rows
    most = degrees(edges).orderBy(F.desc("degree"), "node").limit(1).agg(F.max("node").alias("most_connected"))
    groups = nodes.agg(F.countDistinct("community").alias("n_communities"))
    return graph_statistics(edges, nodes).select("n_nodes", "n_edges", "density").join(groups).join(top).join(most)  # one row each
