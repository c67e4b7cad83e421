"""Exact top-k inner products by no-random-access aggregation of sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.llm.common import longs, saved

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Queries whose bounds are kept at a time, and bytes of queries that meet the rows in one pass.
TILE = 256
GROUP_BYTES = 32 << 20
#: Shares of a list that are read before the bounds are looked at again.
DEPTHS = (0.5, 0.875, 1.0)
_LARGEST = 2.0**62


def _numbers(batches, scale: float, rows: int):
    """Blocks (ids, matrix) of at most `rows` quantised vectors; rows without an id or a finite vector are left out."""

    def block():
        width = max(len(v) for v in vectors)
        flat = np.zeros((len(vectors), width), np.int64)
        for row, v in zip(flat, vectors, strict=True):
            row[: len(v)] = v
        return np.array(ids, np.int64), flat

    ids, vectors = [], []
    for batch in batches:
        keys, values = batch.column("id"), batch.column("v")
        offsets = np.asarray(values.offsets)
        numbers = values.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        valid = np.asarray(values.is_valid()) & np.asarray(keys.is_valid())
        numeric = longs(keys)
        for i in np.flatnonzero(valid):
            v = numbers[offsets[i] : offsets[i + 1]]
            if len(v) and np.isfinite(v).all():
                v = np.floor(scale * v)
                if np.abs(v).max() >= _LARGEST:
                    raise ValueError("a component is too large for scores of 64 bits")
                ids.append(numeric[i])
                vectors.append(v.astype(np.int64))
                if len(ids) == rows:
                    yield block()
                    ids, vectors = [], []
    if ids:
        yield block()


def _widened(flat: np.ndarray, to: int) -> np.ndarray:
    return np.pad(flat, ((0, 0), (0, to - flat.shape[1]))) if to > flat.shape[1] else flat


class SortedLists:
    """A block of rows with a list for each component, sorted by value; lists are read from either end."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.size = ids, x, x.astype(np.float64)
        order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.size, order, axis=0)
        # Each row's place in each list: what is read is told by place, as equal values can stand on both sides of the depth.
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)
        self.least, self.most = self.values[0], self.values[-1]
        self.by_id = np.sort(ids)

    def candidates(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        """(queries' places, rows) that hold each query's k best rows of the block that reach its floor.

        All lists are read to one depth. A row's lower bound takes the worst value of each list for what is unread, its
        upper bound the last value read. Reading stops when few rows have an upper bound as high as the k-th lower
        bound; their scores are then read on in those rows' entries alone.
        """
        n = len(self.x)
        weight = q.astype(np.float64)
        rising, falling = np.maximum(weight, 0).T, np.minimum(weight, 0).T
        worst = self.least @ rising + self.most @ falling
        reach = np.abs(weight) @ np.maximum(np.abs(self.least), np.abs(self.most))
        if reach.max(initial=0) >= _LARGEST:
            raise ValueError("a score may not fit into 64 bits")
        slack = np.where(reach < 2.0**50, 0.0, reach * 1e-12)  # sums of doubles are exact below
        self_rows = np.searchsorted(self.by_id, own, "right") - np.searchsorted(self.by_id, own)
        take = int(min(n, k + self_rows.max(initial=0)))
        alive, found = np.arange(len(q)), []
        for depth in sorted({max(1, int(np.ceil(n * d))) for d in DEPTHS}):
            if not len(alive):
                break
            high, low = self.place >= n - depth, self.place < depth
            up, down = rising[:, alive], falling[:, alive]
            lower = np.where(high, self.size - self.least, 0.0) @ up + np.where(low, self.size - self.most, 0.0) @ down + worst[alive]
            least = np.partition(lower, n - take, axis=0)[n - take] if take == k + self_rows.max(initial=0) else np.full(len(alive), -np.inf)
            least = np.maximum(least, floor[alive]) - slack[alive]
            if depth < n:
                lower += np.where(high, 0.0, self.values[n - depth] - self.least) @ up + np.where(low, 0.0, self.values[depth - 1] - self.most) @ down
                done = np.count_nonzero(lower >= least, axis=0) <= 8 * take
            else:
                done = np.ones(len(alive), bool)
            rows, of = np.nonzero(lower[:, done] >= least[done])
            found.append((alive[done][of], rows))
            alive = alive[~done]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _best(of, ids, scores, k):
    """The k best of each query, ties to the smaller id, in order."""
    order = np.lexsort((ids, -scores, of))
    of, ids, scores = of[order], ids[order], scores[order]
    good = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[good], ids[good], scores[good]


class Search:
    """The k best rows seen so far of each query; each block's lists are read against them."""

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int):
        self.own, self.q, self.k = own, q, k
        none = np.zeros(0, np.int64)
        self.best = none, none, none
        self.floor = np.full(len(q), -np.inf)

    def read(self, ids: np.ndarray, x: np.ndarray) -> None:
        width = max(x.shape[1], self.q.shape[1])
        self.q, x = _widened(self.q, width), _widened(x, width)
        lists, held = SortedLists(ids, x), [self.best]
        for a in range(0, len(self.q), TILE):
            q, own = self.q[a : a + TILE], self.own[a : a + TILE]
            of, rows = lists.candidates(q, own, self.k, self.floor[a : a + TILE])
            other = ids[rows] != own[of]
            of, rows = of[other], rows[other]
            held.append(_best(of + a, ids[rows], np.einsum("ij,ij->i", x[rows], q[of]), self.k))
        self.best = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), self.k)
        of, _, scores = self.best
        full = np.flatnonzero(np.bincount(of, minlength=len(self.q)) >= self.k)
        self.floor[full] = scores[np.searchsorted(of, full, "right") - 1]


def read_lists(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int):
    """For each query with any other row the k best of a block: (query's place, ids, scores)."""
    search = Search(own, q, k)
    search.read(ids, x)
    of, best, scores = search.best
    for j in np.unique(of):
        yield j, best[of == j], scores[of == j]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k rows of vectors with the highest integer inner product with each row of queries, but the query's own id.

    Components x count as floor(scale * x). Queries come in groups of at most GROUP_BYTES; each group is broadcast, and
    each partition of vectors is read once against it, in blocks, keeping k rows for each query: vectors are never
    shuffled. Returns query_id, rank (from 1), vec_id and score, ties to the smaller id.

    Rows with a null id (or one that is no number), or an empty or null vector, or a null or non-finite component, take
    no part; shorter vectors count as if filled up with zeros; repeated ids are rows of their own. With fewer than k
    others a query gets them all; empty tables give an empty result; other columns are not read. A row whose scores
    may not fit into 64 bits is an error.
    """
    spark = vectors.sparkSession

    def source(df):
        return df.select(F.col(f"`{id_col}`").try_cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    def packed(batches):
        for ids, x in _numbers(batches, scale, QUERY_ROWS):
            yield pa.RecordBatch.from_pydict({"width": pa.array([x.shape[1]], pa.int32()), "ids": [ids.tobytes()], "vectors": [x.tobytes()]})

    asked = source(queries).mapInArrow(packed, "width int, ids binary, vectors binary").withColumn("block", F.monotonically_increasing_id())
    asked = saved(asked, "topk-queries")
    sizes = asked.select("block", F.octet_length("vectors").alias("bytes"))
    total, groups = sizes.agg(F.sum("bytes")).first()[0] or 0, 1
    while total and groups * GROUP_BYTES < total:  # blocks are far smaller than a group, so doubling ends
        groups *= 2
    of_group = F.pmod(F.xxhash64("block"), F.lit(groups))
    while groups > 1 and sizes.groupBy(of_group.alias("g")).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] > 2 * GROUP_BYTES:
        groups *= 2
        of_group = F.pmod(F.xxhash64("block"), F.lit(groups))

    def against(group):
        rows = asked.where(of_group == group).collect()  # at most 2 * GROUP_BYTES
        width = max((r.width for r in rows), default=1)
        q = [_widened(np.frombuffer(r.vectors, np.int64).reshape(-1, r.width), width) for r in rows]
        own = [np.frombuffer(r.ids, np.int64) for r in rows]
        held = spark.sparkContext.broadcast((np.concatenate(own), np.concatenate(q)) if rows else (np.zeros(0, np.int64), np.zeros((0, 1), np.int64)))

        def searched(batches):
            own, q = held.value
            search = Search(own, q, k)
            if len(own):
                for ids, x in _numbers(batches, scale, BLOCK_ROWS):
                    search.read(ids, x)
            of, ids, scores = search.best
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(of), group, np.int64)), *(pa.array(c, pa.int64()) for c in (of, own[of], ids, scores))], ["part", "place", "query_id", "vec_id", "score"]
            )

        return source(vectors).mapInArrow(searched, "part long, place long, query_id long, vec_id long, score long")

    found = against(0)
    for group in range(1, groups):
        found = found.union(against(group))
    best = Window.partitionBy("part", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: For a table whose vectors are all of one width.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
