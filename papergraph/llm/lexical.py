"""Ranked lexical search: documents with equal bags of the items' terms are scored once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.llm.common import discard, runs, saved, utf8

#: Items go to the tasks in groups of some so many terms (with repeats).
GROUP_TERMS = 200_000
#: Texts are read in runs of so many bytes (or one text); classes are scored in blocks of at most so many cells.
RUN_BYTES, BLOCK_CELLS = 4_000_000, 2_000_000

_BYTES = np.arange(256)
TERM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of the texts as lower-cased bytes, in order, and the text of each."""
    inside = TERM[data]
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    upto = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    at = np.append(upto[starts], upto[-1])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(LOWERED[data[inside]]))])
    return column, np.searchsorted(offsets, starts, side="right") - 1


def _exploded(batches):
    """item, term and times of each item's terms."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for first, last in runs(offsets, RUN_BYTES):
            terms, owner = terms_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + first)), terms.cast(pa.binary())], ["item_id", "term"])


def bags(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the whole text) and bag: pairs of a term's place in the vocabulary and its tf, as int32, by place.

    Documents without a term are left out: they neither count nor score.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def bagged(batches):
        words = pa.array(held.value, pa.large_binary())
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in runs(offsets, RUN_BYTES):
                terms, owner = terms_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                n = np.bincount(owner, minlength=last - first)
                coded = terms.dictionary_encode()
                place = pc.index_in(coded.dictionary, words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                which = place[coded.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
                cells, tf = np.unique((owner * max(len(words), 1) + which)[which >= 0], return_counts=True)
                pairs = np.stack([cells % max(len(words), 1), tf], axis=1).astype(np.int32)
                ends = np.searchsorted(cells // max(len(words), 1), np.arange(last - first + 1)) * 8
                some = np.flatnonzero(n)
                raw, column = pairs.tobytes(), batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([column.take(pa.array(some)), pa.array(n[some], pa.int64()), pa.array([raw[ends[i] : ends[i + 1]] for i in some.tolist()], pa.binary())], ["doc_id", "n", "bag"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(bagged, "doc_id long, n long, bag binary")


def _document_frequencies(batches):
    for batch in batches:
        places, counts = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)[::2], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(counts.astype(np.int64))], ["place", "df"])


class Items:
    """The items of a group: ids, and for each its terms' places, with weight times repeats of each."""

    def __init__(self, ids: list[int], places: list[np.ndarray], weights: list[np.ndarray]):
        self.ids, self.places, self.weights = np.array(ids, np.int64), places, weights


class Best:
    """The k best rows of each item so far, by falling score and ascending doc_id, nulls last."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(n)]

    def add(self, j: int, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray):
        old = self.rows[j]
        scores, ids, unnamed = (np.concatenate([a, b]) for a, b in zip(old, (scores, ids, unnamed), strict=True))
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.rows[j] = scores[order], ids[order], unnamed[order]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0, equal ones by ascending doc_id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A to Z lower-cased. With N the documents
    that have a term, L all their terms, n a document's, df the documents that hold a term, and tf how often a document
    holds it: a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 100 - 25 + (25 n N) div L, and a document scores
    the sum of w ((1000000000 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.

    Each document becomes its bag of the items' terms. Documents of one bag and one m are a class: they are brought together
    by a hash and told apart by the bags themselves, and a class keeps k members, the least ids, which is all that a rank
    can need; each partition keeps as many before anything is shuffled. Classes are scored once, in blocks against all
    items of a group, and a task hands on k rows for each item. Items come in groups of some GROUP_TERMS terms,
    dealt by a hash, with one pass over the documents for each.

    A null text has no terms. Repeated rows and ids are documents of their own; null ids come last among equal scores.
    Items of one id are one item with the terms of all; items without terms, or with a null id, get nothing. Empty tables
    give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    terms = saved(asked.mapInArrow(_exploded, "item_id long, term binary").groupBy("item_id", "term").agg(F.count("*").alias("times")), "lexical-items")
    n_terms, groups = terms.agg(F.sum("times")).first()[0] or 0, 1
    while n_terms > groups * GROUP_TERMS:  # items fall into groups by a hash
        groups *= 2
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    found = None
    for i in range(groups if n_terms else 0):
        part = _search_group(docs, terms.where(group == i), k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    discard(terms)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def _search_group(docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    rows = terms.orderBy("item_id", "term").collect()  # some GROUP_TERMS rows
    vocabulary = sorted({bytes(r.term) for r in rows})
    place = {t: i for i, t in enumerate(vocabulary)}
    bagged = saved(bags(docs, vocabulary, id_col, text_col), "lexical-bags")
    n_docs, n_terms = bagged.agg(F.count("*"), F.sum("n")).first()
    df = {r.place: r.df for r in bagged.select("bag").mapInArrow(_document_frequencies, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()}
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * np.array([df.get(i, 0) for i in range(len(vocabulary))]) + 1))).astype(np.int64)
    of: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        of.setdefault(r.item_id, []).append((place[bytes(r.term)], r.times))
    places = [np.array([p for p, _ in x], np.int64) for x in of.values()]
    held = docs.sparkSession.sparkContext.broadcast(Items(list(of), places, [weights[p] * np.array([t for _, t in x], np.int64) for p, x in zip(places, of.values(), strict=True)]))

    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(n_terms or 1, 1)}L")
    keyed = bagged.where(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag", F.xxhash64("bag", m).alias("hash"))
    least = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    members = keyed.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k)
    classes = members.groupBy("hash", "m", "bag").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))  # k rows a class at most
    classes = saved(classes.select("m", "bag", "ids", "unnamed"), "lexical-classes")

    def scored(batches):
        group = held.value
        width = max((int(p.max()) + 1 for p in group.places), default=1)
        step = max(16, BLOCK_CELLS // width)
        best = Best(len(group.ids), k)
        for batch in batches:
            for first in range(0, len(batch), step):
                part = batch.slice(first, step)
                score_block(part, group, width, best)
        out = [(int(group.ids[j]), int(s), None if u else int(i)) for j, rows in enumerate(best.rows) for s, i, u in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_pydict({"item_id": pa.array([r[0] for r in out], pa.int64()), "doc_id": pa.array([r[2] for r in out], pa.int64()), "score": pa.array([r[1] for r in out], pa.int64())})

    best = classes.mapInArrow(scored, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    ranked = saved(ranked, "lexical-ranked")
    discard(bagged, classes)
    return ranked


def score_block(part: pa.RecordBatch, group: Items, width: int, best: Best) -> None:
    """Scores the classes of part (m, bag, ids, unnamed) against every item of the group."""
    n = len(part)
    m = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = part.column(1).to_pylist()
    owner = np.repeat(np.arange(n), [len(b) // 8 for b in raw])
    pairs = np.frombuffer(b"".join(raw), np.int32).reshape(-1, 2).astype(np.int64)
    cells = np.zeros((width, n), np.int64)
    cells[pairs[:, 0], owner] = (1_000_000_000 * pairs[:, 1]) // (1000 * pairs[:, 1] + 12 * m[owner])
    ids = part.column(2)
    values, ends = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ids.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    extra = part.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
    lowest = np.where(np.diff(ends) > 0, values[np.minimum(ends[:-1], max(len(values) - 1, 0))] if len(values) else 0, np.iinfo(np.int64).max)
    for j, (places, weights) in enumerate(zip(group.places, group.weights, strict=True)):
        scores = weights @ cells[places]
        old = best.rows[j][0]
        floor = old[-1] if len(old) == best.k else 1
        good = np.flatnonzero(scores >= max(floor, 1))
        if len(good) > best.k:  # as many classes as rows: each class has a member
            cut = np.partition(scores[good], len(good) - best.k)[len(good) - best.k]
            good = good[scores[good] >= cut]
            good = good[np.lexsort((lowest[good], -scores[good]))][: best.k]
        if len(good):
            named, unnamed = np.diff(ends)[good], extra[good]
            own = np.concatenate([values[ends[i] : ends[i + 1]] for i in good])
            best.add(
                j, np.concatenate([np.repeat(scores[good], named), np.repeat(scores[good], unnamed)]), np.concatenate([own, np.zeros(int(unnamed.sum()), np.int64)]),
                np.concatenate([np.zeros(len(own), bool), np.ones(int(unnamed.sum()), bool)]),
            )


#: Terms are found and lower-cased as the operator does; the scores are in 64-bit integers.
RANKED_SEARCH_SQL = r"""
WITH tok AS (SELECT doc_id, rid, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (
    SELECT doc_id, rid, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT *, row_number() OVER () AS rid FROM documents))),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)) GROUP BY ALL),
f AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM tok GROUP BY rid),
a AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nl FROM f),
c AS (SELECT rid, t, count(*) AS tf FROM tok SEMI JOIN q USING (t) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM c, a GROUP BY t, nd),
s AS (SELECT item_id, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN c USING (t) JOIN f USING (rid), a GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s JOIN f USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
