"""Jaccard join of documents on word n-grams, by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.llm.common import discard, mixed, pieces, saved, utf8
from papergraph.operators.components import connected_components
from papergraph.operators.storage import written

#: N-grams that one task counts at a time, and bytes of text that are hashed at a time.
FRAGMENT_GRAMS = 2_000_000
#: Fragments that travel as one, since each set's key travels with each of them; a task counts them one after another.
SPANS = 2
#: Rows that go to Python at a time, where one may hold some 10 KB and more.
BATCH_ROWS = 200
RUN_BYTES = 1 << 18
#: Ranges of the global order in which overlaps are counted apart.
RANGES = 4
#: Rounds in which sets outside the largest component of an n-gram are checked against a few others, before all the rest.
TRIES = 3
#: N-grams at the front of a set's prefix that tell which n-gram is the first that two sets share.
HEAD = 48

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)])
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))[_LOWER]


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int):
        if len(cls.up) < n:
            cls.up = np.cumprod(np.full(n, _BASE, np.uint64))
            cls.down = np.cumprod(np.full(n, _INVERSE, np.uint64))
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, lower-cased, and the number of words of each."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up, out=sums[1:])
    at = np.searchsorted(start, offsets)
    return mixed((sums[end] - sums[start]) * down[start]), np.diff(at)


def _grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of n words (of all its words, if fewer), and how many."""
    start = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    base, grams = np.uint64(_BASE), np.full(len(words), n, np.uint64)
    for i in range(n):
        grams = mixed(grams * base + padded[i : i + len(words)])
    for width in range(1, n):
        at = start[:-1][counts == width]
        short = np.full(len(at), width, np.uint64)
        for i in range(width):
            short = mixed(short * base + words[at + i])
        grams[at] = short
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    keep = np.ones(len(grams), bool)
    for i in range(len(counts)):
        a = start[i]
        part = grams[a : a + size[i]]
        part.sort()
        keep[a + 1 : a + size[i]] = part[1:] != part[:-1]
        keep[a + size[i] : start[i + 1]] = False
    return grams[keep], np.diff(np.concatenate([[0], np.cumsum(keep)])[start])


def shingles(texts: pa.Array, n: int):
    """(first, last, distinct n-grams in order of the text and hash, number of each text), for runs of texts."""
    data, offsets = utf8(texts)
    for first, last, cuts in pieces(data, offsets, RUN_BYTES, _SPACE):
        if len(cuts) == 2:  # one piece of whole texts
            words, counts = word_hashes(data[cuts[0] : cuts[1]], offsets[first : last + 1] - cuts[0])
        else:  # one long text, cut at blanks
            parts = [word_hashes(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:], strict=False)]
            words = np.concatenate(parts)
            counts = np.array([len(words)])
        yield first, last, *_grams(words, counts, n)


def _keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """96 bits of each set, as integers of 64 and 32 bits; zeros for an empty set."""
    start = np.concatenate([[0], np.cumsum(counts)])
    digests = [hashlib.md5(grams[a:b].tobytes()).digest() if b > a else bytes(16) for a, b in zip(start, start[1:], strict=False)]
    keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).copy()
    keys[:, 1] &= 0xFFFFFFFF
    return keys


def _packed_sets(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Keys in 12 bytes each, counts in 1 (in 2 or 4, if one needs them): they travel once for each fragment that a set is in."""
    most = counts.max(initial=0)
    small = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return keys[:, 0].tobytes() + keys[:, 1].astype(np.uint32).tobytes(), counts.astype(small).tobytes()


def _unpacked_sets(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 12
    columns = np.frombuffer(keys, np.int64, n), np.frombuffer(keys, np.uint32, n, 8 * n).astype(np.int64)
    return np.column_stack(columns), np.frombuffer(counts, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(counts) // max(n, 1) or 1]).astype(np.int64)


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def ngram_parts(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """What all counting needs, from one look at the texts.

    kind 0: doc_id, n (size of its set), hi and lo (the set's key) of each row. kind 1: hi, lo, and in df how many
    of the set's n-grams in one fragment of all n-grams other sets hold too. kind 2: hi, lo, gram and df of these, df
    being the number of sets that hold it. Equal sets count once. A gram is 48 bits of its hash below the number of its
    fragment (mod 2^15), which comes from the other end of the hash: n-grams of different fragments stay apart.
    """
    source = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(8, -(-size // (6 * FRAGMENT_GRAMS * SPANS)))

    def dealt(batches):
        for batch in batches:
            for first, last, grams, counts in shingles(batch.column("text"), n):
                keys = _keys(grams, counts)
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "fragment": pa.array((np.arange(first, last) % fragments).astype(np.int32)), "doc_id": ids, "n": pa.array(counts), "hi": pa.array(keys[:, 0]), "lo": pa.array(keys[:, 1]),
                        "sets": pa.nulls(last - first, pa.binary()), "counts": pa.nulls(last - first, pa.binary()), "grams": pa.nulls(last - first, pa.binary()),
                    }
                )
                once = np.zeros(len(counts), bool)  # copies within the run need not travel
                named = np.flatnonzero(np.asarray(ids.is_valid()))
                once[named[np.unique(keys[named], axis=0, return_index=True)[1]]] = True
                owner = np.repeat(np.arange(len(counts)), counts)
                grams, owner = grams[once[owner]], owner[once[owner]]
                part = _fragment(grams, fragments)
                order = np.argsort(part.astype(np.uint16) if fragments <= 1 << 16 else part, kind="stable")
                grams, owner, part = grams[order], owner[order], part[order]
                at = np.searchsorted(part, np.arange(fragments + 1)) if len(part) > fragments else np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]])
                out = {"fragment": [], "sets": [], "counts": [], "grams": []}
                for a, b in zip(at, at[1:], strict=False):
                    if b > a:
                        held, many = np.unique(owner[a:b], return_counts=True)
                        g = grams[a:b]
                        out["fragment"].append(int(part[a]))
                        packed = _packed_sets(keys[held], many)
                        out["sets"].append(packed[0])
                        out["counts"].append(packed[1])
                        out["grams"].append(g.astype(np.uint32).tobytes() + (g >> np.uint64(32)).astype(np.uint16).tobytes())
                if out["fragment"]:
                    null = pa.nulls(len(out["fragment"]), pa.int64())
                    binary = {k: pa.array(out[k], pa.binary()) for k in ("sets", "counts", "grams")}
                    yield pa.RecordBatch.from_pydict({"fragment": pa.array(out["fragment"], pa.int32()), "doc_id": null, "n": null, "hi": null, "lo": null, **binary})

    def counted(batches):
        held = []
        for batch in batches:
            whole = batch.filter(batch.column("sets").is_null())
            if len(whole):
                null = pa.nulls(len(whole), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(whole), np.int32)), *(whole.column(c) for c in ("doc_id", "n", "hi", "lo")), null, null], names)
            rest = batch.filter(batch.column("sets").is_valid())
            held += zip(*(rest.column(c).to_pylist() for c in ("sets", "counts", "grams")), strict=True)
            if len(rest):
                fragment = rest.column("fragment")[0].as_py() % (1 << 15)  # a task has one fragment
        if not held:
            return
        sets, counts = map(np.concatenate, zip(*(_unpacked_sets(*h[:2]) for h in held), strict=True))
        end = sum(len(h[2]) // 6 for h in held)
        low, high = np.empty(end, np.uint32), np.empty(end, np.uint16)
        while held:  # from the end, so that what has been unpacked goes
            packed = held.pop()[2]
            k = len(packed) // 6
            low[end - k : end], high[end - k : end] = np.frombuffer(packed, np.uint32, k), np.frombuffer(packed, np.uint16, k, 4 * k)
            end -= k
        order = np.lexsort((sets[:, 1], sets[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(sets[order, 0]) != 0) | (np.diff(sets[order, 1]) != 0)
        once = np.zeros(len(order), bool)
        once[order[new]] = True
        owners = np.repeat(np.arange(len(sets), dtype=np.int32), counts)
        good = once[owners]
        held_too = np.zeros(len(sets), np.int64)
        for span in range(SPANS):
            first, last = span * (1 << 16) // SPANS, (span + 1) * (1 << 16) // SPANS - 1
            here = np.flatnonzero(good & (high >= first) & (high <= last))
            grams, owner = low[here] + (high[here].astype(np.int64) << 32), owners[here]
            order = np.argsort(grams)
            grams, owner = grams[order], owner[order]
            start = np.flatnonzero(np.diff(grams, prepend=-1))
            many = np.diff(np.concatenate([start, [len(grams)]]))
            df = np.repeat(many, many)
            shared = df > 1
            grams, owner, df = grams[shared], owner[shared], df[shared]
            order = np.argsort(owner, kind="stable")  # set by set, so that the file holds each key once
            grams, owner, df = grams[order], owner[order], df[order]
            held_too += np.bincount(owner, minlength=len(sets))
            for a in range(0, len(grams), 100_000):
                part = slice(a, a + 100_000)
                yield batch_of(2, sets[owner[part]], pa.array(grams[part] + (fragment << 48)), df[part])
        some = np.flatnonzero(held_too)
        yield batch_of(1, sets[some], pa.nulls(len(some), pa.int64()), held_too[some])

    names = ["kind", "doc_id", "n", "hi", "lo", "gram", "df"]

    def batch_of(kind, sets, grams, df):
        columns = [pa.array(np.full(len(sets), kind, np.int32)), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64()), *(pa.array(np.ascontiguousarray(sets[:, i])) for i in (0, 1)), grams, pa.array(df.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names)

    blobs = source.mapInArrow(dealt, "fragment int, doc_id long, n long, hi long, lo long, sets binary, counts binary, grams binary")
    return written(blobs.repartitionById(fragments, "fragment").mapInArrow(counted, "kind int, doc_id long, n long, hi long, lo long, gram long, df long"), "ngram-parts", batch=BATCH_ROWS)


class _Join:
    """The open sets (which may have a link), their n-grams in the global order, and checks of pairs of them.

    The order is by df, then by hash. A set whose own n-grams fill its prefix in that order can have no link.
    """

    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str):
        self.percent, self.parts = percent, ngram_parts(docs, n, id_col, text_col)
        self.members = self.parts.where("kind = 0").select("doc_id", "n", "hi", "lo")
        sets = self.parts.where("kind < 2").groupBy("hi", "lo").agg(F.max("n").alias("n"), (F.max("n") - F.sum(F.when(F.col("kind") == 1, F.col("df")))).alias("own"))
        sets = sets.where(F.col("own") < self.prefix(F.col("n")))
        self.open = saved(sets.select("hi", "lo", "n", "own", F.monotonically_increasing_id().alias("set")), "ngram-open")
        held = self.parts.where("kind = 2").select("hi", "lo", "gram", "df").join(self.open, ["hi", "lo"]).select("set", "n", "own", "gram", "df")
        by_order = Window.partitionBy("set").orderBy("df", "gram")  # no more rows than a text has words
        held = saved(held.select("set", "n", "gram", "df", (F.col("own") + F.row_number().over(by_order) - 1).alias("at")), "ngram-held")
        ranked = held.where(F.col("at") < self.prefix(F.col("n")))
        several = ranked.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
        self.entries = saved(ranked.join(several, "gram", "left_semi").select("gram", "set", "n", "at"), "ngram-entries")
        # Fragments cut the global order into ranges of about as many entries; the prefixes stand apart, as fragment -1.
        place = F.least("df", F.lit(32767)) * (1 << 48) + F.col("gram") % (1 << 48)
        cuts = held.agg(F.percentile_approx(place, [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
        fragment = sum(((place > c).cast("int") for c in cuts), F.lit(0))
        whole = held.select("set", "n", "gram", fragment.alias("fragment")).unionByName(ranked.select("set", "n", "gram", F.lit(-1).alias("fragment")))
        self.pieces = saved(whole.groupBy("set", "n", "fragment").agg(F.collect_list("gram").alias("grams")), "ngram-pieces")
        discard(held)

    def prefix(self, n):
        """Similar sets share an n-gram of their first so many ones."""
        return n - F.ceil(n * self.percent / 100 - 1e-9) + 1

    def index_prefix(self, n):
        """The same, where the other set is at least as large."""
        return n - F.ceil(n * 2 * self.percent / (100 + self.percent) - 1e-9) + 1

    def needed(self, n_a, n_b):
        return F.ceil((n_a + n_b) * self.percent / (100 + self.percent) - 1e-9)

    def may(self, n_a, at_a, n_b, at_b):
        """Whether sizes, and places of a common n-gram, allow the similarity; the smaller set has it in its index prefix."""
        short = F.when(n_a < n_b, at_a < self.index_prefix(n_a)).when(n_b < n_a, at_b < self.index_prefix(n_b)).otherwise((at_a < self.index_prefix(n_a)) | (at_b < self.index_prefix(n_b)))
        return short & (F.least(n_a, n_b) * 100 >= self.percent * F.greatest(n_a, n_b)) & (F.least(n_a - at_a, n_b - at_b) + F.least(at_a, at_b) >= self.needed(n_a, n_b))

    def verified(self, pairs: DataFrame, bounded: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that are similar enough, with `shared`: overlaps counted in each fragment, summed for each pair.

        The overlap of the prefixes first rules out pairs that could not be similar whatever lies beyond, but for those
        of bounded (a, b), which have passed as much before.
        """
        def sides(fragments):
            some = self.pieces.where(fragments)
            return some.select(F.col("set").alias("a"), "fragment", F.col("n").alias("n_a"), F.col("grams").alias("grams_a")), some.select(F.col("set").alias("b"), "fragment", F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))

        part = F.size(F.array_intersect("grams_a", "grams_b")).alias("part")
        left, right = sides("fragment = -1")
        first = pairs.join(left.drop("fragment"), "a").join(right.drop("fragment"), "b").select("a", "b", "n_a", "n_b", part)
        rest = F.greatest(F.col("n_a") - self.prefix(F.col("n_a")), F.col("n_b") - self.prefix(F.col("n_b")))
        first = first.where(F.col("part") >= self.needed(F.col("n_a"), F.col("n_b")) - rest).select("a", "b")
        first = first if bounded is None else first.unionByName(bounded)
        left, right = sides("fragment >= 0")
        partial = first.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", part)
        summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("shared"))
        return summed.where(100 * F.col("shared") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b", "shared")


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join: every link between different sets, and the rows' membership of the sets.

    Links are a < b (numbers of sets) and shared, the n-grams in both. Members are doc_id, n_shingles, key (its set's number)
    and n_links of each row of docs: the set's links, so 0 for a set that cannot have any (whose number is null), and null
    for a null id.

    Rows whose sets are equal form a class; classes are compared, never their copies. Candidates share an n-gram of
    their prefixes in the global order (rare n-grams first), and their sizes and places allow the similarity; each is
    checked by its overlaps in the ranges of that order. No pair is left out because others link its ends already, so
    a group of near copies makes as many rows as it has links; ngram_components does not.
    """
    join = _Join(docs, n, percent, id_col, text_col)
    x = join.entries.select("gram", F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    y = join.entries.select("gram", F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    pairs = x.join(y, "gram").where((F.col("a") < F.col("b")) & join.may(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"))).select("a", "b").distinct()
    links = saved(join.verified(saved(pairs, "ngram-pairs")), "ngram-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("n_links"))
    known = join.open.join(ends, "set", "left").select("hi", "lo", "set", "n_links")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0)))
    return links, join.members.join(known, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("set").alias("key"), n_links.alias("n_links"))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of its set) and component_id (least doc_id that links reach) for each row of docs.

    The components are those of all links of ngram_links. First each set is checked against neighbours by size, and
    against the first set of its size class, at each n-gram of its prefix; sets that stay outside the largest component
    of an n-gram try a few more; then all candidates of different components are checked. So a large group of near
    copies is not compared pair by pair, and no link between components is left out.

    A null, empty or wordless text has an empty set and is linked with nothing. With fewer than n words the whole
    sequence is one n-gram. Rows with a null id get a null component and take no part; an id that is no number counts
    as null. Repeated rows stay. Rows of one id but different texts are rows of their own. An empty table gives an
    empty result; other columns are not read.
    """
    join = _Join(docs, n, percent, id_col, text_col)
    by_size = Window.partitionBy("gram").orderBy("n", "set")
    by_class = Window.partitionBy("gram", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9)).orderBy("n", "set")
    me = F.struct("set", "n", "at")
    # A try needs no index prefix: any pair may be checked.
    near = join.entries.select("gram", "set", "n", F.array(F.lag(me).over(by_size), F.lag(me, 2).over(by_size), F.first(me).over(by_class)).alias("others"))
    met = near.select("set", "n", F.explode("others").alias("o")).where((F.col("o.set") != F.col("set")) & (F.col("o.n") * 100 >= F.col("n") * percent))
    met = met.select(F.least("set", "o.set").alias("a"), F.greatest("set", "o.set").alias("b")).distinct()
    links = saved(join.verified(met).select("a", "b"), "ngram-links")
    parts = connected_components(links, "a", "b").toDF("set", "component")
    merged = saved(join.entries.select("set").distinct().join(parts, "set", "left").select("set", F.coalesce("component", "set").alias("component")), "ngram-merged")

    def relabelled(links):
        ends = links.join(merged.toDF("a", "c_a"), "a").join(merged.toDF("b", "c_b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        again = connected_components(ends, "a", "b").toDF("component", "whole")
        return saved(merged.join(again, "component", "left").select("set", F.coalesce("whole", "component").alias("component")), "ngram-merged")

    # Heads tell what two sets share at the front. What they do not share up to the end of one head is lost to the overlap:
    # beyond that end it can only be what the one or the other set has left.
    first_entries = F.slice(F.array_sort(F.collect_list(F.struct("at", "gram"))), 1, HEAD)  # no more than a text has words
    heads = join.entries.groupBy("set").agg(first_entries.alias("x")).select("set", F.col("x.gram").alias("head"), F.element_at("x.at", -1).alias("last"))
    heads = saved(heads, "ngram-heads")

    def across():
        """Entries of n-grams that several components hold, with the largest of these, which the others meet, never itself.

        Those of n-grams of many sets have their heads.
        """
        entries = join.entries.join(merged, "set")
        counts = entries.groupBy("gram", "component").agg(F.count("*").alias("c"))
        largest = counts.groupBy("gram").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.count("*").alias("k"), F.sum("c").alias("holders")).where("k > 1").select("gram", "largest", "holders")
        placed = entries.join(largest, "gram").select("gram", "set", "n", "at", "component", "largest", F.row_number().over(by_size).alias("place"), (F.col("holders") >= HEAD).alias("many"))
        headed = placed.join(heads, "set").select(*[c for c in placed.columns if c != "many"], *[F.when(F.col("many"), F.col(c)).alias(c) for c in ("head", "last")])
        return saved(headed, "ngram-across")

    def sides(entries):
        names = {"set": "set", "n": "n", "at": "at", "component": "c", "head": "head", "last": "last"}
        left = entries.where("component <> largest").select("gram", "place", *[F.col(k).alias(f"{v}_a") for k, v in names.items()])
        return left, entries.select("gram", "place", *[F.col(k).alias(f"{v}_b") for k, v in names.items()])

    common = F.array_intersect("head_a", "head_b")
    beyond = F.greatest(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
    can = F.coalesce(F.col("head_a").isNull() | F.col("head_b").isNull() | (F.size(common) + beyond >= join.needed(F.col("n_a"), F.col("n_b"))), F.lit(True))

    def distinct_pairs(rows):
        return rows.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()

    for turn in range(TRIES):
        entries = across()
        if entries.isEmpty():
            break
        left, right = sides(entries)
        steps = [sign * (i * 2**turn + turn) for i in range(1, 7) for sign in (1, -1)]
        tried = left.withColumn("place", F.explode(F.transform(F.array(*map(F.lit, steps)), lambda i: F.col("place") + i))).join(right, ["gram", "place"])
        tried = tried.where((F.col("c_a") != F.col("c_b")) & (F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")) & can)
        found = saved(join.verified(distinct_pairs(tried)).select("a", "b"), "ngram-tried")
        discard(entries)
        if found.isEmpty():
            break
        merged = relabelled(found)

    entries = across()
    # At an n-gram of many sets a pair counts only if it is the first that both have. If their heads have an n-gram in
    # common, the first of these is the pair's first; if not, the pair counts at each.
    left, right = sides(entries)
    left, right = left.drop("place"), right.drop("place")
    first = F.coalesce(F.get(common, F.lit(0)) == left["gram"], F.lit(True))
    pairs = left.join(
        right, (left["gram"] == right["gram"]) & (F.col("c_a") != F.col("c_b")) & join.may(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")) & (F.col("head_a").isNull() | F.col("head_b").isNull() | first) & can
    )
    # Heads that hold whole prefixes have told all that these can tell.
    whole = F.col("head_a").isNotNull() & F.col("head_b").isNotNull() & (join.prefix(F.greatest("n_a", "n_b")) <= HEAD)
    pairs = pairs.groupBy(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).agg(F.max(whole).alias("whole"))
    pairs = saved(pairs, "ngram-pairs")
    merged = relabelled(saved(join.verified(pairs.where("NOT whole").select("a", "b"), pairs.where("whole").select("a", "b")).select("a", "b"), "ngram-more"))
    discard(pairs)
    named = saved(join.open.join(merged, "set", "left").select("hi", "lo", F.coalesce("component", "set").alias("component")), "ngram-named")
    discard(join.entries, join.pieces, entries, links, heads)

    known = join.members.where("doc_id IS NOT NULL AND n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"))
    known = known.join(named, ["hi", "lo"], "left")
    least = known.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component", "left").select("hi", "lo", F.coalesce("component_id", "least").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return join.members.join(known, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


NGRAM_COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
