"""Removal of long repeated byte strings by prefix-free parsing: phrases at rolling-hash triggers, and a suffix-sorted dictionary."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.llm.common import discard, mixed, runs, saved, utf8

#: Bytes of text that are cut at a time, triggers that one task groups, and phrases that are suffix-sorted at a time.
RUN_BYTES = 1 << 18
FRAGMENT_TRIGGERS = 300_000
SORTED_PHRASES = 8_192

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Hashes of any substring of a run, from sums of its bytes' values times powers of the base."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling.up) <= n:
            Rolling.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            Rolling.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * Rolling.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Rolling.down[start])


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over each run of width values."""
    out, reach = x, 1
    while reach < width:
        step = min(reach, width - reach)
        out = of(out[:-step], out[step:])
        reach += step
    return out


def _gram(length: int) -> int:
    return max(1, length * 36 // 100)


def triggers(data: np.ndarray, offsets: np.ndarray, length: int):
    """Triggers of the texts of a run: places, texts, hashes, and start, end and hash of the phrase around each.

    A trigger is a short gram whose hash is least in some string of `length` bytes; each such string holds one, set by
    its bytes alone. The phrase of a trigger is all that the strings of that length that hold it can reach, so that every
    string of that length lies in a phrase whole.
    """
    n, gram = len(data), _gram(length)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    back = length - gram
    rolling = Rolling(data)
    at = np.arange(n - gram + 1)
    h = rolling.of(at, at + gram)
    least = _sliding(h, back + 1, np.minimum)
    inside = np.zeros(n - length + 1, bool)
    for a, b in zip(offsets, offsets[1:], strict=False):
        inside[a : max(a, b - length + 1)] = True
    least = np.where(inside, least, np.uint64(0))  # a string over two texts sets no trigger
    pad = np.zeros(back, np.uint64)
    p = np.flatnonzero((h == _sliding(np.concatenate([pad, least, pad]), back + 1, np.maximum)) & (h > 0))
    text = np.searchsorted(offsets, p, side="right") - 1
    low = np.maximum(p - back, offsets[text])
    high = np.minimum(p, offsets[text + 1] - length) + length
    phrase = mixed(rolling.of(low, high) ^ ((p - low) * 1009 + (high - low)).astype(np.uint64))
    return p, text, h[p], low, high, phrase


def _parsed(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first, last text, triggers' places in their texts, texts from first, hashes, phrases' starts, ends, hashes), run by run."""
    for first, last in runs(offsets, RUN_BYTES):
        a, b = int(offsets[first]), int(offsets[last])
        if b - a <= RUN_BYTES:
            inner = offsets[first : last + 1] - a
            p, text, h, low, high, phrase = triggers(data[a:b], inner, length)
            yield first, last, p - inner[text], text, h, low - inner[text], high - inner[text], phrase
        else:  # a long text in parts; each part sees what the phrases of its triggers reach
            for at in range(a, b, RUN_BYTES):
                lo, hi = max(a, at - 2 * length), min(b, at + RUN_BYTES + 2 * length)
                p, text, h, low, high, phrase = triggers(data[lo:hi], np.array([0, hi - lo]), length)
                own = (p + lo >= at) & (p + lo < at + RUN_BYTES)
                yield first, last, p[own] + lo - a, text[own], h[own], low[own] + lo - a, high[own] + lo - a, phrase[own]


def _fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _starts(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Whether each row is unlike the one before in any column."""
    new = np.ones(len(x), bool)
    if len(x):
        new[1:] = x[1:] != x[:-1]
        for y in more:
            new[1:] |= y[1:] != y[:-1]
    return new


def suffix_classes(phrases: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dictionary's suffixes of at least `length` bytes: phrase, start in it, and rank by the first `length` bytes.

    The suffixes are sorted by prefix doubling: the rank by twice as many bytes is that of a pair of ranks. Ranks are
    those of the dictionary's suffix array, with equal ones where the first `length` bytes are.
    """
    sizes = np.array([len(x) for x in phrases])
    data = np.frombuffer(b"".join(phrases), np.uint8)
    end = np.repeat(np.cumsum(sizes), sizes)
    left = end - np.arange(len(data))  # bytes from here to the end of the phrase
    reach = min(8, length)
    rank = np.zeros(len(data), np.uint64)
    for i in range(reach):
        rank[: len(data) - i] = (rank[: len(data) - i] << np.uint64(8)) | data[i:]
    at = np.flatnonzero(left >= reach)
    ranks = np.zeros(len(data), np.int64)
    ranks[at] = np.unique(rank[at], return_inverse=True)[1]
    while reach < length:
        step = min(reach, length - reach)
        at = np.flatnonzero(left >= reach + step)
        pair = (ranks[at] << 32) | ranks[at + step]
        ranks[at] = np.unique(pair, return_inverse=True)[1]
        reach += step
    at = np.flatnonzero(left >= length)
    owner = np.repeat(np.arange(len(phrases)), sizes)[at]
    return owner, at - (np.cumsum(sizes) - sizes)[owner], ranks[at]


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the spans cover, touching ones as one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    return low[new], high[np.concatenate([np.flatnonzero(new)[1:], [len(low)]]) - 1]


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start and end of the removed runs) for each row of docs.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same text. Texts are parsed into phrases around triggers; a string of that length never spans two of them. The
    dictionary holds each distinct phrase once, at its first place in the parse: what its later places reach goes. Of
    dictionary phrases that share their trigger with others the suffixes are sorted, and of suffixes that begin with the
    same `length` bytes all but the first in corpus order go.

    Null texts are empty. A null id (or one that is no number) is smaller than any other. Rows of one id are ordered by
    a hash of their texts; those of one id and text are judged as one and get the same result. An empty table gives an
    empty result; other columns are not read. Triggers are equal if 48 bits of their hashes are, phrases if 64 more are.
    """
    number = F.col(f"`{id_col}`").try_cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(8, -(-size // (length // 3 * FRAGMENT_TRIGGERS)))

    def parse(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = np.column_stack([np.asarray(batch.column(c)) for c in ("d", "t")])
            for first, last, p, owner, h, low, high, phrase in _parsed(data, offsets, length):
                part = _fragment(h, fragments)
                order = np.argsort(part.astype(np.uint16) if fragments <= 1 << 16 else part, kind="stable")
                part = part[order]
                cuts = np.concatenate([np.flatnonzero(_starts(part)), [len(part)]])
                out = {"fragment": [], "texts": [], "triggers": []}
                for a, b in zip(cuts, cuts[1:], strict=False):
                    i = order[a:b]
                    held, of = np.unique(owner[i], return_inverse=True)
                    fields = (h[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h[i] >> np.uint64(32)).astype(np.uint16), phrase[i], p[i].astype(np.uint32), (p[i] - low[i]).astype(np.uint16), (high[i] - p[i]).astype(np.uint16), of.astype(np.uint32)
                    out["fragment"].append(int(part[a]))
                    out["texts"].append(keys[first:last][held].tobytes())
                    out["triggers"].append(b"".join(f.tobytes() for f in fields))
                if out["fragment"]:
                    yield pa.RecordBatch.from_arrays([pa.array(out["fragment"], pa.int32()), pa.array(out["texts"], pa.binary()), pa.array(out["triggers"], pa.binary())], list(out))

    kinds = np.dtype([("x", np.uint32), ("y", np.uint16), ("phrase", np.uint64), ("p", np.uint32), ("back", np.uint16), ("on", np.uint16), ("of", np.uint32)])

    def dictionary(batches):
        """Spans of later places of a phrase (trigger null), and the first places of phrases with a shared trigger."""
        texts, columns, base = [], {c: [] for c in kinds.names}, 0
        for batch in batches:
            for held, raw in zip(batch.column("texts").to_pylist(), batch.column("triggers").to_pylist(), strict=True):
                held = np.frombuffer(held, np.int64).reshape(-1, 2)
                n, at = len(raw) // kinds.itemsize, 0
                for c in kinds.names:
                    columns[c].append(np.frombuffer(raw, kinds[c], n, at))
                    at += n * kinds[c].itemsize
                columns["of"][-1] = columns["of"][-1] + np.uint32(base)
                texts.append(held)
                base += len(held)
        if not base:
            return
        texts = np.concatenate(texts)
        x = {c: np.concatenate(columns.pop(c)) for c in kinds.names}
        d, t = texts[x["of"], 0], texts[x["of"], 1]
        trigger = x["x"].astype(np.int64) | (x["y"].astype(np.int64) << 32)
        order = np.argsort(trigger)
        new = _starts(trigger[order])
        order = order[~(new & np.append(new[1:], True))]  # triggers that stand twice at least
        order = order[np.lexsort((x["p"][order], t[order], d[order], x["phrase"][order], trigger[order]))]
        trigger, d, t, p, back, on = (v[order] for v in (trigger, d, t, x["p"].astype(np.int64), x["back"], x["on"]))
        new = _starts(trigger, x["phrase"][order])
        later = ~new
        yield rows(d[later], t[later], p[later] - back[later], p[later] + on[later], None)
        several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(_starts(trigger))) if len(new) else np.zeros(0, np.int64)
        apart = new & (np.repeat(several, np.diff(np.append(np.flatnonzero(_starts(trigger)), len(new)))) > 1)
        yield rows(d[apart], t[apart], p[apart] - back[apart], p[apart] + on[apart], trigger[apart])

    def rows(d, t, low, high, trigger):
        columns = [pa.array(v.astype(np.int64)) for v in (d, t, low, high)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(d), pa.int64()) if trigger is None else pa.array(trigger)], ["d", "t", "low", "high", "trigger"])

    spans_type = "d long, t long, low long, high long, trigger long"
    blobs = source.select("d", "t", "text").mapInArrow(parse, "fragment int, texts binary, triggers binary")
    found = saved(blobs.repartitionById(fragments, "fragment").mapInArrow(dictionary, spans_type), "repeat-phrases")

    apart = found.where("trigger IS NOT NULL")
    n_apart = apart.count()
    parts = max(8, -(-n_apart // (4 * SORTED_PHRASES)))
    wanted = apart.groupBy("d", "t").agg(F.collect_list(F.struct("low", "high", "trigger")).alias("phrases"))  # fewer than a text's bytes

    def phrases(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, (d, t, held) in enumerate(zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("phrases"), strict=True)):
                low, high, trigger = (np.asarray(held.values.field(c)) for c in ("low", "high", "trigger"))
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                content = [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                part = (mixed(trigger) % np.uint64(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(low), d)), pa.array(np.full(len(low), t)), pa.array(low), pa.array(trigger), pa.array(content, pa.binary())], ["part", "d", "t", "low", "trigger", "content"]
                )

    def compared(batches):
        held = [(d, t, low, trigger, content) for batch in batches for d, t, low, trigger, content in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "low", "trigger", "content")), strict=True)]
        held.sort(key=lambda r: r[3])
        first = 0
        while first < len(held):
            last = min(len(held), first + SORTED_PHRASES)
            while last < len(held) and held[last][3] == held[last - 1][3]:  # phrases of one trigger stay together
                last += 1
            some = held[first:last]
            first = last
            owner, start, rank = suffix_classes([r[4] for r in some], length)
            keys = np.array([r[:3] for r in some], np.int64)
            texts = np.unique(keys[:, :2], axis=0, return_inverse=True)[1].reshape(-1)
            place = (texts[owner].astype(np.int64) << 32) | (keys[owner, 2] + start)
            order = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(_starts(rank[order]))
            least = np.minimum.reduceat(place[order], cuts) if len(cuts) else place
            again = np.zeros(len(place), bool)
            again[order] = place[order] > np.repeat(least, np.diff(np.append(cuts, len(order))))
            owner, start = owner[again], start[again]
            begin = np.ones(len(owner), bool)
            begin[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + 1)
            a = np.flatnonzero(begin)
            b = np.append(a[1:], len(owner)) - 1
            of = keys[owner[a]] if len(a) else np.zeros((0, 3), np.int64)
            yield rows(of[:, 0], of[:, 1], of[:, 2] + start[a], of[:, 2] + start[b] + length if len(a) else start[a], None)

    told = source.select("d", "t", "text").join(wanted, ["d", "t"])
    told = told.mapInArrow(phrases, "part int, d long, t long, low long, trigger long, content binary")
    again = saved(told.repartitionById(parts, "part").mapInArrow(compared, spans_type), "repeat-suffixes")
    spans = found.where("trigger IS NULL").union(again).groupBy("d", "t").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = saved(spans, "repeat-spans")
    discard(found, again)

    def kept(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            for i, held in enumerate(batch.column("spans")):
                raw = data[offsets[i] : offsets[i + 1]]
                none = np.zeros(0, np.int64)
                low, high = _merged(np.asarray(held.values.field("low")), np.asarray(held.values.field("high"))) if held.is_valid else (none, none)
                digest = hashlib.sha256()
                for a, b in zip(np.append(0, high), np.append(low, len(raw)), strict=True):
                    digest.update(raw[a:b])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int((high - low).sum()))
                out["n_spans"].append(len(low))
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append(np.column_stack([low, high]).ravel().tolist())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kind) if isinstance(v, list) else v for (k, v), kind in zip(out.items(), types, strict=True)})

    joined = source.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
