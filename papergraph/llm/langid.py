"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.llm.common import fresh, runs, utf8

UNKNOWN = "und"
BUCKETS = 4096
#: Bytes of text that are scored at a time; a longer text is scored in parts, whose sums add up.
RUN_BYTES = 1 << 17

#: ASCII letters in lower case, bytes of longer code points as they are, all else a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _folded(data: np.ndarray) -> np.ndarray:
    """Text with letters alone; capitals of the Latin-1 block are lowered too."""
    out = _FOLD[data]
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 0x20
    return out


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in folded bytes the buckets of the three and four bytes from there; -1 where they hold no letter."""
    b = np.concatenate([data, np.full(4, 32, np.uint8)]).astype(np.uint32)
    n = len(data)
    three = (b[:n] * np.uint32(0x9E3779B1)) ^ (b[1 : n + 1] * np.uint32(0x85EBCA6B)) ^ (b[2 : n + 2] * np.uint32(0xC2B2AE35))
    four = three * np.uint32(0x27D4EB2F) + b[3 : n + 3] * np.uint32(0x165667B1)
    shift = np.uint32(32 - int(np.log2(BUCKETS)))
    letters = b != 32
    some = letters[1 : n + 1] & (letters[:n] | letters[2 : n + 2])
    i3 = np.where(some, ((three ^ (three >> np.uint32(15))) * np.uint32(0x2545F491)) >> shift, BUCKETS)
    i4 = np.where(some & letters[2 : n + 2], ((four ^ (four >> np.uint32(15))) * np.uint32(0x2545F491)) >> shift, BUCKETS)
    return i3.astype(np.int32), i4.astype(np.int32)


def has_letter(folded: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter: a look at its folded bytes, and at its characters where no ASCII letter is found."""
    ascii_letter = (folded != 32) & (folded < 128)
    found = np.diff(np.concatenate([[0], np.cumsum(ascii_letter, dtype=np.int64)])[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return found


@dataclass
class LanguageModel:
    """logits has a row for each bucket (embedding times softmax weights) and one of zeros for what is no subword."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    sharpness: float
    least: float

    def _sums(self, part: np.ndarray, start: np.ndarray, size: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the logits of each text's subwords among the first `own` bytes of the folded run, and their number."""
        total, count = np.zeros((len(size), len(self.languages))), np.zeros(len(size), np.int64)
        full = np.flatnonzero(size)
        if not len(full):
            return total, count
        ends = (start + size)[full]
        for index, reach in zip(subwords(part), (2, 3), strict=True):
            for back in range(1, reach + 1):  # subwords that would run into the next text
                at = ends - back
                index[at[at >= start[full]]] = BUCKETS
            index = index[:own]
            total[full] += np.add.reduceat(self.logits[index], start[full], axis=0)
            count[full] += np.add.reduceat((index != BUCKETS).astype(np.int64), start[full])
        return total, count

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability, and whether that is too low, for each text."""
        data, offsets = utf8(texts)
        best, probability, known = np.zeros(len(texts), np.intp), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for first, last in runs(offsets, RUN_BYTES):
            a, b = int(offsets[first]), int(offsets[last])
            if b - a <= RUN_BYTES:
                part, inner = _folded(data[a:b]), offsets[first : last + 1] - a
                total, count = self._sums(part, inner[:-1], np.diff(inner), b - a)
                known[first:last] = has_letter(part, inner, texts.slice(first, last - first))
            else:
                total, count = np.zeros((1, len(self.languages))), np.zeros(1, np.int64)
                for at in range(a, b, RUN_BYTES):
                    own = min(RUN_BYTES, b - at)
                    part = _folded(data[at : min(at + own + 3, b)])
                    # The three bytes beyond belong to subwords that begin before; the text's own end is that of its last part.
                    sums = self._sums(np.concatenate([part, np.full(3, 32, np.uint8)]) if at + own < b else part, np.zeros(1, np.int64), np.array([len(part) + 3 if at + own < b else len(part)]), own)
                    total, count = total + sums[0], count + sums[1]
                    known[first] |= bool(((part != 32) & (part < 128)).any())
                if not known[first]:
                    known[first] = any(c.isalpha() for c in texts[first].as_py())
            z = self.sharpness * (total / np.maximum(count, 1)[:, None] + self.bias)
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            best[first:last], probability[first:last] = p.argmax(axis=1), p.max(axis=1)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
        probability = np.where(known, probability, 0.0)
        return names, probability, ~known | (probability < self.least)


def counts_of(texts: pa.Array) -> np.ndarray:
    """Shares of the buckets in each text."""
    data, offsets = utf8(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i in range(len(texts)):
        part = _folded(data[offsets[i] : offsets[i + 1]])
        for index, reach in zip(subwords(part), (2, 3), strict=True):
            index = index[: max(0, len(index) - reach)]
            out[i] += np.bincount(index, minlength=BUCKETS + 1)[:BUCKETS]
        out[i] /= max(1.0, float(out[i].sum()))
    return out


def train(x: np.ndarray, y: np.ndarray, languages: list[str], dim: int = 16, epochs: int = 40, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on embeddings and softmax weights; a fifth of the rows calibrates the scores.

    The sharpness minimises the log loss of the rows set aside; the least score is the one that one in a thousand of
    those predicted rightly falls below, and one half at most.
    """
    rng = np.random.default_rng(seed)
    k, order = len(languages), rng.permutation(len(y))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if len(held) < 5:
        held = fit = order
    e, w, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, k)), np.zeros(k)
    eye, step = np.eye(k), 1.0
    scale = np.float32(30.0)
    for epoch in range(epochs):
        rate = step * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            xb = x[at] * scale
            z = xb @ e
            s = z @ w + bias
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            p /= p.sum(axis=1, keepdims=True)
            g = (p - eye[y[at]]) / len(at)
            gw, gz = z.T @ g, g @ w.T
            e -= rate * (xb.T @ gz)
            w -= rate * gw
            bias -= rate * g.sum(axis=0)
    logits = (scale * (e @ w)).astype(np.float32)
    raw = x[held] @ logits + bias
    best = (np.inf, 1.0)
    for sharpness in np.geomspace(0.25, 4, 17):
        s = sharpness * raw
        s = s - s.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]))
        best = min(best, (loss, float(sharpness)))
    s = best[1] * raw
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    least = min(0.5, float(np.quantile(right, 0.001))) if len(right) else 0.0
    zeros = np.zeros((1, k), np.float32)
    return LanguageModel(languages, np.concatenate([logits, zeros]), bias, best[1], least)


def fit_languages(labelled: DataFrame, text_col: str, lang_col: str, key_col: str, max_rows: int = 3000) -> LanguageModel | None:
    """Learns from at most max_rows rows of labelled, as many of each language as there are, chosen by a hash of the key.

    Null languages and texts teach nothing. None if no row is left.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(found)
    if not languages:
        return None
    each = max(1, max_rows // len(languages))
    draw = F.xxhash64(F.lit("langid"), F.col(key_col)).bitwiseAND(F.lit(2**62 - 1))
    chosen = F.lit(False)
    for name in languages:
        chosen = chosen | ((F.col(lang_col) == name) & (draw < int(min(1.0, 0.9 * each / found[name]) * 2**62)))
    drawn = rows.where(chosen).select(F.col(lang_col).alias("lang"), F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"))

    def counted(batches):
        for batch in batches:
            x = counts_of(batch.column("text"))
            out = {"lang": batch.column("lang"), "key": batch.column("key"), "x": pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    got = drawn.mapInArrow(counted, "lang string, key string, x binary").limit(max_rows).collect()
    got.sort(key=lambda r: (r.key or "", r.lang, r.x))
    if not got:
        return None
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32)
    place = {name: i for i, name in enumerate(languages)}
    return train(x, np.array([place[r.lang] for r in got]), languages)


def identify_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected to the columns named by keep (all but text unless given).

    The whole text counts. Null, empty and letterless texts are `und` with score 0 and rejected, as is every text if
    there was nothing to learn from. Repeated rows stay; an empty table gives an empty result. Columns of docs that
    are named like the new ones are replaced.
    """
    added = {"lang_pred", "score", "rejected"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]

    # A function of the text alone: the other columns never leave the JVM.
    @F.arrow_udf("struct<lang_pred string, score double, rejected boolean>")
    def scored(texts: pa.Array) -> pa.Array:
        if model is None:
            got = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        else:
            got = model.score(texts)
        columns = pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.bool_())
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "rejected"])

    x = fresh("x", keep)
    columns = [F.col(f"`{c}`") for c in keep]
    return docs.select(*columns, scored(F.col(f"`{text_col}`")).alias(x)).select(*columns, f"{x}.lang_pred", f"{x}.score", f"{x}.rejected")
