"""Quality rules as a short-circuit cascade: rules run by rejections for their cost, as a sample shows them, each on what is left."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.llm.common import runs, utf8

#: Texts are measured in runs of so many bytes (or one text), so that memory does not grow with a batch.
RUN_BYTES = 4_000_000

_BYTES = np.arange(256)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
UPPER, LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
LETTER = UPPER | LOWER | (_BYTES >= 128)
#: Bytes that begin a character.
FIRST = (_BYTES & 0xC0) != 0x80


class Texts:
    """Texts as UTF-8 bytes, those of text i being data[offsets[i] : offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self):
        return len(self.offsets) - 1

    def only(self, mask: np.ndarray) -> Texts:
        sizes = np.diff(self.offsets)
        return Texts(self.data[np.repeat(mask, sizes)], np.concatenate([[0], np.cumsum(sizes[mask])]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value for each byte, by text."""
        upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return upto[self.offsets[1:]] - upto[self.offsets[:-1]]


def _starts(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a run of bytes that are inside begins; no run goes on from one text to the next."""
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    return np.flatnonzero(inside & ~before)


def _identities(data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each run, equal for equal bytes."""
    upto = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    at = np.append(upto[starts], upto[-1])
    kept = np.ascontiguousarray(data[inside])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start, which bytes are in words, and the text of each word."""
    inside = ~SPACE[texts.data]
    starts = _starts(inside, texts.offsets)
    return starts, inside, np.searchsorted(texts.offsets, starts, side="right") - 1


def _any_in_runs(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many flagged bytes each run has; bytes between runs are never flagged."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(np.append(upto[starts], upto[-1]))


def words(texts: Texts) -> dict[str, np.ndarray]:
    starts, inside, owner = _words(texts)
    return {"n_words": np.bincount(owner, minlength=len(texts)), "word_chars": texts.sums(inside & FIRST[texts.data])}


def symbols(texts: Texts) -> dict[str, np.ndarray]:
    return {"n_symbols": texts.sums(SYMBOL[texts.data])}


def lines(texts: Texts) -> dict[str, np.ndarray]:
    """Lines with a word, those equal to an earlier one, those that begin as a list does, those that end in an ellipsis."""
    data = texts.data
    inside = data != 10
    starts = _starts(inside, texts.offsets)
    full = _any_in_runs(inside & ~SPACE[data], starts) > 0
    owner = np.searchsorted(texts.offsets, starts, side="right") - 1
    same = pd.factorize(_identities(data, inside, starts) * max(len(texts), 1) + owner)[0][full] if len(starts) else np.zeros(0, np.int64)
    owner = owner[full]
    seen = np.zeros(len(owner), bool)
    seen[np.unique(same, return_index=True)[1]] = True

    word = np.flatnonzero(~SPACE[data])
    first = word[np.searchsorted(word, starts[full])]
    ends = np.append(starts[1:], len(data))[full] if len(starts) else starts
    last = word[np.searchsorted(word, ends) - 1]
    padded = np.concatenate([np.zeros(2, np.uint8), data, np.zeros(2, np.uint8)]).astype(np.int64)
    three = lambda at: padded[at] << 16 | padded[at + 1] << 8 | padded[at + 2]
    bullet = np.isin(data[first], list(b"-*")) | (three(first + 2) == 0xE280A2)
    tail = three(last)
    ellipsis = (tail == 0x2E2E2E) & (last - first >= 2) | (tail == 0xE280A6)
    count = lambda which: np.bincount(owner[which], minlength=len(texts))
    return {"n_lines": count(slice(None)), "n_dup_lines": count(~seen), "n_bullet_lines": count(bullet), "n_ellipsis_lines": count(ellipsis)}


def repeats(texts: Texts) -> dict[str, np.ndarray]:
    """Words in windows of three that a text has twice or more. Windows are told apart by the words themselves."""
    starts, inside, owner = _words(texts)
    if len(starts) < 3:
        return {"n_repeat_words": np.zeros(len(texts), np.int64)}
    word = _identities(texts.data, inside, starts)
    width = int(word.max()) + 1
    pair = pd.factorize(word[:-1] * width + word[1:])[0].astype(np.int64)
    triple = pd.factorize(pair[:-1] * width + word[2:])[0].astype(np.int64)
    whole = np.flatnonzero(owner[2:] == owner[:-2])
    which = pd.factorize(triple[whole] * len(texts) + owner[whole])[0]
    twice = whole[np.bincount(which)[which] > 1] if len(whole) else whole
    covered = np.zeros(len(word), bool)
    for i in range(3):
        covered[twice + i] = True
    return {"n_repeat_words": np.bincount(owner[covered], minlength=len(texts))}


def pairs(texts: Texts) -> dict[str, np.ndarray]:
    """How often a text has its most frequent pair of neighbouring words."""
    starts, inside, owner = _words(texts)
    out = np.zeros(len(texts), np.int64)
    if len(starts) > 1:
        word = _identities(texts.data, inside, starts)
        whole = owner[1:] == owner[:-1]
        key = pd.factorize(word[:-1] * (int(word.max()) + 1) + word[1:])[0].astype(np.int64)[whole]
        which, _ = pd.factorize(key * len(texts) + owner[1:][whole])
        of = np.zeros(int(which.max()) + 1 if len(which) else 0, np.int64)
        of[which] = owner[1:][whole]
        np.maximum.at(out, of, np.bincount(which, minlength=len(of)))
    return {"n_top_pair": out}


def letters(texts: Texts) -> dict[str, np.ndarray]:
    """Words with a letter: one of ASCII's, or any character beyond ASCII."""
    starts, _, owner = _words(texts)
    return {"n_letter_words": np.bincount(owner[_any_in_runs(LETTER[texts.data], starts) > 0], minlength=len(texts))}


def capitals(texts: Texts) -> dict[str, np.ndarray]:
    """Words of two of A to Z at least and none of a to z."""
    starts, _, owner = _words(texts)
    shouted = (_any_in_runs(UPPER[texts.data], starts) > 1) & (_any_in_runs(LOWER[texts.data], starts) == 0)
    return {"n_capital_words": np.bincount(owner[shouted], minlength=len(texts))}


MEASURES: dict[str, Callable[[Texts], dict[str, np.ndarray]]] = {f.__name__: f for f in (words, symbols, lines, repeats, pairs, letters, capitals)}
BASE = ("words", "symbols", "lines", "repeats")
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    """Rejects texts for which test says true of the values that its measures give."""

    name: str
    measures: tuple[str, ...]
    test: Callable[[dict[str, np.ndarray]], np.ndarray]


def base_failed(m):
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


RULES = (
    Rule("symbols", ("words", "symbols"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", ("words",), lambda m: (m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 10 * m["n_words"])),
    Rule("repeated_lines", ("lines",), lambda m: (m["n_dup_lines"] > 2) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    Rule("bullets", ("lines",), lambda m: 10 * m["n_bullet_lines"] > 9 * m["n_lines"]),
    Rule("ellipses", ("lines",), lambda m: 10 * m["n_ellipsis_lines"] > 3 * m["n_lines"]),
    Rule("letters", ("words", "letters"), lambda m: 10 * m["n_letter_words"] < 8 * m["n_words"]),
    Rule("capitals", ("words", "capitals"), lambda m: 2 * m["n_capital_words"] > m["n_words"]),
    Rule("pairs", ("words", "pairs"), lambda m: 10 * m["n_top_pair"] > m["n_words"]),
)


def in_order(rules: tuple[Rule, ...], masks: dict[int, int], costs: dict[str, float], known: tuple[str, ...] = ()) -> list[int]:
    """Places of the rules, each next one rejecting most of the sample that is left for the cost of measures not yet taken.

    masks: rows of the sample by the set of rules (as bits) that reject them. Rules that reject nothing more come last,
    the cheaper first.
    """
    left, have, order = dict(masks), set(known), []
    while len(order) < len(rules):
        def worth(i):
            cost = 1e-9 + sum(costs.get(m, 0.0) for m in rules[i].measures if m not in have)
            return sum(n for mask, n in left.items() if mask >> i & 1) / cost, -cost, -i

        best = max((i for i in range(len(rules)) if i not in order), key=worth)
        order.append(best)
        have.update(rules[best].measures)
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return order


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = (), text_col: str = "text", sample_rows: int = 4000) -> list[int]:
    """The order of the rules for these texts, from a sample of some sample_rows of them.

    All rules see each row of the sample. What comes to the driver is the time of each measure and the number of rows
    of each set of rejecting rules. An empty table leaves the rules as they are.
    """
    n = docs.count()
    drawn = docs.select(F.col(f"`{text_col}`").alias("text")).sample(min(1.0, sample_rows / max(n, 1)), 11)

    def tried(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for first, last in runs(offsets, RUN_BYTES):
                texts, m, spent = Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]), {}, []
                for name, measure in MEASURES.items():
                    began = time.thread_time()
                    m |= measure(texts)
                    spent.append((name, 0, time.thread_time() - began))
                mask = sum((rule.test(m).astype(np.int64) << i for i, rule in enumerate(rules)), np.zeros(len(texts), np.int64))
                found, counts = np.unique(mask, return_counts=True)
                rows = spent + [("", int(k), float(c)) for k, c in zip(found, counts, strict=True)]
                yield pa.RecordBatch.from_pydict({"measure": [r[0] for r in rows], "mask": pa.array([r[1] for r in rows], pa.int64()), "amount": pa.array([r[2] for r in rows], pa.float64())})

    found = drawn.mapInArrow(tried, "measure string, mask long, amount double").groupBy("measure", "mask").agg(F.sum("amount").alias("amount")).collect()
    return in_order(rules, {r.mask: r.amount for r in found if not r.measure}, {r.measure: r.amount for r in found if r.measure}, known)


def run_cascade(texts: Texts, rules: tuple[Rule, ...], order: list[int], m: dict[str, np.ndarray], rejected: np.ndarray, taken: tuple[str, ...]) -> np.ndarray:
    """For each text the place of the rule that rejects it, -1 if none does, -2 where it was rejected before.

    m holds the measures already taken of all texts. A rule runs on what all rules before it left, and its measures
    are taken of that alone.
    """
    verdict = np.where(rejected, -2, -1)
    left = np.flatnonzero(~rejected)
    texts, m, taken = texts.only(~rejected), {k: v[left] for k, v in m.items()}, set(taken)
    for i in order:
        if not len(left):
            break
        for name in rules[i].measures:
            if name not in taken:
                m |= MEASURES[name](texts)
                taken.add(name)
        out = rules[i].test(m)
        if out.any():
            verdict[left[out]] = i
            left, texts, m = left[~out], texts.only(~out), {k: v[~out] for k, v in m.items()}
    return verdict


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 4000) -> DataFrame:
    """doc_id, the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed, kept and rejected_by.

    The base counts are taken of every whole text; a text that fails the base (under 50 words, or more than half of its
    words in repeated windows of three) meets no rule. The others run through the rules in the order that `plan` finds;
    the first that rejects a text names it in rejected_by. Which one that is depends on the order, kept does not.

    A null text has no words, as an empty one, and fails. Repeated rows and null ids stay; an empty table gives an empty
    result; other columns are not read.
    """
    order = plan(docs, rules, BASE, text_col, sample_rows)

    def judged(batches):
        for batch in batches:
            ids = batch.column(0)
            data, offsets = utf8(batch.column(1))
            for first, last in runs(offsets, RUN_BYTES):
                texts, m = Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]), {}
                for name in BASE:
                    m |= MEASURES[name](texts)
                failed = base_failed(m)
                verdict = run_cascade(texts, rules, order, m, failed, BASE)
                names = pa.array([None if v == -1 else "base" if v == -2 else rules[v].name for v in verdict.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), *(pa.array(m[c].astype(np.int64)) for c in BASE_COLUMNS), pa.array(failed), pa.array(verdict == -1), names],
                    ["doc_id", *BASE_COLUMNS, "base_failed", "kept", "rejected_by"],
                )

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judged, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE_COLUMNS)}, base_failed boolean, kept boolean, rejected_by string")


RULES_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, w[i:i + 2] AS g, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM h WHERE n > 1) GROUP BY 1),
p AS (SELECT doc_id, max(n) AS n_top_pair FROM (
    SELECT doc_id, w[i:i + 1] AS g, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_top_pair, 0) AS n_top_pair,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
    len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$'))) AS n_capital_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)
    OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines OR 10 * n_letter_words < 8 * n_words OR 2 * n_capital_words > n_words
    OR 10 * n_top_pair > n_words) AS kept
FROM b
"""
