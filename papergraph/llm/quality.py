"""Quality scores from preference pairs: Bradley-Terry by logistic loss on differences of features."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.llm.common import fresh

FEATURES = 13
#: The score of a text that stands just at the threshold.
AT_THRESHOLD = 0.7
_BARE = re.compile(r"\W+")


def features(text: str | None) -> np.ndarray:
    """Shares that tell prose from junk: symbols, capitals, digits, repeated words and lines, lengths of words and lines."""
    x = np.zeros(FEATURES)
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        x[0] = 1.0
        return x
    counts = Counter(words)
    lines = [s for s in text.split("\n") if s.strip()]
    letters = sum(map(len, _BARE.split(text)))
    pairs = len(set(zip(words, words[1:], strict=False)))
    x[1] = np.log1p(n)
    x[2] = np.log(len(counts) + 1) / np.log(n + 1)
    x[3] = pairs / max(1, n - 1)
    x[4] = counts.most_common(1)[0][1] / n
    x[5] = letters / size
    x[6] = min(1.0, 5 * sum(text.count(c) for c in "#$%&*|<>{}[]=\\^~_@") / n)
    x[7] = sum(w.isupper() and len(w) > 1 for w in words) / n
    x[8] = sum(w[0].isdigit() for w in words) / n
    x[9] = min(1.0, text.count("!") / n)
    x[10] = min(20.0, letters / n)
    x[11] = len(set(lines)) / max(1, len(lines))
    x[12] = min(1.0, text.count("|") / n)
    return x


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.spread) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, pairs: int = 20_000, rounds: int = 400, seed: int = 7) -> QualityModel:
    """Draws preference pairs, a row of label 1 over one of label 0, and lowers their logistic loss.

    The threshold is the quantile of the rows' scores at the share of label 0 among them.
    """
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, weights = (x - mean) / spread, np.zeros(x.shape[1])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(mean, spread, weights, 0.0 if len(good) else 1.0)
    differences = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        margin = differences @ weights
        gradient = -(differences / (1 + np.exp(np.clip(margin, -30, 30)))[:, None]).mean(axis=0) + 1e-4 * weights
        speed = 0.9 * speed - 0.3 * gradient
        weights = weights + speed
    raw = np.sort(z @ weights)
    cut = len(bad)
    return QualityModel(mean, spread, weights, float((raw[cut - 1] + raw[cut]) / 2))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> QualityModel | None:
    """Learns from at most max_rows of the rows of docs (doc_id, text) that labels (doc_id, quality) marks 0 or 1.

    Rows are chosen by a hash of doc_id. Null ids, labels and texts, and ids with both labels, teach nothing; None if no row is left.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    marks = marks.where("label = other").select("doc_id", "label")
    n = marks.count()
    draw = F.xxhash64(F.lit("quality"), "doc_id").bitwiseAND(F.lit(2**62 - 1))
    drawn = marks.where(draw < int(min(1.0, 0.9 * max_rows / max(n, 1)) * 2**62)).limit(max_rows)
    wanted = {r[0]: r[1] for r in drawn.collect()}
    if not wanted:
        return None
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isin(list(wanted))) if len(wanted) <= 100 else docs.where("text IS NOT NULL").join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")), "doc_id", "left_semi")

    @F.arrow_udf("array<double>")
    def measured(values: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in values], pa.list_(pa.float64()))

    got = texts.select("doc_id", measured("text").alias("x")).limit(max_rows).collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    if not got:
        return None
    return train(np.array([r.x for r in got]), np.array([wanted[r.doc_id] for r in got]))


def score_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from a score of 0.7) to the columns named by keep.

    The whole text counts, and nothing else. Null and empty texts are scored as texts without words. If there was
    nothing to learn from, every score is 0.5. Repeated rows stay; an empty table gives an empty result; columns named
    like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if model is None or not len(texts):
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(model.score(np.stack([features(t.as_py()) for t in texts])))

    x = fresh("x", keep)
    columns = [F.col(f"`{c}`") for c in keep]
    scores = docs.select(*columns, scored(F.col(f"`{text_col}`")).alias(x))
    return scores.select(*columns, F.col(x).alias("score"), (F.col(x) >= AT_THRESHOLD).cast("int").alias("predicted"))
