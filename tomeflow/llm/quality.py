"""Quality classifier by Bradley-Terry pairwise ranking.

Documents become a short feature vector of their text. From labelled rows,
pairs (good, bad) are drawn; the weights minimise the logistic loss of feature
differences, which is the Bradley-Terry likelihood of "good beats bad". The
cut is a quantile of the training scores: the share of bad rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import small_batches

FEATURES = (
    "log_bytes", "upper", "digit", "mark", "odd_mark", "space", "newline", "high_bytes", "word_length", "long_words",
    "marked_words", "capital_words", "distinct_words", "distinct_lines", "top_word",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ODD = _MARK.copy()
_ODD[[ord(c) for c in ".,'\"-()?:;"]] = False
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(body: bytes) -> list[float]:
    """Feature vector of a whole text; that of an empty text is all zeros."""
    n = len(body)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(body, np.uint8)
    h = np.bincount(raw, minlength=256)
    part = lambda mask: float(h[mask].sum()) / n
    white = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([1], white.astype(np.int8), [1]))))
    starts, ends = edge[0::2], edge[1::2]
    words = len(starts)
    lines = body.split(b"\n")
    if words:
        size = ends - starts
        tokens = body.split()
        marked = float(_ODD[raw[ends - 1]].mean())
        capital = float((_UPPER[raw[starts]] & _UPPER[raw[ends - 1 - (size > 2)]]).mean())
        counts: dict[bytes, int] = {}
        for t in tokens:
            counts[t] = counts.get(t, 0) + 1
        distinct, top = len(counts) / words ** 0.9, max(counts.values()) / words
        mean, long = float(size.mean()), float((size > 14).mean())
    else:
        marked = capital = distinct = top = mean = long = 0.0
    return [
        math.log1p(n), part(_UPPER), part(_DIGIT), part(_MARK), part(_ODD), part(_SPACE), float(h[10]) / n, float(h[128:].sum()) / n, mean,
        long, marked, capital, distinct, len(set(lines)) / len(lines), top,
    ]


@dataclass(frozen=True)
class BradleyTerry:
    """score = sigmoid(slope * (w . standardised features - cut) + logit(at)),
    so that a document at the quantile cut has the score ``at``."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    cut: float
    slope: float
    at: float = 0.3

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return z @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        t = self.slope * (self.strength(x) - self.cut) + math.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(t, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, l2: float = 1e-3, steps: int = 40, seed: int = 5, at: float = 0.3) -> BradleyTerry:
    """Fit on feature rows ``x`` and labels ``y`` (1 good, 0 bad). With one class
    only, nothing can be ranked and every score is the class's."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    none = BradleyTerry(mean.tolist(), scale.tolist(), [0.0] * len(FEATURES), 0.0, 0.0, 0.95 if len(good) or not len(bad) else 0.05)
    if not len(good) or not len(bad):
        return none
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):  # Newton steps of the regularised logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # chance that bad wins
        g = d.T @ p / pairs - l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w = w + step * min(1.0, 5 / (np.linalg.norm(step) + 1e-12))
        if np.linalg.norm(step) < 1e-7:
            break
    s = z @ w
    order = np.sort(s)
    k = len(bad)  # the quantile at the bad rows' share, halfway to the next score
    cut = float((order[k - 1] + order[min(k, len(order) - 1)]) / 2)
    slope = _slope(s - cut, y, math.log(at / (1 - at)))
    return BradleyTerry(mean.tolist(), scale.tolist(), w.tolist(), cut, slope, at)


def _slope(s: np.ndarray, y: np.ndarray, shift: float) -> float:
    """Calibration: the slope of least logistic loss on a grid."""
    grid = np.geomspace(0.05, 20, 60)
    loss = [np.logaddexp(0, np.where(y == 1, -1, 1) * np.clip(a * s + shift, -35, 35)).mean() for a in grid]
    return float(grid[int(np.argmin(loss))])


def training_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where=None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled ids (least id hashes). Null ids
    and labels other than 0 and 1 are left out. An id with both labels counts as bad;
    of several texts of one id the least is taken, so that no more than ``most`` rows
    are gathered."""
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    if where is not None:
        chosen = chosen.where(where(F.col("__id")))
    chosen = chosen.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = texts.groupBy("__id", "__y").agg(F.min("__text").alias("__text")).select("__id", "__y", F.col("__text").cast("binary").alias("__body"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = rows.mapInArrow(featurize, "id long, y int, x array<double>").toPandas().sort_values(["id", "y"])
    return (np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, **names) -> BradleyTerry:
    """Model from a bounded sample: ``most`` labelled rows at most."""
    small_batches(docs.sparkSession)
    x, y = training_sample(docs, labels, most, **names)
    return fit(x, y)


def score(docs: DataFrame, model: BradleyTerry, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a double column ``out`` in (0, 1); null text counts as empty.
    Only the text is sent to Python; a column named ``out`` is replaced. Rows are
    scored one by one, so repeated ones score alike; an empty table stays empty."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(body: pd.Series) -> pd.Series:
        x = np.array([features(b) for b in body], float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return docs.withColumn(out, of(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
