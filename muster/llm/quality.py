"""Document quality by a regularised quadratic discriminant.

A document becomes a vector of transformed statistics. Each class is a normal density with its own
mean and a shrunk covariance; the score is the share of the good class in the densities, from
Mahalanobis distances by Cholesky factors that are computed once for a model.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.frames import over_texts

STATISTICS = (
    "length",
    "upper",
    "symbols",
    "digits",
    "word_length",
    "distinct_words",
    "distinct_pairs",
    "stutter",
    "repeated_lines",
    "bars",
    "line_words",
    "accents",
)
_USUAL = frozenset(b" \n\t\r.,;:'\"?()-")
_SYMBOLS = np.array(
    [b < 128 and b not in _USUAL and not chr(b).isalnum() for b in range(256)], dtype=np.int64
)


def _odds(part: float, whole: float) -> float:
    """A share on the scale of log odds, kept finite by half a case on either side."""
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics_of(text: str | None) -> list[float]:
    """The statistics of a whole text; of an empty or null one as of no bytes, words or lines."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = (text or "").split()
    lines = [line for line in (text or "").split("\n") if line.strip()]
    n, w = len(data), len(words)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    return [
        math.log1p(n),
        _odds(upper, upper + lower),
        _odds(int(counts @ _SYMBOLS), n),
        _odds(int(counts[48:58].sum()), n),
        math.log((n + 1) / (w + 1)),
        math.log((len(set(words)) + 1) / (w + 1)),
        math.log((len(set(pairwise(words))) + 1) / (w + 1)),
        _odds(sum(map(operator.eq, words, islice(words, 1, None))), max(w - 1, 0)),
        _odds(len(lines) - len(set(lines)), len(lines)),
        _odds(int(counts[124]), n),
        math.log((w + 1) / (len(lines) + 1)),
        _odds(int(counts[128:].sum()), n),
    ]


def document_statistics(text: Column) -> Column:
    """The statistics of a text as an array of doubles, in the order of STATISTICS."""

    return over_texts(lambda: lambda batch: [statistics_of(v.as_py()) for v in batch], "array<double>")(text)


@dataclass(frozen=True)
class Density:
    """A class: the log of its share, its mean, and the Cholesky factor of its covariance."""

    log_share: float
    mean: np.ndarray
    factor: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Up to a constant that all classes have in common."""
        distances = np.linalg.solve(self.factor, (x - self.mean).T)
        half_log_det = np.log(np.diag(self.factor)).sum()
        return self.log_share - 0.5 * (distances**2).sum(axis=0) - half_log_det


@dataclass(frozen=True)
class QualityModel:
    """Densities of the bad and the good class; None for a class without rows."""

    bad: Density | None
    good: Density | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """How likely each row is good. With rows of one class only, everything is of that class;
        with none at all, the score is 0.5."""
        if self.bad is None or self.good is None:
            return np.full(len(x), 0.5 if self.bad is self.good else float(self.bad is None))
        gap = np.clip(self.good.log_densities(x) - self.bad.log_densities(x), -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit_quality(
    df: DataFrame, statistics: str, label: str, *, shrinkage: float = 0.1, floor: float = 1e-4
) -> QualityModel:
    """The model of all rows whose label is 0 (bad) or 1 (good); other labels are not used.

    Counts, sums and sums of products are aggregated on the executors; the driver gets one row
    for each class. A class covariance is shrunk by `shrinkage` towards the diagonal of the
    pooled one, and `floor` is added to the diagonal, so it has a Cholesky factor even where a
    statistic never varies.
    """
    p = len(STATISTICS)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    x = [F.col("x")[i] for i in range(p)]
    sums = (
        df.select(F.col(f"`{statistics}`").alias("x"), F.col(f"`{label}`").alias("label"))
        .where(F.col("label").isin(0, 1))
        .groupBy("label")
        .agg(
            F.count("*").alias("n"),
            F.array(*[F.sum(v) for v in x]).alias("sums"),
            F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("products"),
        )
        .collect()
    )
    total = sum(r["n"] for r in sums)
    means, spreads, counts = {}, {}, {}
    for r in sums:
        k, n = int(r["label"]), r["n"]
        means[k], counts[k] = np.array(r["sums"]) / n, n
        second = np.zeros((p, p))
        for (i, j), value in zip(pairs, r["products"], strict=True):
            second[i, j] = second[j, i] = value / n
        spreads[k] = second - np.outer(means[k], means[k])
    if not sums:
        return QualityModel(None, None)
    pooled = sum(spreads[k] * counts[k] for k in counts) / total
    target = np.diag(np.maximum(np.diag(pooled), 0))

    def density(k: int) -> Density | None:
        if k not in counts:
            return None
        shrunk = (1 - shrinkage) * spreads[k] + shrinkage * target + floor * np.eye(p)
        return Density(math.log(counts[k] / total), means[k], np.linalg.cholesky(shrunk))

    return QualityModel(density(0), density(1))


def quality_score(text: Column, model: QualityModel) -> Column:
    """The score of a text, 0 to 1, higher where it is likelier good; null texts as empty ones."""

    def score(batch: pa.Array) -> list[float]:
        x = np.array([statistics_of(v.as_py()) for v in batch]).reshape(-1, len(STATISTICS))
        return model.scores(x).tolist()

    return over_texts(lambda: score, "double")(text)


def learned_quality(
    documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> QualityModel:
    """The model of the documents that have labels, joined by key after their texts have become
    statistics. Null keys have no label; a document labelled twice counts twice."""
    known = labels.select(F.col(f"`{key}`").alias("label_key"), F.col(f"`{label}`").alias("label"))
    rows = documents.select(
        F.col(f"`{key}`").alias("key"), document_statistics(F.col(f"`{text}`")).alias("statistics")
    )
    return fit_quality(rows.join(known, F.col("key") == F.col("label_key")), "statistics", "label")
