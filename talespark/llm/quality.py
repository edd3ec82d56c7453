"""Quality classifier: regularised quadratic discriminant analysis over
transformed statistics of whole texts.

Sufficient statistics of each class (count, sums, sums of products) are added up
by Spark; each class covariance is shrunk towards the pooled one; a score is the
logistic of the difference of Gaussian log-densities, whose Mahalanobis parts use
Cholesky factors computed once on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, materialize, pick, read

NAMES = ["words", "word_len", "upper", "symbols", "bangs", "digits", "stops", "unique", "stutter", "line_dups", "line_len", "entropy", "longest"]
#: Weight of the pooled covariance in each class covariance, and the ridge on its diagonal.
SHRINKAGE, RIDGE = 0.2, 1e-3


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; null counts as empty, for which every
    ratio is 0 before its transform."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(hist[65:91].sum() + hist[97:123].sum(), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = hist[hist > 0] / size
    count = lambda chars: hist[list(chars)].sum() / size
    ratio = lambda x: float(np.log(x + 2e-3))
    return [
        float(np.log1p(n)),
        float(np.log1p((size - hist[[32, 10, 9, 13]].sum()) / max(n, 1))),
        ratio(hist[65:91].sum() / letters),
        ratio(count(b"#*$%&|<>")),
        ratio(count(b"!?")),
        ratio(hist[48:58].sum() / size),
        ratio(count(b".,;:")),
        ratio(len(set(words)) / max(n, 1)),
        ratio(sum(map(bytes.__eq__, words, words[1:])) / max(n, 1)),
        ratio(1 - len(set(lines)) / max(len(lines), 1)),
        float(np.log1p(n / max(len(lines), 1))),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        float(np.log1p(max(map(len, words), default=0))),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every document."""
    source = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})

    return source.mapInPandas(run, f"doc_id {kind}, x array<double>")


@dataclass
class Model:
    mean: list[np.ndarray]
    inverse_root: list[np.ndarray]  # inverse Cholesky factors
    log_det: list[float]
    log_prior: float
    constant: float | None = None  # the score where a class has no rows


def fit(labelled: DataFrame) -> Model:
    """Fit on all rows of (x, label); a null or other label is left out."""
    d = len(NAMES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, d + 1, d + 1))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), np.array(pdf["x"].tolist(), float).reshape(-1, d)])
            y = pdf["label"].to_numpy()
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        yield pd.DataFrame({"k": np.arange(total.size, dtype=np.int32), "v": total.ravel()})

    parts = labelled.filter(F.col("label").isin(0, 1)).select("x", "label").mapInPandas(sums, "k int, v double")
    got = parts.groupBy("k").agg(F.sum("v").alias("v")).toPandas()  # 2 (d+1)^2 rows
    s = np.zeros(2 * (d + 1) ** 2)
    s[got["k"].to_numpy(int)] = got["v"]
    s = s.reshape(2, d + 1, d + 1)
    n = s[:, 0, 0]
    if n.min() < 2:
        return Model([], [], [], 0.0, 0.5 if n.sum() == 0 else float(n[1] / n.sum()))
    mean = [s[c, 0, 1:] / n[c] for c in (0, 1)]
    cov = [s[c, 1:, 1:] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    shrunk = [(1 - SHRINKAGE) * cov[c] + SHRINKAGE * pooled + RIDGE * np.eye(d) for c in (0, 1)]
    root = [np.linalg.cholesky(m) for m in shrunk]
    return Model(mean, [np.linalg.inv(r) for r in root], [2 * float(np.log(np.diag(r)).sum()) for r in root], float(np.log(n[1] / n[0])))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of (doc_id, x)."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if model.constant is not None:
                p = np.full(len(pdf), model.constant)
            else:
                x = np.array(pdf["x"].tolist(), float).reshape(-1, len(NAMES))
                far = [(((x - m) @ r.T) ** 2).sum(1) + det for m, r, det in zip(model.mean, model.inverse_root, model.log_det)]
                p = 1 / (1 + np.exp(-np.clip((far[0] - far[1]) / 2 + model.log_prior, -500, 500)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return stats.mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (score >= 0.5).

    Learns from labelled documents outside the held-out fold. Where an id has
    several labels each counts; null labels and ids do not. Without rows of both
    classes every score is the share of label 1 (0.5 if there are no labels).
    Repeated documents are scored one by one; other columns are ignored.
    """
    stats = materialize(with_statistics(docs), "quality-statistics")
    known = pick(labels, "doc_id", "quality").toDF("doc_id", "label")
    train = stats.filter(id_fold("doc_id", fold) != held).join(known, "doc_id").select("x", "label")
    return score(stats, fit(train))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", (id_fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
