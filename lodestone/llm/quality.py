"""Quality classification by regularised quadratic discriminants of document statistics."""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

FEATURES = ("words", "word_length", "distinct", "most_common", "repeated_next", "upper", "symbols", "digits", "stops", "marks_in_words", "alone_marks", "short_words", "repeated_lines", "words_a_line", "sentence_length")
#: Shares of the pooled covariance and of its diagonal in each class's covariance.
POOLED, DIAGONAL = 0.3, 0.1
THRESHOLD = 0.3
#: Labelled rows that the model is fitted on at most, those of the least hash of their id.
FIT_ROWS = 50_000
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
_STOP = np.array([chr(i) in ".,;:?'\"-" for i in range(256)])
_BLANK = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; a null text counts as empty.

    Counts go by logarithm, shares by logit with one half added to both sides,
    so that each is near normal and of bounded influence.
    """
    text = text or ""
    words = text.split()
    n = len(words)
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    solid = max(1, int(octets[~_BLANK].sum()))
    lines = [x for x in text.split("\n") if x]

    def logit(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (whole - part + 0.5)))

    if not n:
        return [0.0] * len(FEATURES)
    counted = Counter(words)
    inner = sum(not w[:-1].isalnum() for w in words if len(w) > 1)
    stops = int(octets[ord(".")])
    return [
        float(np.log1p(n)),
        float(np.log(solid / n)),
        float(np.log(len(counted)) / np.log(n + 1)),
        logit(max(counted.values()), n),
        logit(sum(map(operator.eq, words, words[1:])), n),
        logit(int(octets[_UPPER].sum()), solid),
        logit(int(octets[_MARK & ~_STOP].sum()), solid),
        logit(int(octets[_DIGIT].sum()), solid),
        logit(int(octets[_STOP].sum()), solid),
        logit(inner, n),
        logit(sum(len(w) == 1 and not w.isalnum() for w in words), n),
        logit(sum(len(w) < 4 for w in words), n),
        logit(len(lines) - len(set(lines)), len(lines)),
        float(np.log(n / max(1, len(lines)))),
        float(np.log(n / (stops + 1))),
    ]


@dataclass
class Discriminant:
    """Class densities with cached Cholesky factors; None for a class without rows."""

    log_prior: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]  # inverse of the Cholesky factor
    log_root: list[float]

    @classmethod
    def from_moments(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
        """n, sums and squares: count, sum and sum of outer products of each class."""
        d = sums.shape[1]
        means = [sums[k] / n[k] for k in (0, 1)]
        within = [squares[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        common = (n[0] * within[0] + n[1] * within[1]) / n.sum()
        ridge = np.diag(np.diag(common) + 1e-3)
        model = cls([], means, [], [])
        for k in (0, 1):
            shrunk = (1 - pooled - diagonal) * within[k] + pooled * common + diagonal * ridge + 1e-6 * np.eye(d)
            low = np.linalg.cholesky(shrunk)
            model.factor.append(np.linalg.inv(low))
            model.log_root.append(float(np.log(np.diag(low)).sum()))
            model.log_prior.append(float(np.log(n[k] / n.sum())))
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x: the Mahalanobis log-density difference, as a logistic."""
        log = [self.log_prior[k] - self.log_root[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Discriminant | float:
    """The model of at most fit_rows rows of labels and their documents; labels other than 0 and 1 don't count.

    Which labels these are depends on their ids alone, through a hash, so the
    sample is the same whatever else the table holds in what order. A document
    with several labels counts once for each. With only one class, or none,
    the result is a constant score: (n1 + 1) / (n0 + n1 + 2).
    """
    d = len(FEATURES)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(x) for x in texts])

    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("labelled_id"), F.col(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("labelled_id"), "labelled_id", "y").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("measured_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), F.col("measured_id") == F.col("labelled_id"))
    paired = rows.select("y", measure("text").alias("x"))

    def moments(batches):
        held = np.zeros((2, 1 + d + d * d))
        for part in batches:
            x, y = np.array(part["x"].tolist(), float).reshape(-1, d), part["y"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                held[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"y": np.repeat([0, 1], held.shape[1]), "i": np.tile(np.arange(held.shape[1]), 2), "v": held.ravel()})

    total = np.zeros((2, 1 + d + d * d))
    for y, i, v in paired.mapInPandas(moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v")).collect():
        total[y, i] = v
    n = total[:, 0]
    if min(n) < 2:
        return float((n[1] + 1) / (n.sum() + 2))
    return Discriminant.from_moments(n, total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d))


def quality_score(text: Column, model: Discriminant | float) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if isinstance(model, float) or not len(texts):
            return pd.Series([model] * len(texts), dtype="float64")
        return pd.Series(model.score(np.array([statistics(x) for x in texts])))

    return score(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted; labels of held-out rows are not learnt from.

    Every row gets a score, null and empty texts too. Repeated rows stay and
    get equal scores; an empty table gives an empty result. Columns of docs
    named held_out, score or predicted are replaced.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", quality_score(F.col("text"), model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns; the model is that of score_quality."""
    return docs.where(quality_score(F.col("text"), fit(docs, labels.where(~held_out(F.col("doc_id"))))) >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
