"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import release
from palimpsest.llm.linear import BINS, counted, fit_logistic, ngram_bins, sigmoid, tell_apart

ORDERS = (3, 4, 5)


@dataclass(frozen=True)
class ToxicityModel:
    """Score = sigmoid(bias + sum of weight[bin] * log(1 + occurrences) over the n-gram bins of a text)."""

    weight: np.ndarray  # float64[BINS], 0 where a bin is not used
    bias: float
    orders: tuple[int, ...] = ORDERS

    def score(self, text: str | None) -> float:
        hit, value = counted(ngram_bins(text, self.orders), self.used)
        return float(sigmoid(self.bias + (self.weight[hit] * value).sum()))

    @cached_property
    def used(self) -> np.ndarray:
        return self.weight != 0


def training_sample(docs: DataFrame, labels: DataFrame, fold, per_class: int) -> DataFrame:
    """(text, y): up to per_class labelled texts of each class outside held-out rows, the first by a hash of doc_id.

    `fold` is a condition on doc_id. Null and other labels and ids are left out;
    of repeated ids in `labels` the greatest label counts.
    """
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(fold).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sampled = [
        y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)
    ]
    ids = F.broadcast(sampled[0].union(sampled[1]))
    return docs.select("doc_id", "text").join(ids, "doc_id").select("text", "y")


def train(rows: list[tuple[str | None, int]], keep: int = 4000, least_z: float = 2.0, l2: float = 3.0, orders=ORDERS) -> ToxicityModel:
    """Fit on a bounded sample: features are log counts times the log-count ratio of their bin, for the `keep` most telling bins.

    The classes weigh alike. With one class or none the score is the smoothed share of class 1.
    """
    y = np.array([int(r[1]) for r in rows], float)
    weight = np.zeros(BINS)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(weight, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0, orders)
    texts = [counted(ngram_bins(t, orders)) for t, _ in rows]
    chosen, ratio = tell_apart(texts, y, keep, least_z)
    if not len(chosen):
        return ToxicityModel(weight, 0.0, orders)
    at = np.full(BINS, -1)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for i, (bins, value) in enumerate(texts):
        k = at[bins]
        x[i, k[k >= 0]] = value[k >= 0]
    x *= ratio[chosen].astype(np.float32)
    alike = np.where(y == 1, 1 / y.sum(), 1 / (len(y) - y.sum()))
    w, b = fit_logistic(x, y, l2, weight=alike)
    weight[chosen] = w * ratio[chosen]
    return ToxicityModel(weight, b, orders)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """All columns of `docs` with `toxicity` (0 to 1) and `toxic_predicted` (0/1), from whole texts.

    Null and empty texts get the score of a text without features. One row per
    row, repeated rows alike. Columns of those names are replaced. The model is
    broadcast; its size is that of the bins.
    """
    docs = docs.drop("toxicity", "toxic_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = shared.value
        for batch in it:
            s = pa.array([m.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            flag = pa.array((s.to_numpy() >= threshold).astype("int32"), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, s, flag], [*batch.schema.names, "toxicity", "toxic_predicted"])
        release()

    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, fold=None, per_class: int = 1500) -> ToxicityModel:
    """Train on at most 2 * per_class labelled rows (a documented bound), by default on all folds."""
    sample = training_sample(docs, labels, F.lit(True) if fold is None else fold, per_class).collect()
    return train(sorted((r[0] or "", r[1]) for r in sample))
