"""Toxicity: FTRL-proximal logistic regression over hashed word unigrams, bigrams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlark.llm.common import returning_memory, small_batches
from auditlark.llm.features import Lookup, gram_features, held_out, labelled_sample, linear_sums, text_words

#: The sample of labelled rows that a fit takes at most.
MOST_ROWS = 12_000


@dataclass
class SparseModel:
    """Compact weights: only the coordinates that L1 left."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def lookup(self) -> Lookup:
        return Lookup(self.bits, self.index, self.weight)


def ftrl_fit(rows: list[tuple[int, np.ndarray]], bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, epochs: int = 3) -> SparseModel:
    """FTRL-proximal: each coordinate has its own rate; a coordinate with |z| <= l1 is exactly 0."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    positive = sum(label > 0 for label, _ in rows)
    bias = math.log((positive + 0.5) / (len(rows) - positive + 1.5))
    bias_n = 0.0
    for _ in range(epochs):
        for label, x in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - (label > 0)
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(n[x]) - root) / alpha * w
            bias_n += g * g
            bias -= g * 0.1 / (1 + math.sqrt(bias_n))
    kept = np.flatnonzero(np.abs(z) > l1)
    weight = (np.sign(z[kept]) * l1 - z[kept]) / ((beta + np.sqrt(n[kept])) / alpha + l2)
    return SparseModel(bits, bias, kept, weight)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bits: int = 22, most_rows: int = MOST_ROWS, **ftrl) -> SparseModel:
    rows = labelled_sample(docs, labels, F.col("toxic"), most_rows, lambda words, data, offsets: gram_features(words, bits))
    return ftrl_fit(rows, bits, **ftrl)


def _scored(docs: DataFrame, kept, kind: T.DataType, text: str, model: SparseModel) -> DataFrame:
    """(kept, score) of each row; no row is joined to any other."""
    small_batches(docs.sparkSession)
    parts = docs.sparkSession.sparkContext.broadcast((model.bits, model.bias, model.index, model.weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, bias, index, weight = parts.value
        weights = SparseModel(bits, bias, index, weight).lookup()
        for batch in batches:
            for lo, hi, _, _, words in text_words(batch.column(1)):
                total = bias + linear_sums(weights, gram_features(words, bits), hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["kept", "score"])

    rows = docs.select(kept.alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(returning_memory(run), T.StructType([T.StructField("kept", kind), T.StructField("score", T.DoubleType())]))


def score_toxicity(docs: DataFrame, model: SparseModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if the score is 0.5 or more).

    The whole text is scored. A null or empty text, or one without words, gets the score of the bias. Without
    labels to learn from, or without toxic ones, every score is below 0.5. Extra columns are ignored.
    """
    scored = _scored(docs, F.col(f"`{doc_id}`").cast("long"), T.LongType(), text, model).withColumnRenamed("kept", "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: SparseModel, text: str = "text") -> DataFrame:
    """The rows of docs whose text isn't predicted to be toxic, with all their columns, whatever those are called.

    Each row is judged by its own text alone, so null and repeated ids and repeated rows need no care.
    """
    return _scored(docs, F.struct("*"), docs.schema, text, model).where("score < 0.5").select("kept.*")
