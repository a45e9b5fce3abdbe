"""Quality: ordinal cumulative-link regression on graded ratings over shared hashed-text weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import documents_of, returning_memory
from auditlark.llm.features import gram_features, held_out, labelled_sample, shape_features, text_words

#: The sample of labelled rows that a fit takes at most, and hashed weights as powers of two: of words, behind those
#: of a text's form. A form counts fully; words share one weight, so that long texts don't drown it.
MOST_ROWS, BITS, FORM_BITS = 12_000, 18, 12


def grade() -> Column:
    """Grades of a label row: 0 for low quality, 1 for good but toxic text, 2 for good clean text."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


@dataclass
class OrdinalModel:
    """P(grade > k) = logistic(w.x - cuts[k]), one w for all k, cuts ascending."""

    bits: int
    weights: np.ndarray
    cuts: np.ndarray


def features(words, data, offsets, bits: int = BITS):
    row, index = gram_features(words, bits, skips=False)[0]
    return [*shape_features(words, data, offsets, FORM_BITS), (row, index + (1 << FORM_BITS))]


def values(index: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a feature counts for in a text of so many distinct words."""
    return np.where(index < 1 << FORM_BITS, 1.0, 1 / np.sqrt(np.maximum(1, words)))


def ordinal_fit(rows: list[tuple[int, np.ndarray]], bits: int = BITS, grades: int = 3, rate: float = 0.3, decay: float = 1e-5, epochs: int = 4) -> OrdinalModel:
    """AdaGrad on the sum of the grades-1 binary losses; cuts stay in order by sorting."""
    size = (1 << bits) + (1 << FORM_BITS)
    w, seen = np.zeros(size), np.full(size, 1e-6)
    counts = np.array([max(0.5, sum(g > k for g, _ in rows)) / max(1, len(rows)) for k in range(grades - 1)])
    cuts = np.sort(-np.log(np.clip(counts, 1e-3, 1 - 1e-3) / (1 - np.clip(counts, 1e-3, 1 - 1e-3))))
    for epoch in range(epochs):
        for g, x in rows:
            scale = values(x, np.count_nonzero(x >= 1 << FORM_BITS))
            tail = 1 / (1 + np.exp(-np.clip(w[x] @ scale - cuts, -30, 30)))
            miss = tail - (g > np.arange(grades - 1))
            step = miss.sum() * scale
            seen[x] += step * step
            w[x] -= rate * (step + decay * w[x]) / np.sqrt(seen[x])
            cuts = np.sort(cuts + 0.02 / (1 + epoch) * miss)
    return OrdinalModel(bits, w, cuts)


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, bits: int = BITS) -> OrdinalModel:
    return ordinal_fit(labelled_sample(docs, labels, grade(), most_rows, lambda w, d, o: features(w, d, o, bits)), bits)


def score_quality(docs: DataFrame, model: OrdinalModel, least_grade: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, expected_grade (0 to 2), tail_probability (grade 2), selected.

    selected: an expected grade of at least least_grade. The whole text is scored; a null or empty text has its
    form's features alone. Without labels every text has the grades' prior. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, model.weights.astype(np.float32), model.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, weights, cuts = shared.value
        for batch in batches:
            for lo, hi, data, offsets, words in text_words(batch.column(1)):
                row, index = (np.concatenate(x) for x in zip(*features(words, data, offsets, bits), strict=True))
                both = np.unique(row << 32 | index)
                rows, index = both >> 32, both & 0xFFFFFFFF
                distinct = np.bincount(rows, index >= 1 << FORM_BITS, minlength=hi - lo)
                total = np.bincount(rows, weights[index] * values(index, distinct[rows]), minlength=hi - lo)
                tails = 1 / (1 + np.exp(-np.clip(total[:, None] - cuts, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(tails.sum(axis=1)), pa.array(np.ascontiguousarray(tails[:, -1]))], names=["doc_id", "expected_grade", "tail_probability"])

    scored = documents_of(docs, doc_id, text).mapInArrow(returning_memory(run), "doc_id long, expected_grade double, tail_probability double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("expected_grade") >= least_grade).alias("selected"))
