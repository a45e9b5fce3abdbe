"""Hashed text features for the linear classifiers, computed for many documents at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import documents_of, returning_memory, written
from auditlark.llm.kernels import U, Words, mixed, non_alphanumeric_bytes, slices, words_of


def held_out(doc_id, parts: int = 5):
    """A fifth of the ids, by the crc32 of their decimal text; never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == 0


def is_held_out(doc_id: int, parts: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % parts == 0


def gram_features(words: Words, bits: int, skips: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, index) arrays for word unigrams, bigrams and, with skips, pairs with one word between."""
    n = np.diff(words.first)
    row = np.repeat(np.arange(len(n)), n)
    shift = U(64 - bits)
    out = [(row, (mixed(words.hash ^ U(0xA5A5A5A5)) >> shift).astype(np.int64))]
    for gap in (1, 2) if skips else (1,):
        if len(row) > gap:
            same = row[gap:] == row[:-gap]
            pair = mixed(words.hash[:-gap] * U(0x9E3779B97F4A7C15) + words.hash[gap:] * U(0xC2B2AE3D27D4EB4F) + U(gap))
            out.append((row[gap:][same], (pair[same] >> shift).astype(np.int64)))
    return out


def shape_features(words: Words, data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, index) for hashed buckets of a text's form: length, repetition, word and line lengths, odd bytes."""
    docs = np.arange(len(offsets) - 1)
    n = np.diff(words.first)
    size = np.maximum(np.diff(offsets), 1)

    def share(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    distinct, most = np.zeros(len(n)), np.zeros(len(n))
    for i in np.flatnonzero(n):
        counts = np.unique(words.hash[words.first[i] : words.first[i + 1]], return_counts=True)[1]
        distinct[i], most[i] = len(counts) / n[i], counts.max() / n[i]
    letters = np.concatenate(([0], np.cumsum(words.end - words.start)))
    mean = (letters[words.first[1:]] - letters[words.first[:-1]]) / np.maximum(n, 1)
    low = data | 32
    letter = (low >= 97) & (low <= 122) | (data >= 128)
    odd = 1 - share(letter | (data == 32) | (data == 10) | (data == 46) | (data == 44))
    columns = [
        np.log2(n + 1).astype(np.int64), (distinct * 20).astype(np.int64), np.minimum(most * 40, 20).astype(np.int64), np.minimum(mean * 2, 40).astype(np.int64),
        np.minimum(odd * 40, 20).astype(np.int64), np.minimum(share(data == 10) * 200, 20).astype(np.int64), np.minimum(share((data >= 48) & (data <= 57)) * 40, 20).astype(np.int64),
        np.minimum(share((data >= 65) & (data <= 90)) * 40, 20).astype(np.int64),
    ]
    return [(docs, (mixed((U(k + 1) << U(32)) + c.astype(U)) >> U(64 - bits)).astype(np.int64)) for k, c in enumerate(columns)]


def text_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    parting = non_alphanumeric_bytes()
    for lo, hi, data, offsets in slices(column):
        yield lo, hi, data, offsets, words_of(data, offsets, parting)


def labelled_sample(docs: DataFrame, labels: DataFrame, label, most_rows: int, features, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, np.ndarray]]:
    """At most most_rows (label, distinct feature indices) of labelled documents that aren't held out.

    The sample takes the smallest hashes of the ids. Its ids (most_rows at most) are broadcast, so the texts stay
    where they are read; features are made on executors and only they come to the driver. Rows with null in id or
    label are left out; of several labels of one id the largest counts.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).where("doc_id is not null and label is not null")
    named = named.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = documents_of(docs, doc_id, text).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets, words in text_words(batch.column(1)):
                pairs = features(words, data, offsets)
                row, index = (np.concatenate(x) for x in zip(*pairs, strict=True))
                both = np.unique(row << 32 | index)
                cuts = np.searchsorted(both >> 32, np.arange(hi - lo + 1))
                packed = [(both[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF).astype(np.uint32).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["doc_id", "label", "features"])

    found = written(rows.mapInArrow(returning_memory(run), "doc_id long, label int, features binary"), "labelled")
    # on the driver all features lie in one array of 32-bit indices; the rows are views of it
    size = found.agg(F.sum(F.octet_length("features"))).first()[0] or 0
    flat, about, used = np.empty(size // 4, np.uint32), [], 0
    for r in found.toLocalIterator():
        own = np.frombuffer(r.features, np.uint32)
        flat[used : used + len(own)] = own
        about.append((zlib.crc32(str(r.doc_id).encode()), r.doc_id, used, len(own), r.label))
        used += len(own)
    return [(label, flat[at : at + n]) for _, _, at, n, label in sorted(about)]


class Lookup:
    """Weights of few of many coordinates: a mark for each coordinate, and the weights of those marked."""

    def __init__(self, bits: int, index: np.ndarray, weight: np.ndarray):
        """index is sorted."""
        self.marked, self.index, self.weight = np.zeros(1 << bits, bool), index, weight
        self.marked[index] = True

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        return self.weight[np.searchsorted(self.index, index)]


def linear_sums(weights: Lookup, pairs: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Per row, the sum of the weights of its distinct features."""
    held = [(row[hit], index[hit]) for row, index in pairs for hit in [weights.marked[index]]]
    both = np.unique(np.concatenate([row << 32 | index for row, index in held])) if held else np.zeros(0, np.int64)
    return np.bincount(both >> 32, weights[both & 0xFFFFFFFF], minlength=rows)[:rows]
