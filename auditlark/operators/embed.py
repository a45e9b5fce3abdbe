"""Embedders: a protocol with a deterministic offline default, and extension points for models."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlark.functions import text as T


class Embedder(Protocol):
    """Makes a vector column of a text column: an array, or struct(size, slots, values) with ascending slots. task is
    query or passage. Stored vectors bear the embedder's name, and are taken for those of any other of that name.

    One whose literal is true knows no likeness between different words, so single words aren't compared by it.
    """

    name: str

    def vector(self, text: Column, task: str) -> Column: ...


def counted(slots: Column, size: int) -> Column:
    """An array of numbers -> the sparse vector of how often each occurs. One sort, then steps that look at neighbours."""

    def ends(s: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.element_at(s, i) != F.element_at(s, F.least(i + 1, F.size(s)))))
        return F.when(F.size(s) > 0, last).otherwise(F.array().cast("array<int>"))

    def entries(s: Column, e: Column) -> Column:
        n = F.transform(e, lambda at, j: (at - F.when(j > 0, F.element_at(e, F.greatest(j, F.lit(1)))).otherwise(0)).cast("double"))
        return F.struct(F.lit(size).cast("long").alias("size"), F.transform(e, lambda at: F.element_at(s, at)).alias("slots"), n.alias("values"))

    return T.let(F.sort_array(slots), lambda s: T.let(ends(s), lambda e: entries(s, e)))


class HashedWords:
    """Counts of hashed words as sparse vectors, built-in functions only. Different words are alike only where their
    slots collide; with as many slots as 2 ** 60 that won't happen. The time grows with a text's words, whatever the
    size. A null text has a null vector."""

    literal = True

    def __init__(self, size: int = 256):
        self.size, self.name = size, f"hashed-words-{size}"

    def vector(self, text: Column, task: str = "passage") -> Column:
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
        slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(self.size).cast("long")))
        return F.when(text.isNotNull(), counted(slots, self.size))


def sparse_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two sparse vectors; 0 where a norm is 0. Their entries are sorted together, so equal slots are neighbours."""
    a, b = T.col(a), T.col(b)
    entries = lambda v: F.zip_with(v["slots"], v["values"], lambda s, x: F.struct(s.alias("slot"), x.alias("value")))
    norm = lambda v: F.sqrt(F.aggregate(v["values"], F.lit(0.0), lambda s, x: s + x * x))
    start = F.struct(F.lit(-1).cast("long").alias("slot"), F.lit(0.0).alias("value"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x["slot"].alias("slot"), x["value"].alias("value"), (acc["sum"] + F.when(acc["slot"] == x["slot"], acc["value"] * x["value"]).otherwise(0.0)).alias("sum"))

    dot = F.aggregate(F.sort_array(F.concat(entries(a), entries(b))), start, step, lambda acc: acc["sum"])
    norms = norm(a) * norm(b)
    return F.when(norms == 0, 0.0).otherwise(dot / norms)


def zero_safe_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of doubles; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(T.col(x), T.col(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
