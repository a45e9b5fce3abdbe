"""Vector codes: product quantisation of integer vectors by Hamerly's bounded form of Lloyd's algorithm.

Each part of each vector keeps the entry it is assigned to, an upper bound of its distance to that entry and a lower
bound of its distance to any other one. Entries that move by so much shift the bounds by as much; only a part whose
bounds no longer tell its entry strictly is compared with all entries, in integers, so ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import dropped, returning_memory, small_batches, written

#: A component x counts as the integer floor(SCALE * x). Components of LARGEST or more can't be told by 64-bit errors.
SCALE, LARGEST = 4096, 2.0**14
#: Bounds are doubles; a difference of less than this share of them decides nothing.
SLACK = 1e-9


@dataclass
class Codebooks:
    """entries[part, entry, position]; moved[part, entry]: how far each entry went in the last update."""

    entries: np.ndarray
    moved: np.ndarray

    def apart(self) -> np.ndarray:
        """Half the distance from each entry to the nearest other one of its part."""
        parts, entries, _ = self.entries.shape
        out = np.full((parts, entries), np.inf)
        for p, book in enumerate(self.entries):
            gap = squares(book, book).astype(float)
            np.fill_diagonal(gap, np.inf)
            out[p] = np.sqrt(gap.min(axis=1)) / 2
        return out

    def farthest_others(self) -> np.ndarray:
        """For each entry, how far the others of its part have gone at most."""
        out = np.zeros_like(self.moved)
        for e in range(self.moved.shape[1]):
            out[:, e] = np.delete(self.moved, e, axis=1).max(axis=1, initial=0.0)
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries, as 64-bit integers."""
    return ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


def below(upper: np.ndarray, bound: np.ndarray) -> np.ndarray:
    return upper * (1 + SLACK) < bound * (1 - SLACK)


def reassign(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """x[row, part, position] and the state[row, part] of the last round -> state of this round, and full scans made."""
    entry, scans, apart, others = entry.copy(), 0, books.apart(), books.farthest_others()
    part = np.arange(entry.shape[1])[None, :]
    upper, lower = upper + books.moved[part, entry], lower - others[part, entry]
    bound = np.maximum(lower, apart[part, entry])
    for p in range(entry.shape[1]):
        book = books.entries[p]
        open_ = np.flatnonzero(~below(upper[:, p], bound[:, p]))
        for at in np.array_split(open_, len(open_) // 4096 + 1):
            upper[at, p] = np.sqrt(((x[at, p] - book[entry[at, p]]) ** 2).sum(axis=1))
            at = at[~below(upper[at, p], bound[at, p])]
            gap = squares(x[at, p], book)
            best, row = gap.argmin(axis=1), np.arange(len(at))  # of equal ones the first
            entry[at, p], upper[at, p] = best, np.sqrt(gap[row, best])
            if gap.shape[1] > 1:
                lower[at, p] = np.sqrt(np.partition(gap, 1, axis=1)[:, 1])
            else:
                lower[at, p] = np.inf
            scans += len(at)
    return entry, upper, lower, scans


def _tensor(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _lists(values: np.ndarray) -> pa.Array:
    rows, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * size + 1, size), pa.int32()), pa.array(values.reshape(-1)))


def _assigning(books: Codebooks, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _tensor(batch.column(2), parts)
                state = (_tensor(batch.column(i), parts)[:, :, 0] if i == 3 else batch.column(i).flatten().to_numpy().reshape(-1, parts) for i in (3, 4, 5))
                entry, upper, lower, _ = reassign(x, *state, books)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(entry.astype(np.int32)), _lists(upper), _lists(lower)], names=batch.schema.names)

    return returning_memory(run)


def _summing(parts: int, entries: int) -> Callable:
    """One row for each part and entry of a task: how many parts it has and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, entry = _tensor(batch.column(0), parts), _tensor(batch.column(1), parts)[:, :, 0]
            total = np.zeros((parts, entries, x.shape[2]), np.int64) if total is None else total
            for p in range(parts):
                np.add.at(total[p], entry[:, p], x[:, p])
                count[p] += np.bincount(entry[:, p], minlength=entries)
        if total is not None:
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), _lists(total[p, e])], names=["part", "entry", "n", "sums"])

    return returning_memory(run)


def _updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry goes to the floor of its parts' mean. Sums meet in Spark; a codebook's worth of them reaches the driver."""
    parts, entries, size = books.entries.shape
    each = state.select("x", "entry").mapInArrow(_summing(parts, entries), "part long, entry long, n long, sums array<long>")
    sums = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)))
    new = books.entries.copy()
    for row in sums.collect():
        new[row.part, row.entry] = [row[f"s{i}"] // row.n for i in range(size)]
    return Codebooks(new, np.sqrt(((new - books.entries) ** 2).sum(axis=2)))


def integer_vectors(vectors: DataFrame, parts: int = 8, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, x: rows whose vectors have only finite components, each as floor(SCALE * component).

    A component of LARGEST or more stops the run, as its error would not fit its column. Vectors without components or
    with a number of them that parts don't divide go, too.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(F.col("v").isNotNull() & ~odd & (F.size("v") > 0) & (F.size("v") % parts == 0))

    def whole(c: Column) -> Column:
        return F.when(F.abs(c) < LARGEST, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit(f"a component is {LARGEST:.0f} or more"))).cast("int")

    return kept.select("vec_id", "label", F.transform("v", whole).alias("x"))


def fit_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks] | None:
    """integer_vectors() -> the state after the last assignment, and the codebooks; None for an empty table.

    The first codebooks are the parts of the rows of the smallest ids (equal ids: the smallest vectors; null ids come
    last). All vectors must have the size of the very first; others are left out. Each round's state is a table in the
    shared folder, which replaces the one before.
    """
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    first = vectors.orderBy(*by_id).limit(1).collect()
    if not first:
        return None
    kept = vectors.where(F.size("x") == len(first[0].x))
    seeds = np.array([r.x for r in kept.orderBy(*by_id).limit(entries).collect()], np.int64).reshape(-1, parts, len(first[0].x) // parts)
    books = Codebooks(np.ascontiguousarray(seeds.transpose(1, 0, 2)), np.zeros((parts, len(seeds))))
    fill = [F.array_repeat(F.lit(v), parts).cast(f"array<{kind}>").alias(n) for n, v, kind in (("entry", 0, "int"), ("upper", float("inf"), "double"), ("lower", 0.0, "double"))]
    state = kept.select("vec_id", "label", "x", *fill)
    schema = ", ".join(f"{name} {kind}" for name, kind in state.dtypes)
    for r in range(rounds + 1):
        old, state = state, written(state.mapInArrow(_assigning(books, parts), schema), "vector-codes")
        if r:
            dropped(vectors.sparkSession, old)
        if r < rounds:
            books = _updated(state, books)
    return state, books


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept row of vectors: vec_id, code, error, label_error, codebooks_sha256.

    code has two hex digits for each part. Rows with null vectors, or with null or non-finite components, are
    dropped, as are vectors of another size than that of the smallest id. Repeated rows count each; null labels are one
    label. An empty table gives no rows. Extra columns are ignored. entries is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits tells 1 to 256 entries apart")
    small_batches(vectors.sparkSession)
    fitted = fit_codebooks(integer_vectors(vectors, parts, vec_id, vector, label), parts, entries, rounds)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    state, books = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, entry = _tensor(batch.column(2), parts), _tensor(batch.column(3), parts)[:, :, 0]
            near = books.entries[np.arange(parts)[None, :], entry]
            codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.string()), pa.array(((x - near) ** 2).sum(axis=(1, 2)))], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {dict(state.dtypes)['label']}, code string, error long"
    coded = written(state.select("vec_id", "label", "x", "entry").mapInArrow(returning_memory(run), schema), "vector-codes")
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
