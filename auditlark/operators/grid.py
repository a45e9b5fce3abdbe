"""Searches as a grid of cells: blocks of queries times slabs of chunks.

Both sides are dealt into parts of bounded size by hash. Each query is sent to every slab and each chunk to every block,
by an equi-join on (group, block, slab), so one task holds one cell and nothing passes through the driver. A cell keeps
the best of its chunks for each query; what the cells keep meets by query.

Vectors are arrays of numbers, or sparse: struct(size, slots, values), slots ascending and distinct.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlark.operators import store

#: Rows of a block and of a slab, and bytes of their vectors; what is less decides. A worker holds one of each.
QUERY_ROWS, CHUNK_ROWS, PART_BYTES = 4096, 8192, 16_000_000
#: Similarities and products of sparse vectors that a cell holds at a time, each in some ten arrays of 8 bytes.
SIMILARITIES, PRODUCTS = 1_000_000, 500_000
SPARSE = "struct<size:bigint,slots:array<bigint>,values:array<double>>"


class Dense:
    """Rows as a matrix; null ones and those of another size than the given one are zeros."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, size: int | None = None):
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.list_(pa.float64()))
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        self.size = int(lengths.max(initial=0)) if size is None else size
        right = lengths == self.size
        self.rows = np.zeros((len(column), self.size))
        if self.size:
            self.rows[right] = pc.fill_null(pc.list_flatten(column.filter(pa.array(right))), 0.0).to_numpy(zero_copy_only=False).reshape(-1, self.size)

    def unit(self) -> Dense:
        norms = np.linalg.norm(self.rows, axis=1, keepdims=True)
        np.divide(self.rows, norms, out=self.rows, where=norms > 0)
        return self

    def products(self, queries: Dense, lo: int, hi: int) -> np.ndarray:
        return queries.rows @ self.rows[lo:hi].T


class Sparse:
    """Rows as ranges of slots and values; a null row is empty."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes, slots, values = column.flatten()  # null where the row is
        lengths = pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.slots = pc.list_flatten(slots).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        self.values = pc.list_flatten(values).to_numpy(zero_copy_only=False).astype(float, copy=False)
        self.owner = np.repeat(np.arange(len(column)), lengths)
        self.size = int(pc.max(sizes).as_py() or 0)
        self._lists: tuple | None = None

    def unit(self) -> Sparse:
        norms = np.sqrt(np.bincount(self.owner, self.values**2, len(self.starts) - 1))
        self.values = np.divide(self.values, norms[self.owner], out=np.zeros_like(self.values), where=norms[self.owner] > 0)
        return self

    def lists(self) -> tuple:
        """Distinct slots, and for each where its rows and values begin."""
        if self._lists is None:
            order = np.argsort(self.slots, kind="stable")
            known, first = np.unique(self.slots[order], return_index=True)
            self._lists = known, np.append(first, len(order)), self.owner[order], self.values[order]
        return self._lists

    def products(self, queries: Sparse, lo: int, hi: int) -> np.ndarray:
        known, first, owner, weight = queries.lists()
        width, out = hi - lo, np.zeros((len(queries.starts) - 1) * (hi - lo))
        if len(known):
            mine = slice(self.starts[lo], self.starts[hi])
            at = np.minimum(np.searchsorted(known, self.slots[mine]), len(known) - 1)
            hit = np.flatnonzero(known[at] == self.slots[mine])
            at, chunk, value = at[hit], self.owner[mine][hit] - lo, self.values[mine][hit]
            count = first[at + 1] - first[at]
            done, i = np.cumsum(count), 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PRODUCTS, side="right")))
                n = count[i:j]
                k = np.repeat(first[at[i:j]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out += np.bincount(owner[k] * width + np.repeat(chunk[i:j], n), weight[k] * np.repeat(value[i:j], n), len(out))
                i = j
        return out.reshape(-1, width)


def vectors_of(column: pa.ChunkedArray | pa.Array, size: int | None = None) -> Dense | Sparse:
    return Sparse(column) if pa.types.is_struct(column.type) else Dense(column, size)


class Best:
    """The k best chunks so far of each query of a block, by cosine and then by id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score, self.name = np.full((len(ids), k), -2.0), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, sims: np.ndarray, names: np.ndarray) -> None:
        """sims: a row for each query, a column for each of names; -2 is out."""
        near = np.round(sims, 12)
        if near.shape[1] > 4 * self.k:
            # nothing below a query's k-th best of these can stay; of equal ones the ids decide, so all are looked at
            edge = -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1]
            keep = near >= np.maximum(edge, np.round(self.score[:, -1], 12))[:, None]
            most = int(keep.sum(axis=1).max(initial=0))
            if not most:
                return
            at = np.argsort(~keep, axis=1, kind="stable")[:, :most]
            chosen = np.take_along_axis(keep, at, 1)
            sims, names = np.where(chosen, np.take_along_axis(sims, at, 1), -2.0), np.where(chosen, names[at], np.iinfo(np.int64).max)
        else:
            names = np.broadcast_to(names, sims.shape)
        score, name = np.concatenate((self.score, sims), axis=1), np.concatenate((self.name, names), axis=1)
        order = np.lexsort((name, -np.round(score, 12)), axis=1)[:, : self.k]
        self.score, self.name = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)

    def table(self) -> pa.Table:
        keep = self.score > -2
        owner = np.broadcast_to(self.ids[:, None], keep.shape)
        return pa.table([pa.array(owner[keep]), pa.array(self.name[keep]), pa.array(self.score[keep])], names=["query_id", "chunk_id", "cosine"])


FOUND, SCORED = "query_id long, chunk_id long, cosine double", "query_id long, score double"
EMPTY = {FOUND: pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("cosine", pa.float64())]).empty_table(), SCORED: pa.schema([("query_id", pa.int64()), ("score", pa.float64())]).empty_table()}


def _cell(measure: Callable, schema: str):
    """measure(query ids, chunk ids, queries, chunks, slices) for cells with rows on both sides."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return EMPTY[schema]
        queries = vectors_of(left.column("vector"))
        chunks = vectors_of(right.column("vector"), getattr(queries, "size", None))
        ids, names = (t.column(n).to_numpy().astype(np.int64) for t, n in ((left, "query_id"), (right, "chunk_id")))
        step = max(1, SIMILARITIES // len(ids))
        return measure(ids, names, queries, chunks, [(lo, min(len(names), lo + step)) for lo in range(0, len(names), step)])

    return run


def _nearest(k: int, apart: bool):
    def measure(ids, names, queries, chunks, slices) -> pa.Table:
        best, queries, chunks = Best(ids, k), queries.unit(), chunks.unit()
        for lo, hi in slices:
            sims = chunks.products(queries, lo, hi)
            if apart:
                sims[ids[:, None] == names[None, lo:hi]] = -2
            best.add(sims, names[lo:hi])
        return best.table()

    return _cell(measure, FOUND)


def _highest(apart: bool):
    def measure(ids, names, queries, chunks, slices) -> pa.Table:
        best = np.zeros(len(ids))
        for lo, hi in slices:
            sums = chunks.products(queries, lo, hi)
            if apart:
                sums[ids[:, None] == names[None, lo:hi]] = 0
            np.maximum(best, sums.max(axis=1), out=best)
        kept = best > 0
        return pa.table([pa.array(ids[kept]), pa.array(best[kept])], names=["query_id", "score"])

    return _cell(measure, SCORED)


def cells(queries: DataFrame, chunks: DataFrame, run: Callable, schema: str, grouped: bool = False, query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """queries(query_id, vector[, group]) x chunks(chunk_id, vector[, group]), cell by cell.

    The plan is the same whatever the number of rows. Either side's rows and bytes are counted first; with groups, each
    group's are, and a large one gets more parts than others. Groups without rows on both sides make no cells.
    """
    key = F.col("group") if grouped else F.lit(0)
    q, c = queries.select("query_id", "vector", key.alias("group")), chunks.select("chunk_id", "vector", key.alias("group"))

    def parts(rows: DataFrame, most: int, name: str):
        sparse = rows.schema["vector"].dataType.typeName() == "struct"
        size = 16 * F.size("vector.slots") if sparse else 8 * F.size("vector")
        n = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)) / PART_BYTES)).cast("long").alias(name)
        if not grouped:
            return F.lit(max(1, rows.agg(n).first()[0])), None
        return F.col(name), rows.groupBy("group").agg(n)

    blocks, of_q = parts(q, query_rows, "blocks")
    slabs, of_c = parts(c, chunk_rows, "slabs")
    if grouped:
        sizes = of_q.withColumnRenamed("group", "g").join(of_c, F.col("g").eqNullSafe(F.col("group"))).select("g", "blocks", "slabs")
        q, c = (x.join(sizes, F.col("group").eqNullSafe(F.col("g"))).drop("g") for x in (q, c))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), n)
    # the added 0 comes from the row, else the planner would write the whole sequence into the plan
    each = lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1 + F.pmod(F.xxhash64(name), F.lit(1))))
    own = lambda name: F.col(name).alias(name)  # noqa: E731  both sides may come from one frame
    q = q.select(own("group"), dealt("query_id", blocks).alias("block"), each("query_id", slabs).alias("slab"), own("query_id"), own("vector"))
    c = c.select(own("group"), each("chunk_id", blocks).alias("block"), dealt("chunk_id", slabs).alias("slab"), own("chunk_id"), own("vector"))
    keys = ("group", "block", "slab")
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(run, schema)


def top_k(queries: DataFrame, chunks: DataFrame, k: int, grouped: bool = False, apart: bool = False, query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, chunk_id, cosine, rank): the k nearest chunks of each query by cosine, ties by chunk_id.

    grouped: only chunks of the same group. apart: a query's own id is no neighbour. Vectors that are null, of norm 0, or
    of another length than the block's queries have cosine 0. k rows for each query and slab are shuffled.
    """
    found = cells(queries, chunks, _nearest(k, apart), FOUND, grouped, query_rows, chunk_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def highest_product(queries: DataFrame, chunks: DataFrame, apart: bool = False, query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """queries(query_id, terms, weights) x chunks(chunk_id, terms, weights) -> (query_id, score).

    The highest sum of products of weights over shared terms that any chunk has with the query; 0 without one. Terms are
    distinct within a row and meet by their 64-bit hashes. apart: a query's own id doesn't count. Either side is made
    once, as Parquet, before it is counted and dealt.
    """

    def hashed(rows: DataFrame, name: str) -> DataFrame:
        terms = F.transform("terms", lambda t: F.xxhash64(t))
        made = rows.select(name, F.struct(F.lit(0).cast("long").alias("size"), terms.alias("slots"), F.col("weights").cast("array<double>").alias("values")).alias("vector"))
        made.write.parquet(folder := store.scratch(rows.sparkSession, "terms"))
        return rows.sparkSession.read.schema(made.schema).parquet(folder)

    asked = queries.where("size(terms) > 0")
    best = cells(hashed(asked, "query_id"), hashed(chunks, "chunk_id"), _highest(apart), SCORED, False, query_rows, chunk_rows)
    best = best.groupBy("query_id").agg(F.max("score").alias("score"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("score"))
