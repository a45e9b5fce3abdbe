"""Near-duplicate vectors: a navigable small-world graph for each shard, which all vectors search in blocks.

Equal vectors are one class from the start. In a shard, vectors within half of the linking angle of a node are that
node's ball: any two of them are linked, and a search that reaches the node decides about all of them by its angle, or
compares them one by one where the angle can't tell. So masses of near copies cost no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import small_batches, written
from auditlark.llm.components import connected_components
from auditlark.llm.hnsw import Graph, audited_beam, unit

#: Vectors of a shard and of a block of queries; both are what one task holds. A search grows with the logarithm of the
#: shard, and their number with that of shards, so a shard is as large as a task builds in a minute or two.
SHARD_ROWS, BLOCK_ROWS = 32_768, 16_384
#: The first beam, the recall that audits ask for and the rows that one compares in full.
BEAM, RECALL, AUDITED = 32, 0.999, 256
#: Angles closer than this, in radians, are decided by the cosine itself; components compared at a time.
CLOSE, CELLS = 1e-6, 4_000_000
SHARD = "dim int, shard long, beam int, graph binary, rows long, ids binary, hashes binary, counts binary, vectors binary"
FOUND = "id long, h long, n long, to_id long, to_h long"


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of one length, in its own type of floats."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _sharded(least: float):
    theta = math.acos(least)

    def run(table: pa.Table) -> pa.Table:
        v, ids, hashes = _vectors(table.column("v")), _numbers(table, "id"), _numbers(table, "h")
        order = np.lexsort((hashes, ids))  # whatever the order of rows, one graph
        v, ids, hashes = v[order], ids[order], hashes[order]
        graph = Graph(unit(v).astype(np.float32), ids ^ hashes, math.cos(theta / 2))
        beam = audited_beam(graph, math.cos(1.5 * theta) - 1e-4, least, BEAM, RECALL, AUDITED)
        counts = _numbers(table, "m")[order].astype(np.int64)
        values = [v.shape[1], table.column("shard")[0].as_py(), beam, graph.to_bytes(), len(v), ids.tobytes(), hashes.tobytes(), counts.tobytes(), v.tobytes()]
        return pa.table([[x] for x in values], names=[x.split()[0] for x in SHARD.split(", ")]).cast(_schema(SHARD))

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches over the pairs."""
    label = np.arange(size)
    while len(a):
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def ball_links(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, counts: np.ndarray, graph: Graph, beam: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries and a shard's vectors, both of length 1 in doubles -> how many vectors each query is linked with, and pairs
    (query, node) of queries that are linked with anything in the node's ball. own: a query's own place, or -1; its ball
    needs no search."""
    theta, center = math.acos(least), graph.center
    inner = np.einsum("ij,ij->i", vectors, vectors[center])
    radius, total = np.zeros(len(vectors)), np.zeros(len(vectors), np.int64)
    np.maximum.at(radius, center, np.arccos(np.clip(inner, -1, 1)))
    np.add.at(total, center, counts)
    order = np.argsort(center, kind="stable")  # members of each ball side by side
    start = np.searchsorted(center[order], np.arange(len(vectors) + 1))
    q, c = graph.within(queries.astype(np.float32), math.cos(1.5 * theta) - 1e-4, beam)
    mine = np.flatnonzero(own >= 0)
    q, c = np.divmod(np.unique(np.concatenate((q * len(vectors) + c, mine * len(vectors) + center[own[mine]]))), len(vectors))
    cosine = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], vectors[c[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
    alone, angle = start[c + 1] - start[c] == 1, np.arccos(np.clip(cosine, -1, 1))
    whole = np.where(alone, cosine >= least, angle + radius[c] <= theta - CLOSE)
    open_ = ~alone & ~whole & (angle - radius[c] <= theta + CLOSE)
    n = np.zeros(len(queries), np.int64)
    np.add.at(n, q[whole], total[c[whole]])
    linked = whole.copy()
    at = np.flatnonzero(open_)
    size = start[c[at] + 1] - start[c[at]]
    done = np.cumsum(size)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + CELLS // vectors.shape[1], side="right")))
        k = np.repeat(at[lo:hi], size[lo:hi])
        member = order[np.repeat(start[c[at[lo:hi]]], size[lo:hi]) + np.arange(len(k)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi])]
        near = np.einsum("ij,ij->i", queries[q[k]], vectors[member]) >= least
        np.add.at(n, q[k[near]], counts[member[near]])
        linked[k[near]] = True
        lo = hi
    return n, q[linked], c[linked]


def _searched(least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _schema(FOUND).empty_table()
        v = _vectors(left.column("v"))
        shard = right.to_pylist()[0]
        vectors = unit(np.frombuffer(shard["vectors"], v.dtype).reshape(shard["rows"], -1))
        graph = Graph.from_bytes(vectors.astype(np.float32), shard["graph"])
        ids, hashes = (np.concatenate((_numbers(left, x), np.frombuffer(shard[y], np.int64))) for x, y in (("id", "ids"), ("h", "hashes")))
        place = {key: i for i, key in enumerate(zip(ids[len(v) :].tolist(), hashes[len(v) :].tolist(), strict=True))}
        own = np.array([place.get(key, -1) for key in zip(ids[: len(v)].tolist(), hashes[: len(v)].tolist(), strict=True)], np.int64)
        n, q, c = ball_links(unit(v), own, vectors, np.frombuffer(shard["counts"], np.int64), graph, shard["beam"], least)
        a, b = q, c + len(v)
        if shard["block"] == 0:  # once for each shard: its balls
            a, b = np.concatenate((a, np.arange(len(vectors)) + len(v))), np.concatenate((b, graph.center + len(v)))
        root = _local_roots(len(ids), a, b)
        extra = np.flatnonzero(root[len(v) :] != np.arange(len(vectors)) + len(v)) + len(v)
        rows = np.concatenate((np.arange(len(v)), extra))
        counted = pa.array(np.concatenate((n, np.zeros(len(extra), np.int64))), pa.int64(), mask=np.arange(len(rows)) >= len(v))
        return pa.table([ids[rows], hashes[rows], counted, ids[root[rows]], hashes[root[rows]]], schema=_schema(FOUND))

    return run


def sound(v: Column) -> Column:
    """Whether a vector can be compared: not null, not zero, all components finite."""
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda c: c != 0), F.lit(False))


def vector_dedup(vectors: DataFrame, least: float = 0.95, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other rows of a cosine of least or more, component_id is the smallest vec_id that links reach, and
    kept says that it is the row's own. Vectors that are null, zero, or hold null or non-finite components, and rows without
    vec_id, are linked with nothing; the latter are kept. Vectors of different sizes aren't linked. Repeated rows are linked
    with each other. An empty table gives no rows. Extra columns are ignored. least must be above 0.

    Shards are drawn by hash, hold shard_rows vectors on average, and are searched by every block of block_rows others. Each
    shard's beam is widened until an audit against a full comparison passes.
    """
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(kind).alias("v"))
    good = sound(F.col("v")) & F.col("vec_id").isNotNull()
    classes = rows.where(good).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    classes = written(classes.select("v", "id", F.xxhash64("v").alias("h"), "m", F.size("v").alias("dim")), "vectors")
    n = classes.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // block_rows))

    def drawn(name: str, count: int) -> Column:
        return F.pmod(F.xxhash64("id", "h", F.lit(name)), F.lit(count)).alias(name)

    graphs = classes.select("dim", drawn("shard", shards), "id", "h", "m", "v").groupBy("dim", "shard").applyInArrow(_sharded(least), SHARD)
    graphs = written(graphs, "vector-graphs")
    queries = classes.select("dim", drawn("block", blocks), "id", "h", "v").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    cells = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    keys = ("dim", "shard", "block")
    found = written(queries.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(_searched(least), FOUND), "vector-links")
    counts = found.where("n IS NOT NULL").groupBy("id", "h").agg(F.sum("n").alias("n"))
    links = found.where("id <> to_id OR h <> to_h").select(F.struct("id", "h").alias("a"), F.struct(F.col("to_id").alias("id"), F.col("to_h").alias("h")).alias("b"))
    roots = connected_components(links).select("node.id", "node.h", F.col("root.id").alias("root"))
    about = classes.join(counts, ["id", "h"]).join(roots, ["id", "h"], "left").select("v", (F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    joined = rows.where(good).join(about, "v").select("vec_id", "n_links", "component_id")
    others = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(others).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
