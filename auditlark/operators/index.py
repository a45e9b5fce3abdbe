"""Stored vectors with an inverted-file index: centroids of a bounded sample, and every row in the cell of its nearest one.

A version of an index is a folder with the rows, sorted by cell, and the centroids, written last; readers take the newest
version that is complete, so a build that fails leaves the one before. A search probes the cells of the centroids nearest
to a query; how many is measured by each build against the full search, which the same rows allow.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.operators import grid

#: Rows that centroids are fitted on at most, rounds of the fit, cells at most, and numbers in all centroids at most.
SAMPLE, ROUNDS, MOST_CELLS, MOST_NUMBERS = 20_000, 8, 4096, 16_000_000
#: Recall at so many neighbours that a build measures, on so many rows as queries, to say how many cells to probe.
RECALL, NEIGHBOURS, AUDITED = 0.95, 8, 500


def dense(vectors: grid.Dense | grid.Sparse, size: int) -> np.ndarray:
    if isinstance(vectors, grid.Dense):
        return vectors.rows
    out = np.zeros((len(vectors.starts) - 1, size))
    out[vectors.owner, vectors.slots] = vectors.values
    return out


def fit_centroids(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit rows; an empty cell takes the row that is worst represented. No row is a zero."""
    cells = min(cells, len(rows))
    centroids = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy() if cells else rows
    for _ in range(rounds if cells else 0):
        near = np.concatenate([rows[i : i + 4096] @ centroids.T for i in range(0, len(rows), 4096)])
        cell, score = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = np.flatnonzero(norms[:, 0] <= 1e-12)
        centroids = np.divide(sums, norms, out=centroids, where=norms > 1e-12)
        centroids[empty] = rows[np.argsort(score, kind="stable")[: len(empty)]]
    return centroids


def _probing(centroids: np.ndarray, probes: int):
    """Batches of (vector, ...) with the cells of the nearest centroids as a list in front; equally near: lower ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                vectors = grid.vectors_of(part.column(0), centroids.shape[1]).unit()
                near = np.round(dense(vectors, centroids.shape[1]) @ centroids.T, 12)
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1]), pa.int32()), pa.array(best.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([lists, *part.columns], names=["cells", *part.schema.names])

    return run


def _probed(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    rows = rows.select("vector", *(c for c in rows.columns if c != "vector"))
    schema = ", ".join(["cells array<bigint>", *(f"`{name}` {kind}" for name, kind in rows.dtypes)])
    return rows.mapInArrow(_probing(centroids, probes), schema)


@dataclass
class VectorIndex:
    """One version: its folder, the centroids, which are MOST_NUMBERS numbers at most, and the cells to probe."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> VectorIndex:
        """vectors(chunk_id, vector, ...) as a new version in folder.

        cells: the square root of the number of rows if not given. Centroids are fitted on the sample rows of the smallest
        id hashes; every row is indexed. Null vectors and zeros go to the first cell. Columns beside the two are kept.
        recall: searches probe as many cells by default as reach it on AUDITED rows.
        """
        spark, n = vectors.sparkSession, vectors.count()
        drawn = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toArrow()
        found = grid.vectors_of(drawn.column(0))
        size = max(1, found.size)
        rows = dense(found.unit(), size) if drawn.num_rows else np.zeros((0, size))
        rows = rows[np.abs(rows).sum(axis=1) > 0]
        cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, MOST_NUMBERS // size)
        centroids = fit_centroids(rows, cells) if len(rows) else np.zeros((1, size))
        path = f"{folder.rstrip('/')}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        index = cls(spark, path, centroids, len(centroids))
        index.append(vectors)
        index.probes = index.needed_probes(recall)
        columns = [pa.array(range(len(centroids)), pa.int64()), pa.array(centroids.tolist(), pa.list_(pa.float64())), pa.array([index.probes] * len(centroids), pa.int64())]
        table = pa.table(columns, names=["cell", "centroid", "probes"])
        spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/centroids")
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex | None:
        """The newest complete version, None without one."""
        top = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return None
        done = [s.getPath().toString() for s in fs.listStatus(top) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath().toString()}/centroids/_SUCCESS"))]
        if not done:
            return None
        stored = spark.read.parquet(f"{max(done)}/centroids").orderBy("cell").toArrow()
        return cls(spark, max(done), np.array(stored.column("centroid").to_pylist(), float), stored.column("probes")[0].as_py())

    def append(self, vectors: DataFrame) -> None:
        """More rows, into the cells that there are."""
        placed = _probed(vectors, self.centroids, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
        placed.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell").write.mode("append").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, apart: bool = False, among: DataFrame | None = None) -> DataFrame:
        """grid.top_k over the chunks of the probed cells of each query(query_id, vector). Probing all cells is exact.

        among(chunk_id): only these count, as when chunks were deleted after the build.
        """
        rows = self.rows() if among is None else self.rows().join(among.select("chunk_id"), "chunk_id", "left_semi")
        asked = _probed(queries.select("vector", "query_id"), self.centroids, min(probes or self.probes, len(self.centroids)))
        asked = asked.select("query_id", "vector", F.explode("cells").alias("group"))
        return grid.top_k(asked, rows.select("chunk_id", "vector", F.col("cell").alias("group")), k, grouped=True, apart=apart)

    def needed_probes(self, recall: float, k: int = NEIGHBOURS) -> int:
        """The fewest cells with this recall: of the rows that a full search finds for AUDITED others, the place of their
        cell among the query's nearest centroids is counted, one number for each cell."""
        queries = self.rows().where("vector IS NOT NULL").orderBy(F.xxhash64(F.lit("audit"), "chunk_id"), "chunk_id").limit(AUDITED).select(F.col("chunk_id").alias("query_id"), "vector")
        orders = _probed(queries, self.centroids, len(self.centroids)).select("query_id", "cells")
        best = self.exact(queries, k, apart=True).select("query_id", "chunk_id").join(orders, "query_id")
        place = best.join(self.rows().select("chunk_id", "cell"), "chunk_id").groupBy(F.array_position("cells", F.col("cell")).alias("place")).count()
        counts = np.zeros(len(self.centroids) + 1)
        for row in place.collect():
            counts[row.place] += row["count"]
        return int(np.searchsorted(np.cumsum(counts), recall * counts.sum())) if counts.sum() else 1

    def exact(self, queries: DataFrame, k: int, apart: bool = False) -> DataFrame:
        return grid.top_k(queries, self.rows(), k, apart=apart)

    def recall(self, queries: DataFrame, k: int, probes: int | None = None, apart: bool = False) -> float:
        """The share of the exact search's rows that search() finds; 1 without any."""
        best = self.exact(queries, k, apart).select("query_id", "chunk_id")
        mine = self.search(queries, k, probes, apart).select("query_id", "chunk_id", F.lit(1).alias("found"))
        row = best.join(mine, ["query_id", "chunk_id"], "left").agg(F.count("*").alias("n"), F.count("found").alias("m")).first()
        return row.m / row.n if row.n else 1.0
