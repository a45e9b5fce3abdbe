"""Token-id files with bit-plane shuffling.

A shard is one file: a magic word; blocks of ``block`` ids, each stored as planes (byte planes or bit planes of
its little-endian 32-bit ids), every plane compressed with zstandard by itself; then a zstandard-compressed footer
with the chunk index (where each block begins, its ids and plane sizes) and the documents (id, ids before it in
the shard, ids of it); then the footer's place and size, and the magic word again. All integers are little-endian.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import documents_of, new_path, returning_memory, written
from auditlark.llm.encoders import encoder

MAGIC = b"ALTPLN01"
#: Documents that a reader hands on at a time.
READ_ROWS = 8192


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of uint32 ids; a plane of zeros compresses to almost nothing."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        return np.stack([np.frombuffer(p, np.uint8, n) for p in parts], axis=1).copy().view("<u4").ravel() if n else np.zeros(0, "<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").copy().view("<u4").ravel() if n else np.zeros(0, "<u4")


class ShardWriter:
    """Streams ids into a shard; holds one block and the documents' sizes."""

    def __init__(self, out, block: int = 1 << 16, planes: str = "byte", level: int = 3):
        self.out, self.block, self.planes = out, block, planes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.at = len(MAGIC)
        self.chunks: list[list] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents in turn: their ids, one behind the other, and how many each has."""
        self.docs += doc_ids
        self.sizes += sizes.tolist()
        self.total += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            everything = np.concatenate(self.held)
            full = len(everything) // self.block * self.block
            for k in range(0, full, self.block):
                self._flush(everything[k : k + self.block])
            self.held, self.waiting = [everything[full:].copy()], len(everything) - full

    def _flush(self, ids: np.ndarray) -> None:
        parts = [self.packer.compress(p) for p in to_planes(ids, self.planes)]
        self.chunks.append([self.at, len(ids), [len(p) for p in parts]])
        for p in parts:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.waiting:
            self._flush(np.concatenate(self.held))
        footer = {"planes": self.planes, "block": self.block, "ids": self.total, "chunks": self.chunks, "docs": self.docs, "sizes": self.sizes}
        packed = self.packer.compress(json.dumps(footer, separators=(",", ":")).encode())
        self.out.write(packed + struct.pack("<QQ", self.at, len(packed)) + MAGIC)


class ShardReader:
    """Reads a shard by its chunk index, one block at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        end = self._read(size - 24, 24)
        if end[16:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        at, length = struct.unpack("<QQ", end[:16])
        self.unpacker = zstandard.ZstdDecompressor()
        self.about = json.loads(self.unpacker.decompress(self._read(at, length)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.about["chunks"][k]
        raw, cuts = self._read(at, sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))
        return from_planes([self.unpacker.decompress(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], n, self.about["planes"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, its ids)."""
        held, k, start = np.zeros(0, "<u4"), 0, 0
        for doc_id, size in zip(self.about["docs"], self.about["sizes"], strict=True):
            if len(held) < size:
                got, parts = len(held), [held]
                while got < size:
                    parts.append(self.block(k))
                    got += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield doc_id, start, held[:size]
            held, start = held[size:], start + size


def _write(folder: str, file: str, end_id: int, block: int, planes: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        # every attempt has a name of its own; the manifest names the one that counts
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.planes"
        own = encoder(file)
        with store.open_output_stream(f"{top}/{name}") as out:
            writer = ShardWriter(out, block, planes)
            for batch in batches:
                doc_ids, at = batch.column(0).to_pylist(), 0
                for ids, sizes in own.ids(batch.column(1)):
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    writer.add(doc_ids[at : at + len(sizes)], ids, sizes + 1)
                    at += len(sizes)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([writer.total], pa.int64()), pa.array([len(writer.docs)], pa.int64())], names=["shard", "name", "n_ids", "n_docs"])

    return returning_memory(run)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{name}") as source:
                    found = ((d, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in ShardReader(source).documents())
                    while rows := list(islice(found, READ_ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return returning_memory(run)


def write_token_files(
    docs: DataFrame, folder: str | None = None, file: str = "byte_bpe_50k.json", end_id: int = 0, shards: int | None = None, block: int = 1 << 16, planes: str = "byte",
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending doc_id order (null first; equal ids by text hash).

    Returns the manifest: folder, shard, name, n_ids, n_docs, before (ids of all shards before it). A null or empty
    text is the end id alone. Tables without rows give shards without documents, or none. Extra columns are ignored.
    A shard has one task's range of doc_ids; files of lost attempts stay unnamed by the manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that share an id are dealt by their texts too, so that they need not meet in one task
    order = ["doc_id", F.xxhash64("text")]
    ordered = documents_of(docs, doc_id, text).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    manifest = written(ordered.mapInArrow(_write(folder, file, end_id, block, planes), "shard int, name string, n_ids long, n_docs long"), "token-manifest")
    # one row for each shard: as many as tasks wrote
    rows, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((folder, r.shard, r.name, r.n_ids, r.n_docs, before))
        before += r.n_ids
    return spark.createDataFrame(rows, "folder string, shard int, name string, n_ids long, n_docs long, before long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    folders = [r.folder for r in manifest.select("folder").distinct().collect()]
    out = None
    for folder in folders:
        own = manifest.where(F.col("folder") == folder)
        part = own.repartition(max(1, own.count()), "shard").select("name", "before").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else manifest.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
