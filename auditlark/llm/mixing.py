"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is due target/source_size copies. The whole part is given to each; the fractional part
is an inclusion probability. The flight phase moves probabilities along the null space of two constraints, the
number of documents and their words, until they are 0 or 1. It runs in buckets of a source, whose few undecided
units meet in larger buckets, level by level, until each source has one bucket and its landing decides the last two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import returning_memory, written
from auditlark.llm.kernels import blank_bytes, slices, words_of

#: Units that one flight takes, and sources that are planned on the driver, at most.
BUCKET, MOST_SOURCES = 16_384, 1_000_000


def targets_of(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> dict[str | None, float]:
    """Sources by code point, null last, weigh the repeating weights and share all words; no target exceeds most
    times its source's size, and the excess is shared by weight among the others until none is above."""
    order = sorted((s for s in sizes if s[0] is not None), key=lambda s: s[0].encode("utf-32-be")) + [s for s in sizes if s[0] is None]
    weigh = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    rest, still = float(sum(size.values())), [s for s, _ in order]
    while still:
        whole = sum(weigh[s] for s in still)
        above = [s for s in still if rest * weigh[s] / whole > most * size[s]]
        if not above:
            out |= {s: rest * weigh[s] / whole for s in still}
            break
        for s in above:
            out[s] = most * float(size[s])
        rest -= sum(out[s] for s in above)
        still = [s for s in still if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, draw: Iterator[float]) -> np.ndarray:
    """Moves p until at most two units are undecided; sums of p and of p * size stay as they are."""
    p = p.astype(float).copy()
    tiny = 1e-9
    open_: list[int] = []
    for k in range(len(p)):
        if not tiny < p[k] < 1 - tiny:
            p[k] = round(p[k])
            continue
        open_.append(k)
        while len(open_) == 3:
            a, b, c = open_
            u = [float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a])]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            _move(p, open_, u, draw)
            open_ = [i for i in open_ if tiny < p[i] < 1 - tiny]
    if len(open_) == 2 and size[open_[0]] == size[open_[1]]:
        _move(p, open_, [1.0, -1.0], draw)
    return np.where(p <= tiny, 0.0, np.where(p >= 1 - tiny, 1.0, p))


def _move(p: np.ndarray, units: list[int], u: list[float], draw: Iterator[float]) -> None:
    """One step along u, forth or back as far as the unit cube lets, so that p is kept on average."""
    forth = min(((1 - p[i]) / v if v > 0 else -p[i] / v) for i, v in zip(units, u, strict=True) if v)
    back = min((p[i] / v if v > 0 else (p[i] - 1) / v) for i, v in zip(units, u, strict=True) if v)
    step = forth if next(draw) * (forth + back) < back else -back
    for i, v in zip(units, u, strict=True):
        x = p[i] + step * v
        p[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x


def draws(seed: int) -> Iterator[float]:
    rng = np.random.Generator(np.random.PCG64(seed))
    while True:
        yield from rng.random(1024).tolist()


def land(p: np.ndarray, size: np.ndarray, draw: Iterator[float]) -> np.ndarray:
    """The landing problem of a source: at most a few units; the words constraint gives way, then the number."""
    p, left = p.copy(), [i for i in range(len(p)) if 0 < p[i] < 1]
    while len(left) > 1:
        _move(p, left[:2], [1.0, -1.0], draw)
        left = [i for i in left if 0 < p[i] < 1]
    for i in left:
        p[i] = 1.0 if next(draw) < p[i] else 0.0
    return p


UNIT = "doc_id long, key long, source string, size long, bucket long, p double"


def _level(seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "doc_id", "size"], kind="stable").reset_index(drop=True)
        draw = draws((int(group.key.iloc[0]) ^ seed) & (2**63 - 1))
        p = flight(group.p.to_numpy(), group["size"].to_numpy(), draw)
        group["p"] = land(p, group["size"].to_numpy(), draw) if last else p
        return group

    return run


def _word_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parting = blank_bytes()
    for batch in batches:
        sizes = [np.diff(words_of(data, offsets, parting).first) for _, _, data, offsets in slices(batch.column(3))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(sizes).astype(np.int64) if sizes else [], pa.int64())], names=["doc_id", "key", "source", "size"])


def row_key(doc_id: str = "doc_id", source: str = "source", text: str = "text"):
    return F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{source}`").cast("string"), F.col(f"`{text}`").cast("string"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 7, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, key, source, size, source_size, target, copies, taken (copies * size).

    Sizes are words; null and empty texts have none and take none. Null is a source of its own, the last. Each
    source's taken words are its target but for its landing problem, of at most two documents. No document has more
    than ceil(most) copies. The seed and the rows alone decide, so reruns agree. Equal rows are units of their own;
    they share a bucket, which they may fill beyond BUCKET.
    A table without rows gives none. Extra columns are ignored. At most MOST_SOURCES sources are planned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(doc_id, source, text).alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
    units = written(rows.mapInArrow(returning_memory(_word_sizes), "doc_id long, key long, source string, size long"), "mix-units")
    sums = units.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    target = targets_of([(r.source, r.size) for r in sums], weights, most)
    plan = spark.createDataFrame(
        [(r.source, r.size, target[r.source], target[r.source] / r.size if r.size else 0.0, math.ceil(r.n / BUCKET)) for r in sums],
        "of string, source_size long, target double, rate double, buckets long",
    )
    # the plan has a row for each source, at most MOST_SOURCES of them
    due = units.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    due = due.withColumn("p", F.col("rate") - F.floor("rate")).withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("buckets")))
    state = due.select("doc_id", "key", "source", "size", "bucket", "p")
    decided, buckets, level = None, max([1, *(math.ceil(r.n / BUCKET) for r in sums)]), 0
    while True:
        last = buckets == 1
        state = written(state.groupBy("source", "bucket").applyInPandas(_level(seed + level, last), UNIT), "mix-level")
        done = state.where("p = 0 or p = 1")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        # two units of a bucket are open at most: as many buckets as make a full one meet
        state = state.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / (BUCKET // 2)).cast("long"))
        buckets, level = math.ceil(buckets / (BUCKET // 2)), level + 1
    out = decided.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of")))
    copies = (F.floor("rate") + F.col("p")).cast("long")
    return out.select("doc_id", "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with each row as often as the mix takes it. Equal rows share the copies of all of them; columns may have
    any names."""
    copies = mixed.groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    if copies.where("rows > 1").limit(1).count():
        docs = docs.dropDuplicates([doc_id, source, text])
    keyed = docs.select(F.struct("*").alias("row"), row_key(doc_id, source, text).alias("key"))
    # the taken keys are the hash table of each task; texts stream past it unsorted
    taken = keyed.join(copies.where("copies > 0").select("key", "copies").hint("shuffle_hash"), "key")
    return taken.select("row", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select("row.*")
