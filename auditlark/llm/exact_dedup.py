"""Exact dedup with a log-structured merge index of digests; DataFrame functions only.

Ingest: documents fall into memtables; a memtable is flushed as a run, sorted by digest, with the smallest
identifier and the count of each digest, and a filter beside it (bits of hashed digests). Compaction: a digest whose
filter bit no other run sets passes to the next level unseen by the others; the rest merge, and the smallest
identifier stays. Lookup: each document takes the entry of its digest. A hit (an entry that another document
holds) is compared with that document byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.llm.common import BLANKS, documents_of, new_path, written

#: Runs of a level that compaction merges into one of the next.
FANOUT = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


class DigestIndex:
    """The levels of the index: each run is a sorted Parquet folder; rows are (digest, keep_id, n)."""

    def __init__(self, spark: SparkSession, memtables: int = FANOUT, filter_bits: int = 1 << 22):
        self.spark, self.memtables, self.filter_bits = spark, memtables, filter_bits
        self.root = new_path(spark, "digest-index")
        self.level = 0

    def _place(self, digest: Column) -> tuple[Column, Column]:
        """Word and bit of a digest in a run's filter."""
        at = F.pmod(F.xxhash64(digest), F.lit(self.filter_bits))
        return F.floor(at / 64).cast("long").alias("slot"), (at % 64).cast("int").alias("bit")

    def flush(self, digests: DataFrame) -> None:
        """digests(doc_id, digest) -> level 0. A memtable takes a share of the documents by the hash of their ids."""
        table = F.pmod(F.xxhash64("doc_id"), F.lit(self.memtables)).cast("int")
        runs = digests.groupBy(table.alias("run"), "digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        self._write(runs, 0)

    def _write(self, runs: DataFrame, level: int) -> None:
        path = f"{self.root}/level-{level}"
        runs.repartitionByRange("run", "digest").sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(f"{path}/runs")
        self.level = level

    def runs(self) -> DataFrame:
        return self.spark.read.schema("digest binary, keep_id long, n long, run int").parquet(f"{self.root}/level-{self.level}/runs")

    def filters(self) -> DataFrame:
        """(run, slot, bits): the filter of each run in words of 64 bits; at most filter_bits / 64 rows a run."""
        slot, bit = self._place(F.col("digest"))
        one = self.runs().select("run", slot, bit)
        return one.groupBy("run", "slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))

    def compact(self) -> None:
        """Merge groups of FANOUT runs until one is left; of equal digests the smallest identifier stays."""
        count = self.memtables
        while count > 1:
            group = F.floor(F.col("run") / FANOUT).cast("int")
            slot, bit = self._place(F.col("digest"))
            # bits that two or more runs of a group set: by bit-sliced addition over the words of their filters
            seen = self.filters().groupBy(group.alias("grp"), "slot").agg(F.collect_list("bits").alias("words"))
            twice = F.aggregate(
                "words",
                F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice")),
                lambda acc, w: F.struct(acc["once"].bitwiseOR(w).alias("once"), acc["twice"].bitwiseOR(acc["once"].bitwiseAND(w)).alias("twice")),
            )["twice"]
            shared = seen.select("grp", "slot", twice.alias("twice")).where("twice <> 0")
            entries = self.runs().select(group.alias("grp"), "digest", "keep_id", "n", slot, bit)
            held = entries.join(shared, ["grp", "slot"], "left").withColumn("hit", F.coalesce(F.getbit(F.col("twice"), F.col("bit")) == 1, F.lit(False)))
            alone = held.where(~F.col("hit")).select(F.col("grp").alias("run"), "digest", "keep_id", "n")
            merged = held.where("hit").groupBy(F.col("grp").alias("run"), "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            self._write(alone.unionByName(merged), self.level + 1)
            count = -(-count // FANOUT)

    def entries(self) -> DataFrame:
        return self.runs().drop("run")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, memtables: int = FANOUT, doc_id: str = "doc_id", text: str = "text", digest_of: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (smallest doc_id of equal texts), group_size, kept, text_sha256.

    Texts are equal when they are after each run of blanks became one; null counts as empty, so null and empty
    texts form one group, and so may texts of blanks alone with each other. Rows that share a doc_id and a text are all
    kept if that id stays. Null doc_ids give way to others. No rows give no rows; extra columns are ignored. Equal
    digests of different bytes, should they ever meet, form groups by their bytes; digest_of is another digest for tests.
    """
    spark = docs.sparkSession
    rows = documents_of(docs, doc_id, text)
    digests = written(rows.select("doc_id", digest_of(normalised(F.col("text"))).alias("digest")), "dedup-digests")
    index = DigestIndex(spark, memtables)
    index.flush(digests)
    index.compact()
    found = digests.join(index.entries(), "digest")
    hits = found.where("n > 1").select(F.col("doc_id").alias("id"), "digest", "keep_id").distinct()
    # bytes of the documents in groups: read again, joined by id to what the index says. The hash table of each task
    # holds ids and digests; texts stream past it unsorted
    bytes_ = rows.join(hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "digest", "keep_id", normalised(F.col("text")).alias("bytes"))
    bytes_ = written(bytes_.where(digest_of(F.col("bytes")) == F.col("digest")), "dedup-bytes")
    keeper = bytes_.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("bytes").alias("kept_bytes"))
    # a table of its own: Spark can then split the join where one text has very many copies
    keeper = written(keeper, "dedup-keepers")
    differs = written(bytes_.join(keeper, "digest").where("bytes <> kept_bytes").select("doc_id", "digest", "bytes"), "dedup-differs")
    out = found.select("doc_id", "digest", "keep_id", "n")
    if differs.limit(1).count():
        out = _by_bytes(rows, out, differs, digest_of)
    return out.select(
        "doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _by_bytes(rows: DataFrame, out: DataFrame, differs: DataFrame, digest_of: Callable[[Column], Column]) -> DataFrame:
    """Groups of the digests that different texts share, by the texts themselves."""
    digests = differs.select("digest").distinct()
    texts = rows.select("doc_id", normalised(F.col("text")).alias("bytes")).withColumn("digest", digest_of(F.col("bytes"))).join(digests, "digest", "left_semi")
    groups = texts.groupBy("digest", "bytes").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    again = texts.join(groups, ["digest", "bytes"]).select("doc_id", "digest", "keep_id", "n")
    return out.join(digests, "digest", "left_anti").unionByName(again)
