"""Token counts with a digest cache: (tokenizer version, content digest) -> count; only distinct misses are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.llm.common import BLANKS, documents_of, new_path, returning_memory, written
from auditlark.llm.encoders import encoder

CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(file: str) -> str:
    """The file's name and the digest of its bytes: another vocabulary never meets stored counts."""
    with open(public_tokenizers.path(file), "rb") as f:
        return f"{file}:{hashlib.sha256(f.read()).hexdigest()[:16]}"


def content_digest(text, file: str):
    """The digest of the normalised content: a tokenizer that drops white space sees runs of it as one blank."""
    return F.unhex(F.sha2(F.regexp_replace(text, BLANKS, " ") if drops_blanks(file) else text, 256))


def drops_blanks(file: str) -> bool:
    return encoder(file).leading is False


def _encoded(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.counts(batch.column(1)), pa.int64())], names=["digest", "n_tokens"])

    return returning_memory(run)


def token_counts(docs: DataFrame, cache: str | None = None, file: str = "word_bpe_49k.json", limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), digest.

    cache is a Parquet folder of counts, in the shared folder if not given; it is read first (a missing one is
    empty), and misses are appended to it. Null counts as the empty text, which has no tokens. Repeated rows and
    equal contents are encoded once. Texts of any length are encoded whole. Extra columns are ignored.
    """
    spark = docs.sparkSession
    path, version = cache or new_path(spark, "token-cache"), tokenizer_version(file)
    rows = documents_of(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    digest = content_digest(F.col("text"), file)
    stored = read_cache(spark, path).where(F.col("version") == version).select("digest", "n_tokens")
    # one reading of the texts says what each row holds; the smallest document of each content is encoded if that isn't stored
    about = written(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")), "token-digests")
    misses = about.groupBy("digest").agg(F.min("doc_id").alias("id")).join(stored, "digest", "left_anti")
    # the ids of misses are the hash table of each task; texts stream past it unsorted
    chosen = rows.join(misses.select("id", F.col("digest").alias("miss")).hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "inner")
    # rows may share an id: only the row of the missing content counts
    chosen = chosen.where(digest == F.col("miss")).select("miss", "text")
    counted = chosen.mapInArrow(_encoded(file), "digest binary, n_tokens long").dropDuplicates(["digest"])
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(path)
    stored = read_cache(spark, path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = about.join(stored, "digest", "left")
    return sized.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("digest").alias("digest"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)
