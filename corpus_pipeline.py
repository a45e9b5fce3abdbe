"""The corpus pipeline: STAGES of (name, function), each from documents to documents but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.llm.common import written
from auditlark.llm.decontaminate import without_contaminated
from auditlark.llm.mixing import mix, mixed_documents
from auditlark.llm.ngram_join import ngram_join
from auditlark.llm.token_files import read_token_files, write_token_files
from auditlark.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts the classifier predicts to be toxic go; it learns from the labels of the documents given."""
    return without_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays: the one with the smallest doc_id, null behind all others.

    Rows with one doc_id are told apart by their text, and of equal ones a single one stays. Rows without words are
    linked with nothing and all stay.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("key"), "text")
    linked = ngram_join(rows, doc_id="key").where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    linked = written(linked, "near-duplicates")
    named = linked.join(rows.select("key", "id").distinct(), "key")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "n"))
    kept = written(named.groupBy("component_id").agg(first.alias("x")).select("x.key", "x.n"), "near-duplicates")
    again = kept.where("n > 1").select("key")
    gone = written(linked.select("key").join(kept, "key", "left_anti").unionByName(again), "near-duplicates")
    # keys are the hash tables of the tasks; texts stream past them unsorted
    others = rows.join(gone.hint("shuffle_hash"), "key", "left_anti").select("row.*")
    single = rows.join(again.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    return others.unionByName(single)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words benchmark items cover a twentieth or more go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs, mix(docs))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back."""
    return read_token_files(write_token_files(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
#: Classifiers and sampling have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
