"""A stream of question pastes audited batch by batch, with exactly-once files by batch number.

Repeated questions are dropped within a watermark, in the state store, and a second stream keeps the running summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.functions import text as T
from auditlark.operators import gates
from auditlark.plans.engine import CurriculumEngine


def distinct_questions(pastes: DataFrame, time: str, delay: str) -> DataFrame:
    """pastes(paste_id, text, time) -> (paste_id, pos, question, time): of questions that are equal but for case and white
    space, one within the delay. The state holds keys no older than the watermark."""
    split = pastes.withWatermark(time, delay).select("paste_id", F.posexplode(T.split_questions("text")).alias("pos", "question"), time)
    keyed = split.withColumn("same", F.xxhash64(F.lower(F.regexp_replace(T.strip("question"), r"\s+", " "))))
    return keyed.dropDuplicatesWithinWatermark(["same"]).drop("same")


def _complete(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def audit_stream(engine: CurriculumEngine, pastes: DataFrame, folder: str, checkpoint: str, syllabus_id: str | None = None, threshold: float | None = None, time: str | None = None, delay: str = "1 hour"):
    """Start auditing a streaming DataFrame pastes(paste_id, text) into Parquet below folder.

    Each batch writes its own folder. A batch that is tried again is written anew if it was cut off, and left as it is if it
    was whole, so that readers of the folder see each result once. time: the column by which repeated questions are
    dropped within the delay; a batch's questions are written beside the checkpoint first, as its state must be computed
    once and in full, whatever the audit reads.
    """
    source = pastes if time is None else distinct_questions(pastes, time, delay)

    def write(batch: DataFrame, number: int) -> None:
        out, own = f"{folder}/batch={number}", f"{checkpoint}-questions/batch={number}"
        if time is not None:
            batch.write.mode("overwrite").parquet(own)
            batch = batch.sparkSession.read.schema(batch.schema).parquet(own)
        if not _complete(batch.sparkSession, out):
            found = engine.analyze_questions(batch, syllabus_id, threshold) if time is None else engine.analyze_split(batch, syllabus_id, threshold)
            found.write.mode("overwrite").parquet(out)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def summary_stream(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Start the running summary of audit_stream()'s results: how many questions are in, borderline and out, in one row in
    out, replaced by each batch. The counts live in the state store."""
    given = "gatekeeper_passed boolean, is_in_syllabus boolean, similarity double, batch int"
    results = spark.readStream.schema(given).parquet(folder)
    verdict = gates.verdict(F.col("gatekeeper_passed"), F.col("is_in_syllabus"), "similarity")
    counts = results.select(verdict.alias("verdict")).groupBy().agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("in", "borderline", "out")), F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(out)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).start()
