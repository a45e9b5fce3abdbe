"""The language-model judge as a table: prompts made in Spark, replies kept by the prompt's digest, only new ones asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks that a prompt shows, and characters of each.
SHOWN, CHARACTERS = 3, 200
ASKED = "prompt_id string, prompt string"
REPLIES = "prompt_id string, reply string, error string"
TASK = """A syllabus says:
%s

Does it support this question, in its field of application and in enough depth to answer it? A field that the syllabus
doesn't name counts as foreign, however near its concepts are.
Question: %s

Answer in three lines and no others:
DECISION: YES or NO
JUSTIFICATION: one short sentence
MODULE: the module's name, or unknown
"""


def prompt(question: Column, chunks: Column, shown: int = SHOWN, characters: int = CHARACTERS) -> Column:
    """The task with the heads of the first chunks, an array of structs with a text."""
    heads = F.transform(F.slice(chunks, 1, shown), lambda x: F.concat(F.lit("- "), F.substring(F.coalesce(x["text"], F.lit("")), 1, characters)))
    return F.format_string(TASK, F.array_join(heads, "\n"), F.coalesce(question, F.lit("")))


class CachedJudge:
    """A judge for gates.decided: rows(question, chunks, ...) plus reply.

    ask takes prompts(prompt_id, prompt), each once, and returns (prompt_id, reply, error): a job of its own that may call
    a model for each partition. What it says is appended to the Parquet table in folder; equal prompts, of one run or of
    earlier ones, are answered from there. A null reply is an error: it is kept with its message, answered as no reply, and
    asked again by the next run. version is part of the digest, so another model never meets stored replies.
    """

    def __init__(self, spark: SparkSession, folder: str, ask: Callable[[DataFrame], DataFrame], version: str = "1"):
        self.spark, self.folder, self.ask, self.version = spark, folder.rstrip("/"), ask, version

    def replies(self) -> DataFrame:
        """All rows so far, errors too."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], REPLIES)
        return self.spark.read.schema(REPLIES).parquet(self.folder)

    def errors(self) -> DataFrame:
        """Prompts that no run has answered: (prompt_id, error)."""
        rows = self.replies().groupBy("prompt_id").agg(F.max("reply").alias("reply"), F.max("error").alias("error"))
        return rows.where("reply IS NULL").select("prompt_id", F.coalesce("error", F.lit("no reply")).alias("error"))

    def __call__(self, rows: DataFrame) -> DataFrame:
        made = rows.withColumn("prompt", prompt(F.col("question"), F.col("chunks")))
        made = made.withColumn("prompt_id", F.sha2(F.concat_ws("\u0000", F.lit(self.version), "prompt"), 256))
        known = self.replies().where("reply IS NOT NULL").select("prompt_id")
        misses = made.groupBy("prompt_id").agg(F.first("prompt").alias("prompt")).join(known, "prompt_id", "left_anti")
        if not misses.isEmpty():
            said = self.ask(misses).select("prompt_id", F.col("reply").cast("string").alias("reply"), F.col("error").cast("string").alias("error"))
            said.write.mode("append").parquet(self.folder)
        best = self.replies().groupBy("prompt_id").agg(F.max("reply").alias("reply"))
        answered = made.drop("prompt").join(best, "prompt_id", "left")
        return answered.select(*rows.columns, F.coalesce("reply", F.lit("")).alias("reply"))
