"""Pasted outcomes, compiled modules, question banks, baselines and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.functions import text as T
from auditlark.operators import evaluate

# Patterns of pasted lines, and columns of the result files.
PASTED_CO, PASTED_PO = r"(?i)^(CO\d+)\s*[:–-]\s*(.+)$", r"(?i)^(CO\d+)\s*[:–-]\s*(PO\d+)$"
RESULT_COLUMNS = ["question", "expected", "predicted", "similarity_score", "bloom_level", "match_strength", "match_type", "is_correct"]


def pasted_outcomes(text: Column | str) -> tuple[Column, Column]:
    """Arrays of (co, text) and of (co, po) from lines such as 'CO1: ...' and 'CO1 - PO2'."""
    rows = T.lines(text)
    pick = lambda pattern, second: F.transform(F.filter(rows, lambda x: x.rlike(pattern)), lambda x: F.struct(F.upper(F.regexp_extract(x, pattern, 1)).alias("co"), second(F.regexp_extract(x, pattern, 2))))
    return pick(PASTED_CO, lambda v: T.strip(v).alias("text")), pick(PASTED_PO, lambda v: F.upper(v).alias("po"))


def compiled_modules(modules: Column | str) -> Column:
    """array<struct<title, content>> -> one text: modules with content, numbered, parted by a blank line."""
    full = F.filter(T.col(modules), lambda m: T.strip(F.coalesce(m["content"], F.lit(""))) != "")
    return F.array_join(F.transform(full, lambda m, i: F.concat((i + 1).cast("string"), F.lit("  "), F.coalesce(m["title"], F.lit("")), F.lit(":\n"), m["content"])), "\n\n")


def distinct_texts(rows: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """Of rows of one group with the same trimmed text the first in order stays."""
    first = F.expr(f"row_number() over (partition by `{by}`, trimmed order by `{order}`)")
    return rows.withColumn("trimmed", T.strip(text)).withColumn("place", first).where("place = 1").drop("trimmed", "place")


def question_bank(replies: DataFrame) -> DataFrame:
    """replies(module, reply) -> (module, line_no, question, expected): numbered lines of more than 15 characters below
    the marks IN_SYLLABUS and OUT_OF_SYLLABUS."""
    from pyspark.sql import Window

    lines = replies.select("module", F.posexplode(T.lines("reply")).alias("line_no", "line"))
    mark = F.when(F.contains(F.upper("line"), F.lit("IN_SYLLABUS")), True).when(F.contains(F.upper("line"), F.lit("OUT_OF_SYLLABUS")), False)
    w = Window.partitionBy("module").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("*", mark.alias("mark"), F.last(mark, ignorenulls=True).over(w).alias("expected"))
    question = T.strip(F.regexp_replace("line", r"^\d+[.)]\s*", ""))
    return rows.where("mark is null and expected is not null").where(F.col("line").rlike(r"^\d+[.)]")).select("module", "line_no", question.alias("question"), "expected").where("length(question) > 15")


def merged_dataset(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Stored questions without placeholders, then the new ones."""
    return existing.where(~F.contains("question", F.lit("REPLACE_ME"))).unionByName(added)


def compared_baselines(scores: DataFrame) -> DataFrame:
    """scores(name, expected, predicted, seconds) -> metrics and mean milliseconds of each name, best first: most f1,
    then by name."""
    speed = scores.groupBy("name").agg(F.round(F.avg("seconds") * 1000, 3).alias("mean_ms"))
    return evaluate.metrics(evaluate.confusion(scores, "name")).join(speed, "name").orderBy(F.desc("f1"), "name")


def write_results(results: DataFrame, folder: str) -> None:
    """results.csv (eight columns), metrics.json, and the two reports of wrong answers, as folders of part files.

    Questions without an answer (predicted is null) are errors: they are counted, and left out of all else.
    """
    errors = results.where("predicted is null").agg(F.count("*").cast("int").alias("errors_skipped"))
    results = results.where("predicted is not null")
    results.select(*RESULT_COLUMNS).write.mode("overwrite").csv(f"{folder}/results.csv", header=True)
    matrix = evaluate.metrics(evaluate.confusion(results)).join(F.broadcast(errors))  # one row each
    matrix.withColumnRenamed("f1", "f1_score").write.mode("overwrite").json(f"{folder}/metrics.json")
    wrong = evaluate.error_report(results)
    wrong.where("predicted").write.mode("overwrite").json(f"{folder}/false_positives.json")
    wrong.where("not predicted").write.mode("overwrite").json(f"{folder}/false_negatives.json")
