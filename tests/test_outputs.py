"""Result files and question banks."""

from pyspark.sql import functions as F

from auditlark.operators import outputs


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", True, False), ("d", True, None)], "question string, expected boolean, predicted boolean")
    rows = rows.withColumns({"similarity_score": F.lit(0.5), "bloom_level": F.lit("Apply"), "match_strength": F.lit("WEAK_MATCH"), "match_type": F.lit("X"), "is_correct": F.col("expected") == F.col("predicted"), "extra": F.lit(1)})
    outputs.write_results(rows, str(tmp_path))
    back = spark.read.csv(f"{tmp_path}/results.csv", header=True)
    assert back.columns == outputs.RESULT_COLUMNS and back.count() == 3
    m = spark.read.json(f"{tmp_path}/metrics.json").first()
    assert (m.tp, m.fp, m.fn, m.tn, m.total, m.errors_skipped) == (1, 1, 1, 0, 3, 1)
    assert [r.question for r in spark.read.json(f"{tmp_path}/false_positives.json").collect()] == ["b"]
    assert [r.question for r in spark.read.json(f"{tmp_path}/false_negatives.json").collect()] == ["c"]


def test_question_bank_and_merge(spark):
    replies = spark.createDataFrame([("m", "1. before any mark, dropped\nIN_SYLLABUS:\n1. What does a cipher do?\n2. short\nOUT_OF_SYLLABUS:\n1. Where do bananas grow?")], "module string, reply string")
    rows = outputs.question_bank(replies).select("question", "expected")
    assert sorted(map(tuple, rows.collect())) == [("What does a cipher do?", True), ("Where do bananas grow?", False)]
    old = spark.createDataFrame([("REPLACE_ME please", True), ("kept", False)], "question string, expected boolean")
    assert outputs.merged_dataset(old, rows).count() == 3
    modules = spark.createDataFrame([([("A", "x"), ("B", " "), (None, "y")],)], "m array<struct<title:string,content:string>>")
    assert modules.select(outputs.compiled_modules("m")).first()[0] == "1  A:\nx\n\n2  :\ny"
