"""Evaluation: confusion matrix, metrics, threshold sweep, McNemar's test, evidence, error reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """rows(expected, predicted booleans) -> tp, fn, fp, tn, total."""
    both = lambda e, p: F.count_if(F.expr(f"{'' if e else 'not '}expected and {'' if p else 'not '}predicted"))
    return rows.groupBy(*by).agg(both(True, True).alias("tp"), both(True, False).alias("fn"), both(False, True).alias("fp"), both(False, False).alias("tn"), F.count("*").alias("total"))


def metrics(matrix: DataFrame, digits: int | None = 4) -> DataFrame:
    """Adds accuracy, precision, recall and f1; 0 where nothing is to be divided by."""
    ratio = lambda a, b: F.when(F.expr(b) == 0, 0.0).otherwise(F.expr(a) / F.expr(b))
    rounded = lambda c: F.round(c, digits) if digits is not None else c
    return matrix.select(
        "*", rounded(ratio("tp + tn", "tp + tn + fp + fn")).alias("accuracy"), rounded(ratio("tp", "tp + fp")).alias("precision"), rounded(ratio("tp", "tp + fn")).alias("recall"),
        rounded(ratio("2 * tp", "2 * tp + fp + fn")).alias("f1"),
    )


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """scores(score, expected) -> metrics of each threshold .05 to .95 by .01.

    Scores are counted by the highest threshold they reach, then summed from above: rows aren't multiplied by 91.
    """
    # the highest threshold i/100 that the score reaches, by the same comparison as the sweep's
    guess = F.floor(F.col("score") * 100).cast("int")
    reach = F.when(F.col("score") >= (guess + 1) / 100, guess + 1).when(F.col("score") >= guess / 100, guess).otherwise(guess - 1)
    counts = scores.select("expected", F.least(F.lit(95), F.greatest(F.lit(4), reach)).alias("i")).groupBy("i").agg(F.count_if("expected").alias("p"), F.count_if(~F.col("expected")).alias("n"))
    steps = scores.sparkSession.range(4, 96).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").fillna(0, ["p", "n"])
    sums = steps.select("i", F.expr("sum(p) over (order by i desc)").alias("tp"), F.expr("sum(n) over (order by i desc)").alias("fp"), F.expr("sum(p) over ()").alias("all_p"), F.expr("sum(n) over ()").alias("all_n"))
    return metrics(sums.where("i >= 5").select((F.col("i") / 100).alias("threshold"), "tp", (F.col("all_p") - F.col("tp")).alias("fn"), "fp", (F.col("all_n") - F.col("fp")).alias("tn")), 10)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep's row of most f1, then most accuracy, then fewest false positives, then lowest threshold."""
    return sweep.orderBy(F.desc("f1"), F.desc("accuracy"), "fp", "threshold").limit(1)


def mcnemar(rows: DataFrame) -> DataFrame:
    """rows(first, second: whether each was right) -> both, only_first, only_second, neither, p_value (exact, two-sided)."""
    n = lambda a, b: F.count_if(F.expr(f"{'' if a else 'not '}first and {'' if b else 'not '}second"))
    table = rows.agg(n(True, True).alias("both"), n(True, False).alias("only_first"), n(False, True).alias("only_second"), n(False, False).alias("neither"))
    return with_p_value(table)


def with_p_value(table: DataFrame) -> DataFrame:
    """Adds the exact two-sided p_value of only_first against only_second."""
    total = F.expr("only_first + only_second")
    # the tail from its largest term down: each term is the one before times i / (n - i + 1). Only so many matter, a few
    # dozen standard deviations, so that the sum is bounded by the root of the number of rows
    terms = F.expr("cast(least(least(only_first, only_second) + 1, 64 + 40 * sqrt(only_first + only_second)) as int)")
    tail = F.expr(
        "aggregate(sequence(1, terms), named_struct('t', double(1), 's', double(0)), (a, k) -> named_struct("
        "'t', a.t * (least(only_first, only_second) - k + 1D) / (greatest(only_first, only_second) + k), 's', a.s + a.t), a -> a.s)"
    )
    table = table.withColumn("terms", terms).withColumn("tail", tail * F.exp(_log_choose("least(only_first, only_second)") - total * math.log(2.0))).drop("terms")
    return table.withColumn("p_value", F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("tail")))).drop("tail")


def _log_choose(k: str) -> Column:
    """ln C(only_first + only_second, k)."""
    return _log_factorial("only_first + only_second") - _log_factorial(k) - _log_factorial(f"only_first + only_second - {k}")


def _log_factorial(n: str) -> Column:
    """ln n!: a sum for small n, else Stirling's series (exact to 1e-14 from 64 on)."""
    small = f"aggregate(sequence(1L, greatest(1L, least(64L, {n}))), double(0), (a, i) -> a + ln(double(i)))"
    series = f"({n}) * ln(double({n})) - ({n}) + 0.5 * ln(2 * pi() * ({n})) + 1D / (12D * ({n})) - 1D / (360D * pow({n}, 3)) + 1D / (1260D * pow({n}, 5))"
    return F.expr(f"if(({n}) <= 64, {small}, {series})")


def error_report(rows: DataFrame) -> DataFrame:
    """Wrong rows of results(expected, predicted, ...) with their diagnosis."""
    wrong = rows.where(F.col("expected") != F.col("predicted"))
    return wrong.withColumn("diagnosis", F.when(F.col("predicted"), "OUT-OF-SYLLABUS question was incorrectly ACCEPTED.").otherwise("IN-SYLLABUS question was incorrectly REJECTED."))


def evidence(chunks: DataFrame, accept: float, least: int, curve: float, weights: tuple[float, float, float, float] = (0.40, 0.27, 0.20, 0.13)) -> DataFrame:
    """chunks(query_id, chunk_id, module, similarity, text) -> the evidence of each question's retrieved chunks.

    The acceptance threshold, the least number of supporting chunks and the density exponent have no defaults.
    """
    tokens = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{4,}$"))
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = chunks.select("query_id", "chunk_id", "similarity", (F.col("similarity") >= accept).alias("ok"), F.lower(F.trim(F.coalesce("module", F.lit("unknown")))).alias("module"), F.array_distinct(F.concat(tokens, pairs)).alias("bag"))
    known = ~F.col("module").isin("", "unknown", "none")
    major = rows.where("ok").where(known).groupBy("query_id", "module").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.max("n").alias("major"))
    bags = rows.groupBy("query_id").agg(
        F.count("*").alias("k"), F.max("similarity").alias("best"), F.avg("similarity").alias("mean"), F.count_if("ok").alias("support"),
        (F.max(F.when(F.col("ok"), F.col("similarity"))) - F.min(F.when(F.col("ok"), F.col("similarity")))).alias("spread"), F.array_sort(F.collect_list(F.struct("chunk_id", "bag"))).alias("bags"),
    )
    # few bags a question, k of the retrieval: pairs within one array
    jaccard = lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    sums = F.aggregate(
        F.sequence(F.lit(0), F.size("bags") - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.aggregate(F.filter(F.transform("bags", lambda y, j: F.when(j > i, jaccard(F.get(F.col("bags"), i)["bag"], y["bag"]))), lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v),
    )
    rows = bags.join(major, "query_id", "left").select("*", F.when(F.col("k") < 2, 0.0).otherwise(sums / (F.col("k") * (F.col("k") - 1) / 2)).alias("agreement"))
    enough = F.col("support") >= least
    consistency = F.coalesce(F.col("major") / F.col("support"), F.lit(0.0))
    stability = F.when(F.col("support") < 2, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.col("spread")), 4))
    base = weights[0] * F.col("mean") + weights[1] * stability + weights[2] * consistency + weights[3] * F.col("agreement")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.pow(F.col("support") / F.col("k"), F.lit(curve))))
    only = lambda c, digits=4: F.when(enough, F.round(c, digits)).otherwise(0.0)
    return rows.select(
        "query_id", F.round("best", 4).alias("best_similarity"), F.round("mean", 4).alias("average_similarity"), F.col("support").alias("supporting_chunks"), F.round(F.col("support") / F.col("k"), 4).alias("supporting_ratio"),
        only(consistency).alias("module_consistency"), only("agreement").alias("concept_agreement"), only(F.when(F.col("support") < 2, 0.0).otherwise(F.col("spread"))).alias("similarity_stability"),
        only(confidence).alias("final_confidence"), F.col("k").alias("chunks_analysed"), (~enough).alias("insufficient_evidence"),
    )
