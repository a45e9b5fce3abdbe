"""Gates, decisions and enrichment of the audit: CASE expressions on one row per question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS, Config
from auditlark.functions import text as T
from auditlark.operators import rerank

# The messages of the decisions.
LOW = "Question is not sufficiently similar to syllabus content."
COVERED = "The topic is conceptually covered in the syllabus."
LISTED = "The topic is explicitly listed in the syllabus."
MISSING = "The topic is not explicitly mentioned in the syllabus."
CONCEPTUAL = "The question is conceptually grounded in syllabus topics."
GROUNDED = "The question is grounded in syllabus topics."
ALIGNED = "The application conceptually aligns with syllabus topics."
UNSURE = "Validator could not confidently ground the question in the syllabus."
GATE_FAILED = "Similarity below threshold — no valid syllabus content found."
BAD_YES = "The application conceptually aligns with the technical scope of the syllabus."
BAD_NO = "The question introduces topics or applications not explicitly supported by the syllabus."


def match_strength(similarity: Column | str, c: Config = DEFAULTS) -> Column:
    s = T.col(similarity)
    return F.when(s > c.strong, "STRONG_MATCH").when(s >= c.partial, "PARTIAL_MATCH").when(s >= c.weak, "WEAK_MATCH").otherwise("NO_MATCH")


def match_type(similarity: Column | str, scoped: Column, c: Config = DEFAULTS) -> Column:
    near = T.col(similarity) >= c.weak
    return F.when(near & scoped, "DIRECT_SUBJECT_MATCH").when(near, "RELATED_CURRICULUM_MATCH").otherwise("OUT_OF_CURRICULUM")


def gate_passes(similarity: Column | str, threshold: float, c: Config = DEFAULTS) -> Column:
    return (match_strength(similarity, c) != "NO_MATCH") & (T.col(similarity) >= threshold)


def verdict(gate: Column, in_syllabus: Column, similarity: Column | str) -> Column:
    return F.when(~gate, "out").when(in_syllabus, "in").when(T.col(similarity) >= 0.6, "borderline").otherwise("out")


def similarity_band(similarity: Column | str) -> Column:
    return F.when(T.col(similarity) >= 0.8, "Strong").when(T.col(similarity) >= 0.6, "Moderate").otherwise("Weak")


def percent(similarity: Column | str) -> Column:
    """With one decimal; of the number as stored, halves to the even digit, as C and DuckDB print (format_string rounds
    the shortest decimal form, halves up)."""
    return F.call_function("format_number", T.col(similarity) * 100, F.lit("0.0"))


def judged_reply(reply: Column | str) -> tuple[Column, Column, Column]:
    """Decision, justification and module of a judge's reply: the last line of each mark counts; a cut-off
    justification gives way to the decision's own."""
    rows = F.split(T.col(reply), "\r\n|\n|\r")

    def last(mark: str, default: str) -> Column:
        own = F.filter(rows, lambda x: F.upper(x).startswith(mark))
        return F.when(F.size(own) > 0, T.strip(F.substr(F.element_at(own, -1), F.lit(len(mark) + 1)))).otherwise(default)

    decision = F.upper(last("DECISION:", "NO"))
    why = last("JUSTIFICATION:", "")
    bad = (F.length(why) < 15) | why.endswith(" sy") | why.endswith(" the") | why.endswith(" and")
    return decision, F.when(bad & (decision == "YES"), BAD_YES).when(bad, BAD_NO).otherwise(why), last("MODULE:", "unknown")


def decided(rows: DataFrame, threshold: float, judge: Callable[[DataFrame], DataFrame] | None = None, c: Config = DEFAULTS) -> DataFrame:
    """rows(query_id, question, top, chunks) plus decision, justification, rejection, module, question_type.

    judge takes the rows that need it and adds reply; without one those are answered NO. It sees that branch alone.
    """
    text = F.array_join(F.transform(F.filter("chunks", lambda x: ~F.lower(x["text"]).rlike("reference books|bibliography")), lambda x: F.lower(x["text"])), " ")
    all_text = F.array_join(F.transform("chunks", lambda x: F.lower(x["text"])), " ")
    first = F.get("chunks", 0)
    rows = rows.select(
        "*", T.question_type("question").alias("question_type"), T.external_domain("question", text).alias("foreign"), T.topic_present("question", all_text).alias("topic"),
        ((F.col("top") >= c.override_similarity) & (F.coalesce(first["semantic"], F.lit(0.0)) >= c.override_semantic) & (F.coalesce(first["boost"], F.lit(0.0)) > 0)).alias("strong"),
        F.coalesce(F.nullif(first["module"], F.lit("")), F.lit("unknown")).alias("first_module"),
    )
    rows = rows.withColumn("topic", F.col("topic") | F.col("strong"))
    rows = rows.withColumn("needs_judge", (F.col("top") >= threshold) & F.col("foreign").isNull() & (F.col("question_type") == "application") & ~F.col("strong"))
    replied = rows.withColumn("reply", F.lit(""))
    if judge is not None:
        replied = judge(rows.where("needs_judge")).unionByName(rows.where("not needs_judge").withColumn("reply", F.lit("")))
    judged, why, module = judged_reply("reply")
    kind, topic, strong = F.col("question_type"), F.col("topic"), F.col("strong")
    yes = (
        F.when((F.col("top") < threshold) | F.col("foreign").isNotNull(), False).when(kind == "definition", topic).when((kind == "unknown") & topic, True)
        .when(kind == "application", strong | (judged == "YES")).otherwise(False)
    )
    foreign = F.concat(F.lit("Question introduces external application domain '"), "foreign", F.lit("' not explicitly covered in syllabus."))
    message = (
        F.when(F.col("top") < threshold, LOW).when(F.col("foreign").isNotNull(), foreign)
        .when(kind == "definition", F.when(topic & strong, COVERED).when(topic, LISTED).otherwise(MISSING))
        .when((kind == "unknown") & topic, F.when(strong, CONCEPTUAL).otherwise(GROUNDED)).when(kind == "application", F.when(strong, ALIGNED).otherwise(why)).otherwise(UNSURE)
    )
    by_judge = F.col("needs_judge")
    return replied.select(
        *rows.columns, yes.alias("in_syllabus"), F.when(yes, "YES").otherwise("NO").alias("decision"), message.alias("justification"), F.when(yes, "").otherwise(message).alias("rejection"),
        F.when(by_judge, module).when(yes, F.col("first_module")).otherwise("unknown").alias("decided_module"),
    )


def audited(scored: DataFrame, threshold: float = DEFAULTS.user_threshold, scoped: bool = True, scope: DataFrame | None = None, judge=None, c: Config = DEFAULTS) -> DataFrame:
    """Scored chunks of every question -> one result row per question.

    scope(query_id, overlap), if given, rejects questions whose concepts are foreign to the syllabus before all else.
    Only a question that passes its gate has chunks, a judge's answer (llm_*) and the two strongest modules at most; one
    that fails it keeps all its modules, and the reason. A pass that the cleaner left without chunks is no match.
    """
    rows = rerank.collected(scored)
    rows = rows.withColumn("chunks", rerank.cleaned(rerank.gap_filtered(rerank.deduplicated("chunks", c), c), c))
    if scope is not None:
        rows = rows.join(scope, "query_id", "left").withColumn("rejected", F.coalesce((F.col("top") >= c.scope_similarity) & (F.round("overlap", 4) < c.scope_overlap), F.lit(False)))
    else:
        rows = rows.withColumns({"overlap": F.lit(1.0), "rejected": F.lit(False)})
    effective = max(threshold, c.weak)
    rows = decided(rows, effective, judge, c)
    # a question out of scope has no evidence, whatever was found for it
    rows = rows.withColumn("chunks", F.when(F.col("rejected"), F.expr("slice(chunks, 1, 0)")).otherwise(F.col("chunks")))
    passes = gate_passes("top", threshold, c) & ~F.col("rejected")
    modules = rerank.modules_of("chunks", c)
    shown = F.expr("transform(chunks, x -> named_struct('chunk_id', x.chunk_id, 'module', x.module, 'similarity', round(x.similarity, 4), 'text', x.text))")
    kept = F.when(passes, shown).otherwise(F.slice(shown, 1, 0))
    inside = passes & F.col("in_syllabus")
    first = F.get("chunks", 0)
    strength = match_strength("top", c)
    raised = F.when((strength == "WEAK_MATCH") & (F.coalesce(first["semantic"], F.lit(0.0)) >= c.upgrade_semantic) & (F.coalesce(first["boost"], F.lit(0.0)) > 0) & F.lit(scoped), "PARTIAL_MATCH").otherwise(strength)
    level = F.when(F.col("rejected"), "Unknown").otherwise(T.bloom_level("question"))
    return rows.select(
        "query_id", "question", F.round("top", 4).alias("similarity"), F.when(F.col("rejected"), "WEAK_MATCH").when(passes, raised).otherwise(strength).alias("match_strength"),
        F.when(inside, match_type("top", F.lit(scoped), c)).otherwise("OUT_OF_CURRICULUM").alias("match_type"), passes.alias("gatekeeper_passed"), inside.alias("is_in_syllabus"),
        level.alias("bloom_level"), T.difficulty(level).alias("difficulty"), F.array_join(F.when(passes, F.slice(modules, 1, c.modules_shown)).otherwise(modules), ",").alias("modules"), "question_type",
        F.when(passes, F.col("decision")).otherwise("NO").alias("decision"), F.when(F.col("rejected"), foreign_scope(c)).when(passes, F.col("justification")).otherwise(GATE_FAILED).alias("justification"),
        F.when(F.col("rejected"), "MATCH_FOUND").when((strength == "NO_MATCH") | (passes & (F.size("chunks") == 0)), "NO_MATCH").otherwise("MATCH_FOUND").alias("retrieval_status"), F.col("rejected").alias("scope_rejected"),
        *(F.when(passes, F.col(name)).alias(label) for name, label in (("decision", "llm_decision"), ("justification", "llm_justification"), ("decided_module", "llm_module"))),
        F.size(kept).cast("long").alias("n_chunks"), kept.alias("top_chunks"), *(F.round(F.coalesce(first[name], F.lit(0.0)), 4).alias(label) for name, label in DIAGNOSTICS.items()),
    )


#: Of the first chunk left, what its score is made of.
DIAGNOSTICS = {"semantic": "semantic_score", "keyword": "keyword_overlap_score", "boost": "concept_boost"}


def foreign_scope(c: Config = DEFAULTS) -> Column:
    """Why a question whose concepts are foreign to the syllabus is refused, with its figures."""
    return F.format_string("High similarity (%.2f) but only %.2f of the question's concepts occur in the syllabus; at least %.2f must.", F.col("top"), F.coalesce("overlap", F.lit(1.0)), F.lit(c.scope_overlap))
