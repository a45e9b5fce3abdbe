"""Concepts of a syllabus and the overlap of a question with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS, Config
from auditlark.functions import text as T
from auditlark.functions import words as W
from auditlark.operators import retrieve


def lexical_concepts(text: Column | str, least: int = 3) -> Column:
    """Capitalised phrases longer than least and acronyms, in lower case, distinct."""
    phrases = F.filter(F.transform(F.regexp_extract_all(T.col(text), F.lit(rf"({T.BEFORE}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*{T.AFTER})"), 1), F.lower), lambda p: F.length(p) > least)
    acronyms = F.transform(F.regexp_extract_all(T.col(text), F.lit(rf"({T.BEFORE}[A-Z]{{2,}}{T.AFTER})"), 1), F.lower)
    return F.array_distinct(F.concat(phrases, acronyms))


def concepts_of(text: Column | str, least: int = 3, phrases: Callable[[Column], Column] | None = None) -> Column:
    """lexical_concepts, and behind them what phrases makes of the text (an array), if given."""
    own = lexical_concepts(text, least)
    return own if phrases is None else F.array_distinct(F.concat(own, F.coalesce(phrases(T.col(text)), F.array().cast("array<string>"))))


def scope_concepts(texts: DataFrame, c: Config = DEFAULTS, phrases: Callable[[Column], Column] | None = None) -> DataFrame:
    """texts(syllabus_id, text) -> (syllabus_id, rank, concept): the longest concepts, equals by letters."""
    rows = texts.select("syllabus_id", F.explode(F.filter(concepts_of("text", 2, phrases), lambda p: ~p.isin(W.GENERIC_WORDS))).alias("concept")).distinct()
    ranked = rows.withColumn("rank", F.expr("row_number() over (partition by syllabus_id order by length(concept) desc, concept)"))
    return ranked.where(F.col("rank") <= c.scope_concepts).select("syllabus_id", "rank", "concept")


def frequent_concepts(texts: DataFrame, most: int) -> DataFrame:
    """texts(syllabus_id, text) -> (syllabus_id, rank, concept, n): the most frequent content words, equals by letters."""
    counts = texts.select("syllabus_id", F.explode(T.content_words("text")).alias("concept")).groupBy("syllabus_id", "concept").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.expr("row_number() over (partition by syllabus_id order by n desc, concept)"))
    return ranked.where(F.col("rank") <= most).select("syllabus_id", "rank", "concept", "n")


def alike(a: Column | str, b: Column | str) -> Column:
    """Whether two words share a stem: one holds the other (of five letters), or the first five letters agree."""
    a, b = T.col(a), T.col(b)
    long_a, long_b = F.length(a) >= 5, F.length(b) >= 5
    inside = (F.contains(b, a) & long_a) | (F.contains(a, b) & long_b)
    return (F.length(a) >= 4) & (F.length(b) >= 4) & (inside | (long_a & long_b & (F.substring(a, 1, 5) == F.substring(b, 1, 5))))


def concept_overlap(questions: DataFrame, concepts: DataFrame, embedder=None, c: Config = DEFAULTS) -> DataFrame:
    """questions(query_id, syllabus_id, question) -> (query_id, overlap): the share of content words, repeats counted,
    that are or resemble a word of the syllabus' concepts; 1 without words on either side. With an embedder, other
    words count by their best cosine with one of the syllabus, if it reaches scope_cosine.

    Word pairs meet by keys, not all with all: equal first five letters, or a word's own parts of five letters and
    more that are a word of the other side.
    """
    q = questions.select("query_id", "syllabus_id", F.posexplode(T.content_words("question")).alias("pos", "word"))
    s = concepts.select("syllabus_id", F.explode(F.filter(F.split(F.lower("concept"), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{3,}$"))).alias("other")).distinct()
    keys = lambda w: F.array_distinct(F.concat(F.array(w), F.when(F.length(w) >= 5, F.array(F.concat(F.lit("^"), F.substring(w, 1, 5)))).otherwise(F.expr("cast(array() as array<string>)"))))
    # a part can only be a whole word of the other side: none is longer than the longest there
    longest = lambda words, name: F.coalesce(F.max(F.length(name)), F.lit(0)).alias("most")
    words = q.select("syllabus_id", "word").distinct()
    most_s, most_q = (frame.groupBy("syllabus_id").agg(longest(frame, name)) for frame, name in ((s, "other"), (words, "word")))
    none = F.expr("cast(array() as array<string>)")
    sizes = lambda w: F.sequence(F.lit(5), F.least(F.length(w) - 1, F.col("most")))
    parts = lambda w: F.when(F.least(F.length(w) - 1, F.col("most")) >= 5, F.flatten(F.transform(sizes(w), lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))).otherwise(none)
    whole_s = s.select("syllabus_id", F.explode(keys(F.col("other"))).alias("key")).distinct()
    part_s = s.join(most_q, "syllabus_id").select("syllabus_id", F.explode(parts(F.col("other"))).alias("key")).distinct()
    hit = words.join(most_s, "syllabus_id").select("syllabus_id", "word", F.explode(F.concat(keys(F.col("word")), parts(F.col("word")))).alias("key")).join(whole_s, ["syllabus_id", "key"], "left_semi")
    held = words.where(F.length("word") >= 5).join(part_s.withColumnRenamed("key", "word"), ["syllabus_id", "word"], "left_semi")
    matched = hit.select("syllabus_id", "word").unionByName(held).distinct().withColumn("score", F.lit(1.0))
    if embedder is not None:
        rest = words.join(matched, ["syllabus_id", "word"], "left_anti").withColumn("query_id", F.xxhash64("syllabus_id", "word"))
        sought = rest.select("query_id", embedder.vector(F.col("word"), "query").alias("vector"), F.col("syllabus_id").alias("group"))
        known = s.select(F.xxhash64("syllabus_id", "other").alias("chunk_id"), embedder.vector(F.col("other"), "passage").alias("vector"), F.col("syllabus_id").alias("group"))
        near = retrieve.top_k(sought, known, 1, grouped=True).where(F.col("cosine") >= c.scope_cosine)
        matched = matched.unionByName(rest.join(near, "query_id").select("syllabus_id", "word", F.col("cosine").alias("score")))
    found = q.join(matched, ["syllabus_id", "word"], "left").groupBy("query_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("found"))
    known = s.select("syllabus_id").distinct().withColumn("known", F.lit(True))
    return questions.select("query_id", "syllabus_id").join(known, "syllabus_id", "left").join(found, "query_id", "left").select("query_id", F.when(F.col("known"), F.coalesce("found", F.lit(1.0))).otherwise(1.0).alias("overlap"))
