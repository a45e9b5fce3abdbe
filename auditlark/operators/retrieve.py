"""The hybrid score of found chunks, and the keyword and TF-IDF scores over all chunks. Searches are in grid.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS, Config
from auditlark.functions import text as T
from auditlark.functions import words as W
from auditlark.operators.grid import highest_product, top_k

__all__ = ["base_score", "boosted", "concept_boost", "highest_product", "keyword_scores", "scored", "semantic_score", "tfidf", "tfidf_scores", "top_k"]


def semantic_score(distance: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(T.col(distance), F.lit(1.0))))


def base_score(semantic: Column | str, keyword: Column | str, c: Config = DEFAULTS) -> Column:
    return c.semantic_weight * T.col(semantic) + c.keyword_weight * T.col(keyword)


def concept_boost(best: Column | str, c: Config = DEFAULTS) -> Column:
    return F.when(T.col(best) >= c.boost_high[0], c.boost_high[1]).when(T.col(best) >= c.boost_low[0], c.boost_low[1]).otherwise(0.0)


def boosted(base: Column | str, boost: Column | str, c: Config = DEFAULTS) -> Column:
    return F.when(T.col(base) > c.boost_base, F.least(F.lit(1.0), T.col(base) + T.col(boost))).otherwise(T.col(base))


def scored(found: DataFrame, c: Config = DEFAULTS) -> DataFrame:
    """found(query_id, question, chunk_id, text, cosine[, boost]) plus distance, semantic, keyword and similarity."""
    rows = found if "boost" in found.columns else found.withColumn("boost", F.lit(0.0))
    rows = rows.withColumn("distance", 1 - F.col("cosine")).withColumn("semantic", semantic_score("distance"))
    rows = rows.withColumn("keyword", T.keyword_overlap("question", "text"))
    return rows.withColumn("similarity", boosted(base_score("semantic", "keyword", c), "boost", c))


def keyword_scores(questions: DataFrame, chunks: DataFrame, apart: bool = False, lemma: Callable[[Column], Column] | None = None) -> DataFrame:
    """questions(query_id, question) x chunks(chunk_id, text) -> (query_id, score): the best share of a question's
    distinct words of three signs and more that any chunk has, stop words left out; 0 without words. lemma: words of both
    sides count as what it makes of them."""
    own = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}_]+")), lambda w: w.rlike("^[a-z0-9]{3,}$") & ~w.isin(W.KEYWORD_STOP_WORDS))
    words = lambda c: own(c) if lemma is None else F.array_distinct(F.transform(own(c), lambda w: lemma(w)))
    ones = lambda c: F.transform(c, lambda w: F.lit(1.0))
    weighed = lambda df, key, text: df.select(key, F.coalesce(words(text), F.array().cast("array<string>")).alias("terms")).withColumn("weights", ones("terms"))
    q = weighed(questions, "query_id", "question")
    shared = highest_product(q, weighed(chunks, "chunk_id", "text"), apart)
    return q.join(shared, "query_id").select("query_id", F.when(F.size("terms") == 0, 0.0).otherwise(F.col("score") / F.size("terms")).alias("score"))


def tfidf(texts: DataFrame, stop_words: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """texts(id, text) -> (id, term, weight): smoothed idf, L2-normalised; terms are words of two signs and more."""
    tf = _term_counts(texts, stop_words)
    return _weighed(tf, _idf(tf, texts))


def _term_counts(texts: DataFrame, stop_words) -> DataFrame:
    terms = texts.select("id", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 2) & ~w.isin(list(stop_words)))).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def _idf(tf: DataFrame, texts: DataFrame) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _weighed(tf: DataFrame, idf: DataFrame) -> DataFrame:
    raw = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_scores(questions: DataFrame, chunks: DataFrame, apart: bool = False) -> DataFrame:
    """questions(query_id, question) x chunks(chunk_id, text) -> (query_id, score): the highest cosine of TF-IDF
    weights that any chunk has with the question; 0 without shared terms. The idf is that of the chunks, terms that
    no chunk has don't count in the question's norm, stop words are left out."""
    texts = chunks.select(F.col("chunk_id").alias("id"), "text")
    tf = _term_counts(texts, W.TFIDF_STOP_WORDS)
    idf = _idf(tf, texts)
    listed = lambda rows, key: rows.groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("term", "weight")).alias("x")).select(key, F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    asked = listed(_weighed(_term_counts(questions.select(F.col("query_id").alias("id"), F.col("question").alias("text")), W.TFIDF_STOP_WORDS), idf), "query_id")
    scores = highest_product(asked, listed(_weighed(tf, idf), "chunk_id"), apart)
    return questions.select("query_id").join(scores, "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("score"))
