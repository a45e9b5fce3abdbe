"""Key phrases: candidates between stop words and marks, scored by the degree of their words over their frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlark.functions import text as T
from auditlark.functions import words as W

#: A word, with hyphens and apostrophes inside, or a run of marks, or a line's end. Words of a phrase at most.
TOKEN, MOST_WORDS = r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]+|\n", 4
#: Characters of a key's texts above which they are spread over tasks.
LARGE = 16_000_000


def candidate_phrases(text: Column | str, most_words: int = MOST_WORDS, stop_words=W.TFIDF_STOP_WORDS) -> Column:
    """Runs of words, in lower case, that no stop word, mark or line's end parts; runs of more than most_words words and
    those without a letter are none. Repeats stay. One pass over the text's tokens."""
    tokens = F.regexp_extract_all(F.lower(T.col(text)), F.lit(TOKEN), 0)
    cut = F.transform(tokens, lambda t: F.when(t.rlike(r"^[\p{L}\p{N}_]") & ~t.isin(list(stop_words)), t).otherwise("|"))
    runs = F.transform(F.split(F.array_join(cut, " "), r"\|"), lambda p: F.trim(p))
    return F.filter(runs, lambda p: p.rlike(r"\p{L}") & (F.size(F.split(p, " ")) <= most_words))


def key_phrases(texts: DataFrame, most: int, most_words: int = MOST_WORDS, key: str = "syllabus_id") -> DataFrame:
    """texts(key, text) -> (key, rank, phrase, score, n): the phrases of the highest scores in all texts of a key.

    A word's frequency counts the candidates that hold it, repeats included; its degree sums their words. A phrase has the
    sum of degree over frequency of its words; equal scores go by the phrase, and only the first of a key are ranked.

    Texts are dealt by key once, and all else happens where they are. Of keys with more than LARGE characters, of which
    there can only be few, phrases and words are counted before they are dealt, each by itself.
    """
    large = F.broadcast(texts.groupBy(F.col(key).alias("of")).agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") > LARGE).select("of"))
    mine = F.col(key).eqNullSafe(F.col("of"))
    dealt = _words(texts.join(large, mine, "left_anti").repartition(key), most_words, key)
    own = Window.partitionBy(key, "word")
    dealt = dealt.withColumn("weight", F.sum(F.col("size") * F.col("n")).over(own) / F.sum("n").over(own))
    spread = _words(texts.join(large, mine, "left_semi"), most_words, key)
    weights = spread.groupBy(F.col(key).alias("of"), F.col("word").alias("w")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("weight"))
    spread = spread.join(weights, mine & (F.col("word") == F.col("w")))
    return _first(dealt, most, key).unionByName(_first(spread, most, key))


def _words(texts: DataFrame, most_words: int, key: str) -> DataFrame:
    found = texts.select(key, F.explode(candidate_phrases("text", most_words)).alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("n"))
    return found.select(key, "phrase", "n", F.explode(F.split("phrase", " ")).alias("word"), F.size(F.split("phrase", " ")).alias("size"))


def _first(words: DataFrame, most: int, key: str) -> DataFrame:
    scored = words.groupBy(key, "phrase", "n").agg(F.sum("weight").alias("score"))
    best = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(key, "rank", "phrase", "score", "n")
