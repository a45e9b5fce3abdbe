"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlark.llm import decontaminate, personal_data
from auditlark.llm.chat_format import rendered, repair_chats
from auditlark.llm.exact_dedup import exact_dedup
from auditlark.llm.mixing import mix
from auditlark.llm.ngram_join import ngram_join
from auditlark.llm.oracles import spelling_sql, vector_codes_sql, vector_dedup_sql
from auditlark.llm.quality import fit_quality, score_quality
from auditlark.llm.spelling import spelling_groups, word_counts
from auditlark.llm.token_counts import token_counts
from auditlark.llm.token_files import read_token_files, write_token_files
from auditlark.llm.toxicity import fit_toxicity, score_toxicity
from auditlark.llm.vector_codes import vector_codes
from auditlark.llm.vector_dedup import vector_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(repair_chats(_read(spark, sf_dir, "conversations")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents"), size=5, threshold=0.75).drop("set_digest")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), file="word_bpe_49k.json", limit=2048)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_read(spark, sf_dir, "documents"), file="byte_bpe_50k.json", end_id=0))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contract_columns(decontaminate.benchmark_matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.contract_columns(personal_data.find_personal_data(_read(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _read(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).drop("key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _read(spark, sf_dir, "labels")))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(_read(spark, sf_dir, "embeddings"), least=0.95)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(word_counts(_read(spark, sf_dir, "documents"), least_length=6, least_n=5, slips=199), factor=5)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_ngram_jaccard_join, op3_exact_dedup, op4_token_counts, op5_token_files,
    op6_decontamination, op7_personal_data, op8_quality, op9_mixing, op10_toxicity,
    op11_vector_dedup, op12_spelling_variants, op13_vector_codes,
)}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    # shingles as strings, links by counting, components by reachability
    "op2_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce({LOWER}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
        s AS (SELECT DISTINCT doc_id, unnest(g) AS h FROM g), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT DISTINCT a AS f, a AS t FROM e UNION SELECT r.f, e.b FROM r JOIN e ON r.t = e.a), c AS (SELECT f, min(t) AS c FROM r GROUP BY f)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON f = d.doc_id""",
    # equal after each run of blanks became one; RE2 classes are ASCII as the contract's
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    # windows of items against windows of documents of the same length
    "op6_decontamination": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
        k AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0), g AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM k),
        p AS (SELECT doc_id, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i, w FROM d, (SELECT DISTINCT n FROM g)), h AS (SELECT doc_id, p.n, i, item FROM p JOIN g ON g.n = p.n AND g.g = array_to_string(w[i:i + p.n - 1], ' ')),
        c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_vector_dedup": vector_dedup_sql(),
    "op12_spelling_variants": spelling_sql(),
    "op13_vector_codes": vector_codes_sql(),
}
