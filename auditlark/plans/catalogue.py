"""Registered queries. Each runs one operator over whole tables; its DuckDB statement is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.config import Config
from auditlark.functions import text as T
from auditlark.functions.lemmas import lemma
from auditlark.operators import chunk, evaluate, gates, grid, outputs, parse, phrases, rerank, retrieve, scope, store
from auditlark.operators.embed import HashedWords
from auditlark.operators.index import VectorIndex
from auditlark.plans import fixtures, oracle
from auditlark.sources.readers import read_pages, read_table

FLAGSHIP = "full_audit"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Vectors of the test tables are far from each other: thresholds fit their band.
BAND = Config(strong=0.36, partial=0.32, weak=0.28, boost_base=0.2, boost_high=(0.35, 0.12), boost_low=(0.30, 0.06), module_similarity=0.2, override_similarity=0.33, override_semantic=0.3, upgrade_semantic=0.3, scope_similarity=0.34)
VERBS = ["Define", "Explain", "Implement", "Compare", "Justify", "Design", "What is", "Why is", "How does", "Discuss"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# -- relations -----------------------------------------------------------------------------------------------------


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents and the curriculum fixtures."""
    own = spark.createDataFrame(list(fixtures.TEXTS.items()), "doc_id long, text string")
    return own.unionByName(read_table(spark, sf, "documents").select("doc_id", "text"))


def asked(number: Column, text: Column | str) -> Column:
    verbs = F.array(*(F.lit(v) for v in VERBS))
    return F.concat(F.element_at(verbs, (1 + F.pmod(number, F.lit(10))).cast("int")), F.lit(" "), F.replace(T.col(text), F.lit("\n"), F.lit(" ")))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select("item_id", asked(F.col("item_id"), "text").alias("question"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations")


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant's turn after them."""
    t = turns(spark, sf)
    reply = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chunk"))
    return t.where("role = 'user'").select("conv_id", "turn", asked(F.col("turn"), "text").alias("question")).join(reply, ["conv_id", "turn"])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as chunks: their label is the module and the syllabus, the document of the same id their text."""
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("Module "), F.col("label").cast("string")).alias("module"), F.col("label").alias("group"))
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return e.join(d, "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every embedding whose id is divisible by 50."""
    return vectors(spark, sf).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector", "group", asked(F.expr("chunk_id div 50"), "text").alias("question"))


def found(spark: SparkSession, sf: str, k: int = 8, grouped: bool = False) -> DataFrame:
    q, c = query_vectors(spark, sf), vectors(spark, sf)
    best = retrieve.top_k(q, c, k, grouped=grouped, apart=True)
    # few rows, k for each query, pick the texts they need
    return best.join(q.select("query_id", "question", F.col("group").alias("own_group")), "query_id").join(c.select("chunk_id", "module", "group", "text"), "chunk_id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = found(spark, sf)
    best = F.max("cosine").over(_by_query())
    return retrieve.scored(rows.withColumn("boost", retrieve.concept_boost(best, BAND)), BAND)


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, expected, predicted, score): labelled quality against a score of the text alone."""
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    distinct = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    score = F.round(F.size(distinct) / F.size(F.split(F.lower("text"), r"\s+")), 6)
    return d.select("doc_id", (F.col("quality") == 1).alias("expected"), (score >= 0.5).alias("predicted"), score.alias("score"), (F.col("n_chars") >= 400).alias("other"))


def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as stored chunks: the segment is the department, the nation key the semester."""
    c = read_table(spark, sf, "customer")
    code = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("PEC-IT", "OE-", "CS", "HSS-"))), (1 + F.col("c_custkey") % 4).cast("int")), (100 * (1 + F.col("c_custkey") % 8) + F.col("c_nationkey")).cast("string"), F.lit("b"))
    return c.select("c_custkey", F.initcap("c_mktsegment").alias("department"), F.concat((F.col("c_nationkey") % 13).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "th").otherwise("")).alias("semester"), code.alias("code"), "c_name", "c_nationkey")


# -- text ----------------------------------------------------------------------------------------------------------


@query
def bloom_conversations(spark, sf):
    level = T.bloom_level("text")
    return turns(spark, sf).where("role = 'user'").select("conv_id", "turn", level.alias("bloom_level"), T.difficulty(level).alias("difficulty"))


@query
def bloom_derived(spark, sf):
    level = T.bloom_level("question")
    return questions(spark, sf).select("item_id", level.alias("bloom_level"), T.difficulty(level).alias("difficulty"))


@query
def question_split(spark, sf):
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Intro text\nQ1. "), "text", F.lit(" Q2: Define DES.\nQ10. "), "role")).otherwise(F.col("text"))
    return turns(spark, sf).select("conv_id", "turn", F.posexplode(T.split_questions(raw)).alias("pos", "question"))


@query
def html_to_text(spark, sf):
    return read_pages(read_table(spark, sf, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def text_preview(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.preview("text").alias("preview"))


@query
def keyword_overlap(spark, sf):
    return exchanges(spark, sf).select("conv_id", "turn", F.round(T.keyword_overlap("question", "chunk"), 6).alias("overlap"))


@query
def highlight(spark, sf):
    return exchanges(spark, sf).select("conv_id", "turn", F.array_join(T.highlighted("question", "chunk"), " ").alias("marked"))


@query
def quality_gate(spark, sf):
    return texts(spark, sf).select("doc_id", T.is_low_information("text").alias("rejected"))


@query
def quality_counts(spark, sf):
    rows = turns(spark, sf).select("role", T.is_low_information("text").alias("rejected"))
    return rows.groupBy("role").agg(F.count_if("rejected").alias("n_rejected"), F.count_if(~F.col("rejected")).alias("n_kept"))


@query
def header_ratio(spark, sf):
    return texts(spark, sf).select("doc_id", F.round(T.header_ratio("text"), 6).alias("ratio"))


@query
def noisy_chunk(spark, sf):
    return texts(spark, sf).select("doc_id", T.is_noisy("text").alias("noisy"))


@query
def reference_entry(spark, sf):
    return texts(spark, sf).select("doc_id", T.is_reference_entry("text").alias("listed"))


@query
def normalise_text(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(T.normalise("text")).alias("text_md5"))


@query
def legacy_clean(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(T.clean_legacy("text")).alias("text_md5"))


@query
def doc_router(spark, sf):
    return texts(spark, sf).select("doc_id", T.document_type("text").alias("route"), T.document_format("text").alias("format"))


@query
def metadata_extract(spark, sf):
    return texts(spark, sf).select("doc_id", *(v.alias(k) for k, v in T.metadata("text").items()))


@query
def department_program(spark, sf):
    return texts(spark, sf).select("doc_id", T.department_of("text", F.when(F.col("doc_id") % 2 == 0, "PEC-CS601").otherwise("EE12")).alias("department"), T.program_of("text").alias("program"))


@query
def roman_semester(spark, sf):
    rows = catalog_rows(spark, sf)
    return rows.select("c_custkey", T.roman("semester").alias("semester"), T.semester_of_code("code").alias("inferred"), T.owner_of_code("code").alias("owner"), T.metadata_confidence("semester", T.semester_of_code("code")).alias("confidence"))


@query
def elective_type(spark, sf):
    return catalog_rows(spark, sf).select("c_custkey", T.elective_type("code", F.col("department")).alias("elective"))


@query
def syllabus_id(spark, sf):
    rows = catalog_rows(spark, sf)
    code = F.when(F.col("c_custkey") % 5 != 0, F.col("code"))
    return rows.select("c_custkey", T.syllabus_id("department", "semester", T.elective_type(code, F.lit("")), code).alias("syllabus_id"))


@query
def module_headings(spark, sf):
    return texts(spark, sf).select("doc_id", F.array_join(T.module_headings("text"), "|").alias("modules"), T.module_of_chunk("text").alias("own"))


# -- parsers -------------------------------------------------------------------------------------------------------


@query
def block_split(spark, sf):
    return parse.course_blocks(texts(spark, sf)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "block")


@query
def structured_lines(spark, sf):
    return parse.structured_lines(texts(spark, sf)).select("doc_id", F.col("course_no").cast("long").alias("course_no"), F.col("line_no").cast("long").alias("line_no"), "state", "content")


@query
def outcomes_parse(spark, sf):
    return parse.outcomes(parse.structured_lines(texts(spark, sf)))


@query
def copo_long(spark, sf):
    return parse.outcome_matrix(parse.structured_lines(texts(spark, sf)))


@query
def primary_po(spark, sf):
    return parse.primary_outcomes(parse.outcome_matrix(parse.structured_lines(texts(spark, sf))))


@query
def units_parse(spark, sf):
    return parse.units(parse.structured_lines(texts(spark, sf)))


@query
def structured_parse(spark, sf):
    rows = parse.structured_courses(texts(spark, sf))
    return rows.select("doc_id", "course_no", "subject_name", "subject_code", "semester", "department", "program", "subject_owner", "elective_type", "syllabus_id", "objectives", "references", F.array_join("warnings", "|").alias("warnings"), "co_count", "po_count", "module_count", "parser", "parser_confidence", "metadata_confidence")


@query
def legacy_parse(spark, sf):
    return parse.legacy_subjects(texts(spark, sf)).drop("modules")


@query
def segment_routes(spark, sf):
    return parse.segments(texts(spark, sf))


@query
def section_split(spark, sf):
    return texts(spark, sf).select("doc_id", F.posexplode(chunk.sections("text")).alias("pos", "s")).select("doc_id", "pos", "s.label", F.md5("s.body").alias("body_md5"))


@query
def sentence_pack(spark, sf):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    return read_table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.packed(chunk.sentences(flat), " ")).alias("pos", "piece"))


@query
def chunks(spark, sf):
    return chunk.chunks(texts(spark, sf))


# -- retrieval -----------------------------------------------------------------------------------------------------


@query
def topk_cosine(spark, sf):
    q, c = query_vectors(spark, sf), vectors(spark, sf)
    return retrieve.top_k(q, c, 8, apart=True).select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query
def vector_baseline(spark, sf):
    return retrieve.top_k(query_vectors(spark, sf), vectors(spark, sf), 1, apart=True).select("query_id", "chunk_id", F.round("cosine", 6).alias("score"))


@query
def index_search(spark, sf):
    """The same search through the inverted-file index, every cell probed."""
    with_index = VectorIndex.build(vectors(spark, sf).select("chunk_id", "vector"), store.scratch(spark, "index"))
    rows = with_index.search(query_vectors(spark, sf), 8, probes=len(with_index.centroids), apart=True)
    return rows.select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query
def index_recall(spark, sf):
    """What the cells that the index probes by default find of each question's eight nearest chunks."""
    with_index = VectorIndex.build(vectors(spark, sf).select("chunk_id", "vector"), store.scratch(spark, "index"))
    asked_ = query_vectors(spark, sf).select("query_id", "vector")
    best = with_index.exact(asked_, 8, apart=True).select("query_id", "chunk_id")
    mine = with_index.search(asked_, 8, apart=True).select("query_id", "chunk_id", F.lit(1).alias("found"))
    return best.join(mine, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("found") / F.count("*")).alias("recall"))


def embedded(rows: DataFrame, name: str) -> DataFrame:
    """Counts of words in so many slots that none collide."""
    return rows.select(F.col(name), HashedWords(2**60).vector(F.col("text")).alias("vector"))


@query
def embedded_documents(spark, sf):
    rows = embedded(texts(spark, sf), "doc_id")
    return rows.select("doc_id", F.size("vector.slots").cast("long").alias("n_distinct"), F.aggregate("vector.values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_words"), F.coalesce(F.array_max("vector.values"), F.lit(0.0)).cast("long").alias("most"))


@query
def word_search(spark, sf):
    """The three documents nearest to each benchmark item by the cosine of word counts, every document compared."""
    items = embedded(read_table(spark, sf, "benchmark").where("text is not null"), "item_id").withColumnRenamed("item_id", "query_id")
    found_ = grid.top_k(items, embedded(texts(spark, sf), "doc_id").withColumnRenamed("doc_id", "chunk_id"), 3)
    return found_.select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query
def map_co(spark, sf):
    """The nearest outcome of the question's own syllabus, with the halved distance as similarity."""
    best = retrieve.top_k(query_vectors(spark, sf), vectors(spark, sf), 1, grouped=True, apart=True)
    return best.select("query_id", F.col("chunk_id").alias("co"), F.round(F.greatest(F.lit(0.0), 1 - (1 - F.col("cosine")) / 2), 6).alias("similarity"))


@query
def co_to_po(spark, sf):
    """Orders as outcomes of their customers, their suppliers as labels, in either case."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("syllabus_id"), F.concat(F.lit("co"), F.col("o_orderkey").cast("string")).alias("mapped_co"), "o_orderkey", "o_orderpriority")
    label = F.concat(F.lit("PO"), (F.col("l_suppkey") % 12).cast("string"))
    known = read_table(spark, sf, "lineitem").join(o.where("o_orderpriority <> '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return store.labelled(o.select("syllabus_id", "mapped_co"), known.select("syllabus_id", F.upper("mapped_co").alias("co"), label.alias("po")))


@query
def hybrid_score(spark, sf):
    rows = scored(spark, sf)
    return rows.select("query_id", "chunk_id", *(F.round(c, 6).alias(c) for c in ("semantic", "keyword", "boost", "similarity")))


@query
def match_gates(spark, sf):
    top = scored(spark, sf).groupBy("query_id").agg(F.round(F.max("similarity"), 6).alias("top"))
    scoped = F.col("query_id") % 100 == 0
    passes = gates.gate_passes("top", 0.2, BAND)
    return top.select("query_id", gates.match_strength("top", BAND).alias("strength"), gates.match_type("top", scoped, BAND).alias("type"), passes.alias("passed"), gates.similarity_band(F.col("top") * 2).alias("band"), gates.verdict(passes, scoped, F.col("top") * 2).alias("verdict"))


@query
def batch_summary(spark, sf):
    rows = match_gates(spark, sf)
    return rows.agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("in", "borderline", "out")), F.count("*").alias("n"))


@query
def dedup_chunks(spark, sf):
    rows = rerank.collected(scored(spark, sf)).select("query_id", rerank.deduplicated("chunks").alias("kept"))
    return rows.select("query_id", F.array_join(F.transform("kept", lambda x: x["chunk_id"].cast("string")), ",").alias("kept"))


@query
def gap_filter(spark, sf):
    rows = rerank.collected(scored(spark, sf)).select("query_id", rerank.gap_filtered("chunks").alias("kept"))
    return rows.select("query_id", F.array_join(F.transform("kept", lambda x: x["chunk_id"].cast("string")), ",").alias("kept"))


@query
def modules_detected(spark, sf):
    rows = rerank.collected(scored(spark, sf))
    return rows.select("query_id", F.array_join(rerank.modules_of("chunks", BAND), ",").alias("modules"))


@query
def tfidf_weights(spark, sf):
    rows = retrieve.tfidf(read_table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return rows.select(F.col("id").alias("item_id"), "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_baseline(spark, sf):
    """The highest TF-IDF cosine of each question with any chunk."""
    rows = retrieve.tfidf_scores(query_vectors(spark, sf), vectors(spark, sf), apart=True)
    return rows.select("query_id", F.round("score", 6).alias("score"))


@query
def pairwise_jaccard(spark, sf):
    """Of the few chunks found for each question, all pairs with the Jaccard similarity of their keywords."""
    rows = found(spark, sf).select("query_id", "chunk_id", T.keywords("text").alias("bag"))
    a, b = rows.select("query_id", F.col("chunk_id").alias("a"), F.col("bag").alias("left")), rows.select("query_id", F.col("chunk_id").alias("b"), F.col("bag").alias("right"))
    score = F.when((F.size("left") == 0) | (F.size("right") == 0), 0.0).otherwise(F.size(F.array_intersect("left", "right")) / F.size(F.array_union("left", "right")))
    return a.join(b, "query_id").where("a < b").select("query_id", "a", "b", F.round(score, 6).alias("jaccard"))


@query
def evidence_report(spark, sf):
    rows = found(spark, sf).withColumn("similarity", F.col("cosine"))
    return evaluate.evidence(rows, accept=0.3, least=2, curve=0.65)


# -- decisions -----------------------------------------------------------------------------------------------------


@query
def question_types(spark, sf):
    rows = questions(spark, sf)
    return rows.select("item_id", T.question_type("question").alias("type"), F.array_join(T.core_terms("question"), ",").alias("terms"))


@query
def topic_present(spark, sf):
    return exchanges(spark, sf).select("conv_id", "turn", T.topic_present("question", "chunk").alias("present"))


@query
def external_domain(spark, sf):
    rows = exchanges(spark, sf).withColumn("question", F.concat("question", F.when(F.col("conv_id") % 3 == 0, " on Docker and hadoop").when(F.col("conv_id") % 3 == 1, " with a neural network").otherwise("")))
    chunk_text = F.concat("chunk", F.when(F.col("turn") % 4 == 0, " docker").otherwise(""))
    return rows.select("conv_id", "turn", T.external_domain("question", chunk_text).alias("domain"))


@query
def decision_cascade(spark, sf):
    rows = gates.decided(rerank.collected(scored(spark, sf)), 0.28, c=BAND)
    return rows.select("query_id", "question_type", "in_syllabus", "decision", "justification", "decided_module")


@query
def scope_overlap(spark, sf):
    """Questions against the concepts of the exchange's own language group (a syllabus for every ten turns)."""
    rows = exchanges(spark, sf)
    q = rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("syllabus_id"), "question")
    concepts = questions(spark, sf).select(F.concat(F.lit("s"), (F.col("item_id") % 6).cast("string")).alias("syllabus_id"), F.col("question").alias("concept"))
    return scope.concept_overlap(q, concepts).select("query_id", F.round("overlap", 6).alias("overlap"))


@query
def frequent_concepts(spark, sf):
    rows = read_table(spark, sf, "documents").select(F.col("lang").alias("syllabus_id"), "text")
    return scope.frequent_concepts(rows, 20).select("syllabus_id", F.col("rank").cast("long").alias("rank"), "concept", "n")


@query
def scope_concepts(spark, sf):
    rows = read_table(spark, sf, "documents").select(F.col("lang").alias("syllabus_id"), "text")
    return scope.scope_concepts(rows).select("syllabus_id", F.col("rank").cast("long").alias("rank"), "concept")


@query
def full_audit(spark, sf):
    """Every verb, refusals by scope, a judge that says yes to questions of even length, and every gate."""
    rows = scored(spark, sf)
    overlap = F.pmod(F.expr("query_id div 50"), F.lit(7)) / 7
    scope_ = rows.select("query_id").distinct().select("query_id", overlap.alias("overlap"))
    said = F.when(F.length("question") % 2 == 0, F.lit("DECISION: YES\nJUSTIFICATION: A unit covers it in depth.\nMODULE: Module 3")).otherwise("DECISION: NO\nJUSTIFICATION: No unit covers it in depth.")
    found_ = gates.audited(rows, 0.2, scoped=True, scope=scope_, judge=lambda asked_: asked_.withColumn("reply", said), c=BAND)
    ids = F.array_join(F.transform("top_chunks", lambda x: x["chunk_id"].cast("string")), ",")
    return found_.withColumn("top_chunks", ids)


# -- store ---------------------------------------------------------------------------------------------------------


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_rows(spark, sf).select(
        F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("syllabus_id"), F.col("c_custkey").alias("chunk_no"), "department", "semester", F.col("code").alias("subject_code"), F.col("c_name").alias("subject_name"), F.lit("CORE").alias("elective_type"),
        F.when(F.col("c_custkey") % 7 == 0, "Unknown").otherwise(F.concat(F.lit("M"), (F.col("c_custkey") % 5).cast("string"))).alias("module"),
    )


@query
def ingestion_summary(spark, sf):
    """Customers as chunks of subjects, one for each account name: counts by semester, by department and of all."""
    return store.summary(stored_chunks(spark, sf).withColumn("syllabus_id", F.concat("syllabus_id", F.lit("-"), (F.col("chunk_no") % 40).cast("string"))))


def detected_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents whose subject was detected: some name a syllabus that isn't stored, with a code that may be."""
    return catalog_rows(spark, sf).select("c_custkey", F.concat(F.lit("s"), (F.col("c_custkey") % 40).cast("string")).alias("syllabus_id"), F.lower("code").alias("subject_code"))


@query
def subject_options(spark, sf):
    return store.matched_option(detected_subjects(spark, sf), store.registry(stored_chunks(spark, sf))).select("c_custkey", "option")


@query
def subject_of_question(spark, sf):
    return store.with_subject(detected_subjects(spark, sf).select("c_custkey", "syllabus_id"), store.registry(stored_chunks(spark, sf)))


@query
def registry(spark, sf):
    rows = stored_chunks(spark, sf)
    return store.registry(rows).withColumn("modules", F.array_join("modules", ","))


@query
def hierarchy(spark, sf):
    """Regions as departments, nations as semesters, suppliers as subjects."""
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    s = read_table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = store.hierarchy(s.select(F.col("r_name").alias("department"), F.col("n_name").alias("semester"), F.col("s_suppkey").cast("string").alias("syllabus_id"), F.col("s_name").alias("subject_name")))
    flat = rows.select("department", F.explode("semesters").alias("x")).select("department", F.col("x.semester").alias("semester"), F.array_join(F.transform("x.subjects", lambda y: y["syllabus_id"]), ",").alias("subjects"))
    return flat


@query
def distinct_departments(spark, sf):
    return catalog_rows(spark, sf).select("department").distinct().orderBy("department")


@query
def already_ingested(spark, sf):
    """Customers are subjects; those with an urgent order are stored, the others are still to be."""
    subjects = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("syllabus_id"))
    return store.absent(subjects, read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("syllabus_id")))


@query
def chunks_by_module(spark, sf):
    rows = catalog_rows(spark, sf).select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("syllabus_id"), F.col("c_custkey").alias("chunk_no"), F.col("c_name").alias("text"), F.when(F.col("c_custkey") % 7 > 1, F.concat(F.lit("M"), (F.col("c_custkey") % 5).cast("string"))).when(F.col("c_custkey") % 7 == 1, "").alias("module"))
    return store.by_module(rows).select("module", F.col("nth").cast("long").alias("nth"), "syllabus_id", "chunk_no")


@query
def dedup_insert(spark, sf):
    o = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("course_code"), F.col("l_linenumber").cast("string").alias("full_co"))
    stored = o.where("cast(course_code as int) <= 20")
    return store.outcome_insert(stored, o).select("course_code", "full_co")


# -- evaluation ----------------------------------------------------------------------------------------------------


@query
def confusion_matrix(spark, sf):
    return evaluate.metrics(evaluate.confusion(results(spark, sf)))


@query
def threshold_sweep(spark, sf):
    return evaluate.threshold_sweep(results(spark, sf))


@query
def best_threshold(spark, sf):
    return evaluate.best_threshold(evaluate.threshold_sweep(results(spark, sf)))


@query
def mcnemar(spark, sf):
    rows = results(spark, sf).select((F.col("predicted") == F.col("expected")).alias("first"), (F.col("other") == F.col("expected")).alias("second"))
    return evaluate.mcnemar(rows).withColumn("p_value", F.round("p_value", 9))


@query
def error_report(spark, sf):
    return evaluate.error_report(results(spark, sf)).select("doc_id", "expected", "predicted", "score", "diagnosis")


# -- pastes and reports --------------------------------------------------------------------------------------------


@query
def pasted_outcomes(spark, sf):
    """Parts as outcomes, their brand's number as label."""
    number = F.regexp_extract("p_brand", "([0-9]+)", 1)
    raw = F.concat(F.lit("co1: "), "p_name", F.lit("\n CO2 - PO"), number, F.lit("\nnothing\nCO3 – "), "p_type")
    cos, pos = outputs.pasted_outcomes(raw)
    flat = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat(x["co"], F.lit("="), x[f])), "|")
    return read_table(spark, sf, "part").select("p_partkey", flat(cos, "text").alias("cos"), flat(pos, "po").alias("pos"))


@query
def compiled_modules(spark, sf):
    """Conversations as syllabi: each turn is a module with its role as title; system turns are left empty."""
    module = F.struct("turn", F.col("role").alias("title"), F.when(F.col("role") == "system", " ").otherwise(F.col("text")).alias("content"))
    rows = turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(module)).alias("modules"))
    return rows.select("conv_id", F.md5(outputs.compiled_modules("modules")).alias("text_md5"))


@query
def distinct_texts(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    return outputs.distinct_texts(d, "source", "doc_id").select("doc_id", "source")


@query
def question_bank(spark, sf):
    """Pages as modules: a reply made of their addresses."""
    reply = F.concat(F.lit("IN_SYLLABUS:\n1. Explain "), "url", F.lit("\n2. short\nfree line that is no item\nOUT_OF_SYLLABUS:\n1) Compare page "), F.col("page_id").cast("string"), F.lit(" with others\n"))
    rows = outputs.question_bank(read_table(spark, sf, "pages").select(F.col("page_id").alias("module"), reply.alias("reply")))
    return rows.select("module", "question", "expected")


@query
def keyword_baseline(spark, sf):
    """The best share of a question's words of three signs and more among the chunks found for it, as its DuckDB
    statement has it; keyword_baseline_all takes all chunks."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z0-9]{3,}$")))
    share = F.when(F.size(words("question")) == 0, 0.0).otherwise(F.size(F.array_intersect(words("question"), words("text"))) / F.size(words("question")))
    return found(spark, sf).select("query_id", share.alias("s")).groupBy("query_id").agg(F.round(F.max("s"), 6).alias("score"))


@query
def keyword_baseline_all(spark, sf):
    """The best share of a question's words that any chunk has, without stop words."""
    rows = retrieve.keyword_scores(query_vectors(spark, sf), vectors(spark, sf), apart=True)
    return rows.select("query_id", F.round("score", 6).alias("score"))


@query
def keyword_baseline_lemmas(spark, sf):
    """keyword_baseline_all over base forms of words."""
    rows = retrieve.keyword_scores(query_vectors(spark, sf), vectors(spark, sf), apart=True, lemma=lemma)
    return rows.select("query_id", F.round("score", 6).alias("score"))


@query
def base_forms(spark, sf):
    """The distinct words of the benchmark and their base forms."""
    words = read_table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", lemma("word").alias("lemma"))


@query
def key_phrases(spark, sf):
    """The five key phrases of each text."""
    rows = phrases.key_phrases(texts(spark, sf), 5, key="doc_id")
    return rows.select("doc_id", F.col("rank").cast("long").alias("rank"), "phrase", F.round("score", 6).alias("score"), "n")


@query
def compared_baselines(spark, sf):
    rows = results(spark, sf)
    one = rows.select(F.lit("distinct words").alias("name"), "expected", "predicted", (F.col("doc_id") % 7 / 1000).alias("seconds"))
    two = rows.select(F.lit("length").alias("name"), "expected", F.col("other").alias("predicted"), (F.col("doc_id") % 3 / 1000).alias("seconds"))
    return outputs.compared_baselines(one.unionByName(two))


@query
def similarity_percent(spark, sf):
    return scored(spark, sf).select("query_id", "chunk_id", gates.percent(F.round("similarity", 6)).alias("percent"))


ORACLE = oracle.STATEMENTS
