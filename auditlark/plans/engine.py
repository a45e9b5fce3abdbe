"""The engine: one method per service of the audit, taking and returning DataFrames."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS, Config
from auditlark.functions import text as T
from auditlark.operators import chunk, gates, grid, parse, retrieve, scope, store
from auditlark.operators.embed import Embedder, HashedWords
from auditlark.operators.index import VectorIndex


class NoInput(ValueError):
    """Nothing to work on."""


class CurriculumEngine:
    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, judge=None, config: Config = DEFAULTS, phrases: Callable[[Column], Column] | None = None):
        """phrases: further concepts of a text as an array column, such as phrases.candidate_phrases."""
        self.phrases = phrases
        self.spark, self.store, self.config, self.judge = spark, store.Store(spark, folder), config, judge
        self.embedder = embedder or HashedWords()

    # -- ingestion -------------------------------------------------------------------------------------------------

    def parse_curriculum(self, docs: DataFrame, parse_id: str | None = None) -> tuple[str, DataFrame]:
        """Parse and stage docs(doc_id, text); returns the stage's id and its preview.

        Segments without a code have the digest of their text in their id. Of several texts with one code in a batch
        the one of the smallest digest has the plain id, the others have their digest in it too.
        """
        rows = parse.segments(docs.where("text is not null and text <> ''").withColumn("doc_id", F.col("doc_id").cast("string")))
        coded = F.coalesce("subject_code", F.lit("")) != ""
        rows = rows.withColumn("digest", F.upper(F.md5("text"))).withColumn("nth", F.when(coded, F.expr("dense_rank() over (partition by syllabus_id order by digest)")).otherwise(0))
        rows = rows.withColumn("syllabus_id", F.when(F.col("nth") == 1, F.col("syllabus_id")).otherwise(F.concat_ws("-", "syllabus_id", "digest"))).drop("digest", "nth")
        if parse_id is None:
            whole = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.col("doc_id").cast("string"), "text").cast("decimal(38,0)")), F.lit(0)).alias("sum")).first()
            parse_id = hashlib.md5(f"{whole.n} {whole.sum}".encode()).hexdigest()
        self.store.append("staged", rows.withColumn("parse_id", F.lit(parse_id)))
        known = self.store.read("chunks").select("syllabus_id").distinct().withColumn("already_ingested", F.lit(True))
        staged = self.store.read("staged").where(F.col("parse_id") == parse_id).join(known, "syllabus_id", "left")
        return parse_id, staged.select("syllabus_id", "subject_name", "subject_code", "semester", "department", "program", "elective_type", "route", T.preview("text").alias("text_preview"), F.coalesce("already_ingested", F.lit(False)).alias("already_ingested"))

    def ingest_selected(self, parse_id: str, syllabus_ids: list[str] | None = None) -> DataFrame:
        """Chunk, filter and store the staged subjects (all, or those selected) that aren't stored; returns counts."""
        staged = self.store.read("staged").where(F.col("parse_id") == parse_id)
        if not staged.limit(1).count():
            raise NoInput(f"no stage {parse_id}")
        if syllabus_ids is not None:
            staged = staged.where(F.col("syllabus_id").isin(syllabus_ids))
        run = uuid.uuid4().hex
        # what is new is decided once: the parse, the chunks and the ledger see the same rows
        new = self.store.new_only(staged.dropDuplicates(["syllabus_id"])).select("syllabus_id")
        self.store.append("ingested", new.select("syllabus_id", F.lit(parse_id).alias("parse_id"), F.lit(run).alias("run")))
        mine = self.store.read("ingested").where(F.col("run") == run).select("syllabus_id")
        fresh = staged.dropDuplicates(["syllabus_id"]).join(mine, "syllabus_id", "left_semi")
        about = ["syllabus_id", "department", "semester", "subject_code", "subject_name", "elective_type"]
        pieces = chunk.chunks(fresh.select(F.col("syllabus_id").alias("doc_id"), "text"), self.config).withColumnRenamed("doc_id", "syllabus_id")
        pieces = pieces.where(~T.is_reference_entry("text", self.config) & ~T.is_low_information("text", self.config))
        pieces = pieces.withColumn("chunk_no", F.expr("cast(row_number() over (partition by syllabus_id order by chunk_no) - 1 as int)"))
        rows = pieces.join(fresh.select(*about), "syllabus_id")
        concepts = scope.scope_concepts(fresh.select("syllabus_id", "text"), self.config, self.phrases)
        found = parse.structured_lines(fresh.select(F.col("syllabus_id").alias("doc_id"), "text"))
        codes = fresh.select(F.col("syllabus_id").alias("doc_id"), F.coalesce("subject_code", F.lit("")).alias("course_code"))
        cos = parse.outcomes(found).join(codes, "doc_id").select(F.col("doc_id").alias("syllabus_id"), "course_code", "co", F.concat_ws(".", "course_code", "co").alias("full_co"), "text")
        pos = parse.primary_outcomes(parse.outcome_matrix(found)).select(F.col("doc_id").alias("syllabus_id"), F.upper("co").alias("co"), F.upper("po").alias("po"), F.lit(None).cast("int").alias("strength"))
        # concepts and outcomes first: a subject is stored, and so skipped later, only once its chunks are
        self.store.replace("concepts", concepts)
        self.store.replace("outcomes", cos)
        self.store.replace("outcome_map", pos)
        self.store.replace(store.VECTORS + self.embedder.name, rows.select("syllabus_id", "chunk_no", self.embedder.vector(F.col("text"), "passage").alias("vector")))
        self.store.append("chunks", rows)
        if syllabus_ids is not None:
            return self.store.registry().where(F.col("syllabus_id").isin(syllabus_ids))
        return self.store.registry().join(mine, "syllabus_id", "left_semi")

    def ingest_syllabus(self, docs: DataFrame) -> DataFrame:
        parse_id, _ = self.parse_curriculum(docs)
        return self.ingest_selected(parse_id)

    def list_syllabi(self, department: str = "", semester: str = "") -> DataFrame:
        given = lambda c, v: F.lit(v == "") | (F.col(c) == v)
        return self.store.registry().where(given("department", department) & given("semester", semester))

    def departments(self) -> list[str]:
        return [r[0] for r in self.store.registry().select("department").where("department is not null").distinct().orderBy("department").collect()]

    def summary(self) -> DataFrame:
        """Counts of subjects, modules and chunks by semester, by department and of all."""
        return store.summary(self.store.read("chunks"))

    def hierarchy(self) -> DataFrame:
        return store.hierarchy(self.store.registry())

    def delete_syllabus(self, syllabus_id: str) -> None:
        self.store.delete(syllabus_id)

    def purge_all(self) -> int:
        return self.store.purge()

    def reset_vectors(self) -> None:
        """Chunks go with their vectors; indexes answer only for stored chunks."""
        self.store.reset("chunks", *(t for t in self.store.tables() if t.startswith(store.VECTORS)))

    # -- vectors ---------------------------------------------------------------------------------------------------

    def embedded(self, chunks: DataFrame) -> DataFrame:
        """Stored chunks with chunk_id and their stored vectors; those that have none of this embedder are embedded here."""
        made = self.embedder.vector(F.col("text"), "passage")
        kind = chunks.select(made.alias("vector")).dtypes[0][1]
        stored = self.store.vectors(self.embedder.name, kind).withColumnRenamed("vector", "stored")
        rows = chunks.join(stored, ["syllabus_id", "chunk_no"], "left").withColumn("chunk_id", F.xxhash64("syllabus_id", "chunk_no"))
        return rows.withColumn("vector", F.coalesce("stored", made)).drop("stored")

    def build_index(self, cells: int | None = None) -> VectorIndex:
        """A new version of the inverted-file index over all stored chunks."""
        rows = self.embedded(self.store.read("chunks")).select("chunk_id", "vector")
        return VectorIndex.build(rows, self.store.path(store.INDEX + self.embedder.name), cells)

    def index(self) -> VectorIndex | None:
        return VectorIndex.open(self.spark, self.store.path(store.INDEX + self.embedder.name))

    def nearest(self, queries: DataFrame, chunks: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """grid.top_k over embedded(chunks): in full, or in so many cells of the index (0: as many as it measured), if there
        is one."""
        index = None if probes is None else self.index()
        if index is None:
            return grid.top_k(queries, chunks, k)
        return index.search(queries, k, probes or None, among=chunks)

    # -- audit -----------------------------------------------------------------------------------------------------

    def detect_subject(self, docs: DataFrame) -> DataFrame:
        """Metadata of each document's head; the nearest chunk's subject overrides it if it is near enough."""
        about = T.metadata("text")
        heads = docs.select("doc_id", *(v.alias(k) for k, v in about.items()), self.embedder.vector(F.substring("text", 1, 1000), "query").alias("vector")).withColumn("query_id", F.xxhash64("doc_id"))
        chunks = self.embedded(self.store.read("chunks"))
        near = retrieve.top_k(heads, chunks, 1).where((1 - F.col("cosine")) < self.config.detect_distance)
        named = near.join(chunks.select("chunk_id", F.col("subject_name").alias("s"), F.col("subject_code").alias("c"), F.col("semester").alias("m"), F.col("department").alias("d"), "syllabus_id"), "chunk_id")
        out = heads.join(named, "query_id", "left")
        return out.select("doc_id", "syllabus_id", F.coalesce("s", "subject_name").alias("subject_name"), F.coalesce("c", "subject_code").alias("subject_code"), F.coalesce("m", "semester").alias("semester"), F.coalesce("d", "department").alias("department"), "program", "bos")

    def _boosts(self, asked: DataFrame, chunks: DataFrame) -> DataFrame:
        """asked(query_id, question) -> (query_id, boost): by the best cosine of a question's concept with any concept
        of the syllabus' chunks; questions without concepts have no row."""
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), " ")
        known = chunks.groupBy("syllabus_id").agg(text.alias("text")).select(F.explode(scope.concepts_of("text", phrases=self.phrases)).alias("concept")).distinct()
        known = known.select(F.xxhash64("concept").alias("chunk_id"), self.embedder.vector(F.col("concept"), "passage").alias("vector"))
        own = asked.select("query_id", F.explode(scope.concepts_of("question", phrases=self.phrases)).alias("concept"))
        sought = own.select("concept").distinct().select(F.xxhash64("concept").alias("query_id"), self.embedder.vector(F.col("concept"), "query").alias("vector"))
        near = retrieve.top_k(sought, known, 1).select(F.col("query_id").alias("key"), "cosine")
        best = own.select("query_id", F.xxhash64("concept").alias("key")).join(near, "key").groupBy("query_id").agg(F.max("cosine").alias("best"))
        return best.select("query_id", retrieve.concept_boost("best", self.config).alias("boost"))

    def _outcomes(self, asked: DataFrame, syllabus_id: str | None) -> DataFrame:
        """asked(query_id, vector) -> (query_id, mapped_co, mapped_co_full, mapped_po): the nearest outcome, of the
        syllabus if there is one, and then its label."""
        cos = self.store.read("outcomes")
        if syllabus_id is not None:
            cos = cos.where(F.col("syllabus_id") == syllabus_id)
        cos = cos.withColumn("chunk_id", F.xxhash64("syllabus_id", "course_code", "co", "text"))
        near = retrieve.top_k(asked, cos.select("chunk_id", self.embedder.vector(F.col("text"), "passage").alias("vector")), 1).select("query_id", "chunk_id")
        mapped = near.join(cos.dropDuplicates(["chunk_id"]), "chunk_id").select("query_id", "syllabus_id", F.col("co").alias("mapped_co"), F.col("full_co").alias("mapped_co_full"))
        if syllabus_id is None:
            return mapped.select("query_id", "mapped_co", "mapped_co_full", F.lit(None).cast("string").alias("mapped_po"))
        return store.labelled(mapped, self.store.read("outcome_map")).select("query_id", "mapped_co", "mapped_co_full", "mapped_po")

    def analyze_questions(self, pastes: DataFrame, syllabus_id: str | None = None, threshold: float | None = None, probes: int | None = None) -> DataFrame:
        """pastes(paste_id, text) -> one result row per question in them.

        probes: look only into so many cells of the index that build_index() made, 0 for as many as reach its recall;
        without a syllabus, which is searched in full in any case.
        """
        questions = pastes.select("paste_id", F.posexplode(T.split_questions("text")).alias("pos", "question"))
        return self.analyze_split(questions, syllabus_id, threshold, probes)

    def analyze_split(self, questions: DataFrame, syllabus_id: str | None = None, threshold: float | None = None, probes: int | None = None) -> DataFrame:
        """analyze_questions for questions(paste_id, pos, question) that are split already."""
        questions = questions.select("paste_id", "pos", "question").withColumn("query_id", F.xxhash64("paste_id", "pos"))
        chunks = self.store.read("chunks")
        if syllabus_id is not None:
            chunks = chunks.where(F.col("syllabus_id") == syllabus_id)
        chunks = self.embedded(chunks)
        asked = questions.select("query_id", "question", self.embedder.vector(F.col("question"), "query").alias("vector"))
        near = self.nearest(asked, chunks, self.config.retrieval_k, probes if syllabus_id is None else None)
        found = near.join(asked.drop("vector"), "query_id").join(chunks.select("chunk_id", "text", "module"), "chunk_id")
        # a chunk stored without a module is named by its own words
        found = found.withColumn("module", F.coalesce(F.nullif("module", F.lit("")), T.module_of_chunk("text")))
        gate = None
        if syllabus_id is not None:
            found = found.join(self._boosts(asked, chunks), "query_id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
            gate = scope.concept_overlap(asked.select("query_id", F.lit(syllabus_id).alias("syllabus_id"), "question"), self.store.read("concepts"), None if getattr(self.embedder, "literal", False) else self.embedder, self.config)
        rows = retrieve.scored(found, self.config)
        # gates see the boost that was applied
        rows = rows.withColumn("boost", F.when(retrieve.base_score("semantic", "keyword", self.config) > self.config.boost_base, F.col("boost")).otherwise(0.0))
        result = gates.audited(rows, threshold if threshold is not None else self.config.user_threshold, syllabus_id is not None, gate, self.judge, self.config)
        # questions for which nothing was found are answered too
        level = T.bloom_level("asked")
        nothing = {
            "question": F.col("asked"), "similarity": F.lit(0.0), "match_strength": F.lit("NO_MATCH"), "match_type": F.lit("OUT_OF_CURRICULUM"), "gatekeeper_passed": F.lit(False), "is_in_syllabus": F.lit(False), "bloom_level": level,
            "difficulty": T.difficulty(level), "modules": F.lit(""), "question_type": T.question_type("asked"), "decision": F.lit("NO"), "justification": F.lit(gates.GATE_FAILED), "n_chunks": F.lit(0).cast("long"),
            "retrieval_status": F.lit("NO_MATCH"), "scope_rejected": F.lit(False), "top_chunks": F.array().cast(dict(result.dtypes)["top_chunks"]),
            **{label: F.lit(0.0) for label in gates.DIAGNOSTICS.values()},
        }
        out = questions.select("paste_id", "pos", "query_id", F.col("question").alias("asked")).join(result, "query_id", "left")
        out = out.withColumns({k: F.coalesce(k, v) for k, v in nothing.items()}).drop("asked")
        out = out.join(self._outcomes(asked, syllabus_id), "query_id", "left")
        # a question out of scope is mapped to no outcome
        return out.withColumns({k: F.when(~F.col("scope_rejected"), F.col(k)) for k in ("mapped_co", "mapped_co_full", "mapped_po")})
