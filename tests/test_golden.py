"""Golden cases of the audit's operators."""

import functools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS
from auditlark.functions import text as T
from auditlark.functions import words as W
from auditlark.operators import chunk, evaluate, gates, grid, parse, rerank, retrieve, scope, store
from auditlark.operators.embed import zero_safe_cosine
from auditlark.plans import fixtures


def values(spark, column, items, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bloom_of_every_verb(spark):
    """Each verb alone gives its level, in any case and place; of two the higher one counts; part of a word is none."""
    levels = list(reversed(W.BLOOM_ORDER))
    verbs = [(v, level) for level in levels for v in W.BLOOM_VERBS[level]]
    asked = [f"{lead}{v.upper() if i % 3 == 0 else v} the dyes{end}" for i, (v, _) in enumerate(verbs) for lead, end in (("", "."), ("5) Please, ", ""), (" \t", " by hand?"))]
    assert values(spark, T.bloom_level, asked) == [level for _, level in verbs for _ in range(3)]
    pairs = [(a, b) for i, a in enumerate(levels) for b in levels[i + 1 :]]
    assert values(spark, T.bloom_level, [f"{W.BLOOM_VERBS[a][0]} and {W.BLOOM_VERBS[b][1]} the dyes" for a, b in pairs]) == [b for _, b in pairs]
    assert values(spark, T.bloom_level, [f"x{v}x the dyes" for v, _ in verbs]) == ["Unknown"] * len(verbs)


def test_bloom_of_question_forms(spark):
    """Without a verb the first question form decides."""
    cases = {"whY blue": "Evaluate", "drawbacks and a drawback": "Evaluate", "indigo vs madder": "Analyze", "how can it fade": "Analyze", "what are the kinds of mordant": "Understand", "a short note on woad": "Understand", "what was woad": "Remember", "where": "Remember", "wherever": "Unknown", "ÉTÉ": "Unknown", "": "Unknown"}
    assert values(spark, T.bloom_level, list(cases)) == list(cases.values())
    assert values(spark, T.difficulty, [*W.BLOOM_ORDER, "Unknown"]) == ["Hard", "Hard", "Medium", "Medium", "Easy", "Easy", "Unknown"]


def test_router_and_format(spark):
    cases = {
        "Course Title: A\nx\nCourse Name: B": "MULTI_SUBJECT_CURRICULUM", "Course Title: A": "STRUCTURED_SUBJECT", "Course Outcomes: x\nCO-PO Mapping: y": "STRUCTURED_SUBJECT",
        "Semester VIII\nModule 1: x": "LEGACY_SUBJECT", "CO-PO Mapping": "STRUCTURED_SUBJECT",
    }
    assert values(spark, T.document_type, list(cases)) == list(cases.values())
    assert values(spark, T.document_format, ["Syllabus and Curricular Mapping, Course Objectives, Course Outcomes, CO-PO Mapping", "Subject Code: PEC-IT801B", "Random text"]) == ["AICTE", "SINGLE", "UNKNOWN"]


def test_splitter(spark):
    rows = parse.course_blocks(docs(spark, "pre\nCourse Title: A\nx\nCourse Title: B\ny", "no title", "", None)).orderBy("doc_id", "block_no").collect()
    assert [(r.doc_id, r.block) for r in rows] == [(0, "Course Title: A\nx"), (0, "Course Title: B\ny")]


def test_roman_and_ids(spark):
    assert values(spark, T.roman, ["8", "8th", "VIII", "eight", "0", "Unknown", "39"]) == ["VIII", "VIII", "VIII", "VIII", "?", "UNK", "XXXIX"]
    row = spark.createDataFrame([("Information Technology", "VIII", "PEC")], "d string, s string, e string")
    got = row.select(T.syllabus_id("d", "s", "e", F.lit("PEC-IT801B")), T.syllabus_id("d", "s", "e", F.lit("IT801B"))).first()
    assert tuple(got) == ("IT-VIII-PEC-IT801B", "IT-VIII-PEC-IT801B")


def test_structured_parser(spark):
    (r,) = parse.structured_courses(docs(spark, fixtures.STRUCTURED)).collect()
    assert (r.subject_name, r.subject_code, r.semester, r.department) == ("Tidal Surveying", "OE-CE514C", "V", "Civil Engineering")
    assert r.objectives == "To tell the shore from the sea." and r.references == "Tide tables of the harbour office\nMarsh, Levels and Staffs" and r.warnings == []
    # outcomes are numbered by place; a line without a number continues one
    assert [(o.co, o.text, o.bloom_level) for o in r.outcomes] == [("CO1", "Sketch how a sounding plan of a river mouth is laid out", "Create"), ("CO2", "Appraise a tide table", "Evaluate"), ("CO3", "Construct a gauge", "Create")]
    # cells stand under the labels of the heading line, one that is no number keeps its place; a bare CO counts rows
    assert sorted((m.co, m.po, m.strength) for m in r.matrix) == [("CO1", "PO1", 3), ("CO1", "PO3", 1), ("CO1", "PSO2", 2), ("CO2", "PO1", 2), ("CO3", "PO3", 2), ("CO3", "PSO2", 1)]
    assert [(u.unit, u.title, u.content) for u in r.units] == [("IV", "Levelling on mud", "Staff readings between two tides."), ("9", "Unit 9", "Echo sounding lines")]
    assert (r.co_count, r.po_count, r.module_count, r.parser, r.parser_confidence) == (3, 3, 2, "AICTE", 0.97)
    primary = parse.primary_outcomes(parse.outcome_matrix(parse.structured_lines(docs(spark, fixtures.STRUCTURED)))).collect()
    assert sorted((p.co, p.po) for p in primary) == [("CO1", "PO1"), ("CO2", "PO1"), ("CO3", "PO3")]


def test_structured_quirks(spark):
    got = {r.subject_name: r for r in parse.structured_courses(docs(spark, fixtures.MULTI)).collect()}
    assert set(got) == {"Orchard Ecology", "Glass"}
    d, t = got["Orchard Ecology"], got["Glass"]
    assert (d.subject_code, d.semester, d.co_count, d.po_count) == ("CS407", "IV", 1, 2) and "Semester inferred from code" in d.warnings
    assert sorted((m.co, m.po, m.strength) for m in d.matrix) == [("CO1", "PO1", 2), ("CO1", "PO2", 2), ("CO1", "PO3", 3), ("CO2", "PO1", 1), ("CO2", "PO2", 3), ("CO2", "PO3", 1), ("CO2", "PO4", 2)]
    assert [(u.unit, u.title, u.content) for u in d.units] == [("1", "Syllabus Content", "University Syllabus:\nSoil before any unit"), ("III", "Grafting", "Whip and tongue")]
    assert (t.subject_code, t.objectives, t.references, t.department, t.semester) == ("ME-316", "Anneal slowly", "Textbooks :\nKiln notes", "Mechanical Engineering", "IX")
    assert t.outcomes is None and t.matrix is None and "Course Outcomes not found" in t.warnings


def test_courses_agree_with_their_sections(spark):
    """The one pass over a course's lines gives what the parsers of single sections give, on random documents."""
    rng = random.Random(7)
    pool = [
        "Paper Title: A{}", "Course Name - B Code: CS30{} Semester: 4", "Subject Code: ME-10{}", "Semester: VI", "Course Objectives:", "aim {}", "Course Outcomes", "1. Explain x{}", "CO2: Design {}", "more words {}", "CO-PO Mapping",
        "CO PO1 PO2 PO3", "| PO2 | PO1 | PO1 |", "CO1 1 2 -", "CO 3 3 3", "CO | 2 | x | 1", "co3 1", "3 2 1 1", "1,2,3", "Units:", "Unit 1: Seep{}", "Module IV", "body {}", "Syllabus Content", "References:", "1. Book {}", "", "   ",
        "Text Books", "Objectives: inline {}", "plain {}", "PSO-1 PO-1 PO2", "CO2 9 8 7 6 5", "Chapter 2 - Dyes",
    ]
    texts = ["Paper Title: start\n" + "\n".join(rng.choice(pool).format(rng.randrange(9)) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    frame = docs(spark, *texts, None).repartition(3)
    lines = parse.structured_lines(frame)
    keyed = lambda rows, *columns: sorted((r.doc_id, r.course_no, *(r[c] for c in columns)) for r in rows.collect())
    courses = parse.structured_courses(frame)
    each = lambda name: courses.select("doc_id", "course_no", F.explode(name).alias("x")).select("doc_id", "course_no", "x.*")
    assert keyed(each("outcomes"), "co", "text", "bloom_level", "difficulty") == keyed(parse.outcomes(lines), "co", "text", "bloom_level", "difficulty")
    assert keyed(each("matrix"), "co", "po", "strength") == keyed(parse.outcome_matrix(lines), "co", "po", "strength")
    assert keyed(each("units"), "unit_no", "unit", "title", "content") == keyed(parse.units(lines), "unit_no", "unit", "title", "content")
    plan = courses._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") + plan.count("Exchange RoundRobin") <= 2


@pytest.mark.parametrize("fix", [False, True])
def test_legacy_parser(spark, fix):
    a, b = parse.legacy_subjects(docs(spark, fixtures.LEGACY), fix).orderBy("subject_no").collect()
    assert (a.subject_name, a.subject_code, b.subject_name, b.subject_code) == ("Queueing in Hospitals", "IT913", "Map Projections", "OE-IT927")
    assert (a.program, a.department, a.elective_type, b.elective_type, a.subject_owner) == ("M.Tech", "Information Technology", "CORE", "OEC", "IT")
    assert (a.semester, b.semester) == (("III" if fix else "IV"), "IV")
    assert a.text.split("\n")[0] == "Subject Name: Queueing in Hospitals" and a.text.endswith("Map Projections") and "Left out" not in b.text


def test_segments_route_every_document(spark):
    rows = parse.segments(docs(spark, fixtures.STRUCTURED, fixtures.LEGACY, fixtures.PLAIN, "nothing here")).collect()
    assert sorted((r.doc_id, r.route) for r in rows) == [(0, "STRUCTURED"), (1, "LEGACY"), (1, "LEGACY"), (2, "FALLBACK"), (3, "FALLBACK")]


def test_questions(spark):
    assert values(spark, T.split_questions, ["Intro text\nQ1. What is RSA? Q2: Define DES.\nQ10. Compare A and B", "a\n\n b ", "", None]) == [["Intro text", "What is RSA?", "Define DES.", "Compare A and B"], ["a", "b"], [], None]
    assert values(spark, T.question_type, ["What is RSA? Compare it with AES", "Define x", "RSA"]) == ["application", "definition", "unknown"]
    assert values(spark, T.core_terms, ["What is a hash function?"]) == [["a", "hash", "function"]]


def test_scores(spark):
    row = spark.createDataFrame([("What is RSA encryption", "Encryption and RSA")], "q string, c string")
    assert row.select(T.keyword_overlap("q", "c")).first()[0] == 0.5
    got = spark.range(1).select(retrieve.boosted(retrieve.base_score(F.lit(0.70), F.lit(0.5)), F.lit(0.12)), retrieve.boosted(F.lit(0.6), F.lit(0.12)), retrieve.concept_boost(F.lit(0.85)), retrieve.concept_boost(F.lit(0.75)), retrieve.concept_boost(F.lit(0.7))).first()
    assert [round(x, 9) for x in got] == [0.78, 0.6, 0.12, 0.06, 0.0]
    assert values(spark, gates.match_strength, [0.90, 0.9001, 0.82, 0.72, 0.7199], "double") == ["PARTIAL_MATCH", "STRONG_MATCH", "PARTIAL_MATCH", "WEAK_MATCH", "NO_MATCH"]
    pair = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in pair.select(zero_safe_cosine("a", "b")).collect()] == [0.0, 1.0]


def chunk_array(spark, items):
    rows = [(0, "q", i, m, s, float(i), s, 0.0, t) for i, (m, s, t) in enumerate(items)]
    frame = spark.createDataFrame(rows, "query_id long, question string, chunk_id long, module string, similarity double, distance double, semantic double, boost double, text string")
    return rerank.collected(frame)


def test_rerank(spark):
    ids = lambda c: F.transform(c, lambda x: x["chunk_id"])
    gaps = chunk_array(spark, [("A", 0.90, "a"), ("A", 0.885, "b"), ("B", 0.865, "c"), ("B", 0.87, "d"), ("A", 0.91, "e")])
    assert gaps.select(ids(rerank.gap_filtered("chunks"))).first()[0] == [0, 1, 2]
    twins = chunk_array(spark, [("A", 0.9, "Some longer text"), ("A", 0.8, "longer TEXT"), ("B", 0.8, "longer text"), ("A", 0.7, " "), (None, 0.6, "x y z"), (None, 0.5, "y z"), ("A", 0.4, fixtures.READING)])
    assert twins.select(ids(rerank.deduplicated("chunks"))).first()[0] == [0, 2, 4]
    mods = chunk_array(spark, [("CIA Triad", 0.9, "a"), ("unknown", 0.9, "b"), ("", 0.8, "c"), (None, 0.7, "d"), ("Bravo", 0.6, "e"), ("CIA Triad", 0.5, "f"), ("Low", 0.3, "g")])
    assert mods.select(rerank.modules_of("chunks")).first()[0] == ["CIA Triad", "Bravo"]


def test_top_k(spark):
    chunks = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.0], "even" if i % 2 == 0 else "odd") for i in range(20)] + [(99, [0.0, 0.0, 0.0], "odd"), (98, None, "odd")], "chunk_id long, vector array<double>, group string").repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 1.0, 0.0], "odd"), (2, [0.0, 1.0, 0.0], "even")], "query_id long, vector array<double>, group string")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieve.top_k(queries, chunks, 3).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [1, 4, 7] and [got[2, k] for k in (1, 2, 3)] == [0, 3, 6]
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieve.top_k(queries, chunks, 2, grouped=True, apart=True).collect()}
    assert [got[1, k] for k in (1, 2)] == [7, 13] and [got[2, k] for k in (1, 2)] == [0, 6]
    assert retrieve.top_k(queries.limit(0), chunks, 3).count() == 0 and retrieve.top_k(queries, chunks.limit(0), 3).count() == 0


@pytest.mark.parametrize("block", [8192, 2])
def test_keyword_scores_take_every_chunk(spark, monkeypatch, block):
    """Against brute force over all pairs; the eight nearest vectors don't matter, stop words don't count."""
    small = functools.partial(grid.highest_product, query_rows=block, chunk_rows=2 * block)
    monkeypatch.setattr(retrieve, "highest_product", small)
    texts = {i: f"filler word{i} and the" for i in range(30)} | {30: "alpha beta_x gamma", 31: "", 32: None}
    asked = {1: "What is the Alpha, gamma of delta?", 2: "the and of", 3: None, 4: "filler word7 alpha", 30: "alpha gamma"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(5)
    questions = spark.createDataFrame(list(asked.items()), "query_id long, question string")
    got = {r.query_id: r.score for r in retrieve.keyword_scores(questions, chunks, apart=True).collect()}
    assert got == pytest.approx({1: 2 / 3, 2: 0, 3: 0, 4: 2 / 3, 30: 0})
    assert {r.score for r in retrieve.keyword_scores(questions, chunks.where("false")).collect()} == {0.0}


def test_tfidf_scores(spark):
    """Against the formula over all pairs: idf of the chunks, unknown terms and stop words left out, best of all."""
    texts = {1: "key key cipher the", 2: "cipher block mode", 3: "", 4: "table the the"}
    asked = {1: "What is the key cipher?", 2: "the of", 3: "cipher banana", 4: "banana", 5: None}
    df = {"key": 1, "cipher": 2, "block": 1, "mode": 1, "table": 1}

    def vector(text):
        w = [x for x in (text or "").lower().replace("?", "").split() if x in df]
        v = {x: w.count(x) * (math.log(5 / (1 + df[x])) + 1) for x in w}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {k: x / norm for k, x in v.items()}

    want = {q: max(sum(w * vector(t).get(k, 0) for k, w in vector(a).items()) for t in texts.values()) for q, a in asked.items()}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    questions = spark.createDataFrame(list(asked.items()), "query_id long, question string")
    got = {r.query_id: r.score for r in retrieve.tfidf_scores(questions, chunks).collect()}
    assert got == pytest.approx(want) and got[1] > 0.9 and got[2] == got[4] == got[5] == 0


def test_decisions(spark):
    schema = "query_id long, question string, top double, chunks array<struct<distance:double,chunk_id:bigint,module:string,similarity:double,semantic:double,boost:double,text:string>>"
    one = lambda text, boost=0.0: [(0.1, 1, "Unit 1", 0.8, 0.8, boost, text)]
    cases = [
        ("Define RSA", 0.1, one("rsa"), False, gates.LOW), ("Define RSA", 0.8, one("about RSA"), True, gates.LISTED), ("Define zzz", 0.8, one("about RSA"), False, gates.MISSING), ("Define zzz", 0.8, one("about RSA", 0.1), True, gates.COVERED),
        ("RSA", 0.8, one("about RSA"), True, gates.GROUNDED), ("zzz", 0.8, one("about RSA"), False, gates.UNSURE), ("Design RSA", 0.8, one("about RSA", 0.1), True, gates.ALIGNED), ("Design RSA", 0.8, one("about RSA"), False, gates.BAD_NO),
        ("Define docker", 0.8, one("about RSA"), False, "Question introduces external application domain 'docker' not explicitly covered in syllabus."),
    ]
    rows = spark.createDataFrame([(i, q, t, c) for i, (q, t, c, _, _) in enumerate(cases)], schema)
    got = gates.decided(rows, 0.2).orderBy("query_id").collect()
    assert [(r.in_syllabus, r.justification) for r in got] == [(y, m) for *_, y, m in cases]
    judge = lambda asked: asked.withColumn("reply", F.lit("Decision: yes\nJUSTIFICATION: it is covered by the unit\nMODULE: Unit 7"))
    r = gates.decided(rows, 0.2, judge).where("query_id = 7").first()
    assert (r.in_syllabus, r.justification, r.decided_module) == (True, "it is covered by the unit", "Unit 7")


def test_gate_failure_record(spark):
    rows = chunk_array(spark, [("Cryptography", 0.05, "x" * 40)])
    scored = rows.select("query_id", "question", F.explode("chunks").alias("c")).select("query_id", "question", "c.*")
    r = gates.audited(scored).first()
    assert (r.is_in_syllabus, r.gatekeeper_passed, r.match_strength, r.match_type, r.decision) == (False, False, "NO_MATCH", "OUT_OF_CURRICULUM", "NO")
    assert (r.retrieval_status, r.top_chunks, r.n_chunks, r.justification, r.llm_decision, r.llm_justification, r.llm_module, r.scope_rejected) == ("NO_MATCH", [], 0, gates.GATE_FAILED, None, None, None, False)


BODY = "Introduction to the design of foundations, with an analysis of the settlement of clay layers and the architecture of retaining walls in practice."


@pytest.mark.parametrize("similarity, threshold, status, modules, shown", [(0.75, 0.8, "MATCH_FOUND", "A,B,C", []), (0.85, 0.8, "MATCH_FOUND", "A,B", [1])])
def test_record_by_gate(spark, similarity, threshold, status, modules, shown):
    """A weak match below the user's threshold shows no chunks but all its modules; a pass shows chunks and two modules."""
    rows = [(1, "Define clay layers", i + 1, m, similarity - 0.01 * i, 0.2 + i / 100, similarity - 0.01 * i, 0.5, 0.0, BODY) for i, m in enumerate("ABC")]
    frame = spark.createDataFrame(rows, "query_id long, question string, chunk_id long, module string, similarity double, distance double, semantic double, keyword double, boost double, text string")
    r = gates.audited(frame, threshold).first()
    assert (r.retrieval_status, r.modules, [c.chunk_id for c in r.top_chunks][:1], r.gatekeeper_passed, r.llm_decision) == (status, modules, shown, bool(shown), "YES" if shown else None)


def test_scope(spark):
    pairs = spark.createDataFrame([("cipher", "ciphertext"), ("cryptography", "cryptanalysis"), ("key", "keys")], "a string, b string")
    assert [r[0] for r in pairs.select(scope.alike("a", "b")).collect()] == [True, True, False]
    q = spark.createDataFrame([(1, "s", "Explain cipher and banana banana"), (2, "none", "cipher"), (3, "s", "what is"), (4, "s", "superciphertextual")], "query_id long, syllabus_id string, question string")
    c = spark.createDataFrame([("s", "ciphertext modes"), ("s", "key")], "syllabus_id string, concept string")
    got = {r.query_id: r.overlap for r in scope.concept_overlap(q, c).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 1.0, 3: 1.0, 4: 1.0}
    concepts = scope.scope_concepts(spark.createDataFrame([("s", "The Hash Function and RSA, System")], "syllabus_id string, text string")).collect()
    assert [r.concept for r in concepts] == ["the hash function", "rsa"]


def test_evaluation(spark):
    rows = spark.createDataFrame([(i / 10, i > 4) for i in range(10)], "score double, expected boolean")
    best = evaluate.best_threshold(evaluate.threshold_sweep(rows)).first()
    assert (best.threshold, best.f1, best.tp, best.fp) == (0.41, 1.0, 5, 0)
    m = evaluate.metrics(evaluate.confusion(rows.withColumn("predicted", F.lit(False)))).first()
    assert (m.tp, m.fn, m.precision, m.recall, m.f1, m.accuracy) == (0, 5, 0.0, 0.0, 0.0, 0.5)
    pairs = spark.createDataFrame([(True, False)] * 1 + [(False, True)] * 9 + [(True, True)] * 5, "first boolean, second boolean")
    r = evaluate.mcnemar(pairs).first()
    assert (r.both, r.only_first, r.only_second, r.neither) == (5, 1, 9, 0) and r.p_value == pytest.approx(2 * (1 + 10) / 1024)
    ev = spark.createDataFrame([(1, i, m, s, "alpha beta gamma") for i, (m, s) in enumerate([("M2", 0.91), ("M4", 0.90), ("M6", 0.89), ("M7", 0.88)])], "query_id long, chunk_id long, module string, similarity double, text string")
    r = evaluate.evidence(ev, 0.8, 2, 0.65).first()
    assert (r.similarity_stability, r.module_consistency, r.concept_agreement, r.supporting_ratio, r.insufficient_evidence) == (0.03, 0.25, 1.0, 1.0, False)


def test_chunks(spark):
    got = chunk.chunks(docs(spark, fixtures.SECTIONED, "S. " * 400, None, "")).orderBy("doc_id", "chunk_no").collect()
    first = [(r.module, r.text) for r in got if r.doc_id == 0]
    assert first == [("Preface of the printer", "Preface of the printer"), ("Unit IV", "A first body without a stop"), ("Unit 12", ": Dyes\nIndigo is vatted. Madder is mordanted twice.")]
    assert all(len(r.text) <= 500 for r in got if r.doc_id == 1) and len([r for r in got if r.doc_id == 1]) == 3
    assert {r.doc_id for r in got} == {0, 1}


def test_store_operators(spark):
    stored = spark.createDataFrame([("A", "A.CO1", "x")], "course_code string, full_co string, text string")
    given = spark.createDataFrame([("A", "A.CO1", "y"), ("A", "A.CO2", "z"), ("A", "A.CO2", "z")], "course_code string, full_co string, text string")
    assert [r.full_co for r in store.outcome_insert(stored, given).collect()] == ["A.CO2"]
    pos = spark.createDataFrame([("s", "co1", "po1", 1)], "syllabus_id string, co string, po string, strength int")
    more = spark.createDataFrame([("s", "CO1", "po3", 2)], "syllabus_id string, co string, po string, strength int")
    assert [tuple(r) for r in store.outcome_upsert(pos, more).collect()] == [("s", "CO1", "PO3", 2)]
    assert DEFAULTS.retrieval_k == 8


def test_record_of_a_question_out_of_scope(spark):
    """However similar, a question whose concepts are foreign has no evidence, no gate, and the reason."""
    rows = spark.createDataFrame([(q, "Define clay", 1, "Unit 1", 0.9, 0.1, 0.9, 0.5, 0.0, "Introduction to the design of foundations, with an analysis of the settlement of clay layers and the architecture of retaining walls in practice.") for q in (1, 2)],
                                 "query_id long, question string, chunk_id long, module string, similarity double, distance double, semantic double, keyword double, boost double, text string")
    scope_of = spark.createDataFrame([(1, 0.0), (2, 0.9)], "query_id long, overlap double")
    out, kept = gates.audited(rows, 0.2, scope=scope_of).orderBy("query_id").collect()
    assert (out.gatekeeper_passed, out.is_in_syllabus, out.decision, out.modules, out.n_chunks, out.bloom_level, out.difficulty) == (False, False, "NO", "", 0, "Unknown", "Unknown")
    assert (out.match_strength, out.match_type, out.semantic_score) == ("WEAK_MATCH", "OUT_OF_CURRICULUM", 0.0) and out.scope_rejected and out.retrieval_status == "MATCH_FOUND" and out.top_chunks == [] and out.llm_decision is None and "0.90" in out.justification and "concepts" in out.justification
    assert (kept.gatekeeper_passed, kept.modules, kept.n_chunks, kept.semantic_score, kept.keyword_overlap_score, kept.concept_boost) == (True, "Unit 1", 1, 0.9, 0.5, 0.0)


@pytest.mark.parametrize("b, c", [(0, 0), (1, 0), (3, 9), (40, 61), (70, 70), (500, 640), (12, 4000)])
def test_mcnemar_is_exact(spark, b, c):
    rows = spark.createDataFrame([(True, False)] * b + [(False, True)] * c + [(True, True)], "first boolean, second boolean")
    n = b + c
    want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    assert evaluate.mcnemar(rows).first().p_value == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_mcnemar_of_very_many_rows(spark):
    """The sum is bounded by the root of the counts; here the normal approximation is near enough to compare."""
    table = spark.range(1).select(F.lit(0).cast("long").alias("both"), F.lit(500_000_000).cast("long").alias("only_first"), F.lit(500_030_000).cast("long").alias("only_second"), F.lit(0).cast("long").alias("neither"))
    z = (30_000 - 1) / math.sqrt(1_000_030_000)
    assert evaluate.with_p_value(table).first().p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_scope_of_a_very_long_word(spark):
    q = spark.createDataFrame([(1, "s", "x" * 5000 + " settlement")], "query_id long, syllabus_id string, question string")
    c = spark.createDataFrame([("s", "settlements")], "syllabus_id string, concept string")
    assert scope.concept_overlap(q, c).first().overlap == 0.5


@pytest.mark.parametrize("apart, grouped", [(False, False), (True, True)])
def test_top_k_against_numpy(spark, apart, grouped):
    """Many ties, vectors of zeros, nulls and other lengths, several slices."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-1, 2, (1300, 3)).astype(float)
    rows = [(int(k), [float(x) for x in v], f"g{k % 3}") for k, v in enumerate(vectors)] + [(2000, None, "g0"), (2001, [1.0], "g1")]
    frame = spark.createDataFrame(rows, "id long, vector array<double>, group string").repartition(3)
    asked = frame.where("id < 40").withColumnRenamed("id", "query_id")
    got = {}
    for r in retrieve.top_k(asked, frame.withColumnRenamed("id", "chunk_id"), 8, grouped=grouped, apart=apart).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, round(r.cosine, 9)))
    unit = lambda v: np.zeros(3) if v is None or len(v) != 3 or not np.any(v) else np.array(v) / np.linalg.norm(v)
    for q, v, g in rows[:40]:
        best = sorted((-round(float(unit(v) @ unit(w)), 12), k) for k, w, h in rows if (not grouped or g == h) and (not apart or k != q))[:8]
        assert sorted(got[q]) == [(i + 1, k, round(-s, 9) + 0.0) for i, (s, k) in enumerate(best)]
