"""The engine end to end on a small warehouse, its readers and its stream."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from auditlark.operators.judge import CachedJudge, prompt
from auditlark.plans import fixtures
from auditlark.plans.engine import CurriculumEngine, NoInput
from auditlark.sources import readers
from auditlark.streaming.questions import audit_stream, summary_stream

BODY = "Encryption and decryption protocol design, with the architecture of secure communication systems and a comparison of every algorithm in use."


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = CurriculumEngine(spark, f"file://{tmp_path_factory.mktemp('store')}")
    text = fixtures.STRUCTURED.replace("Staff readings between two tides.", BODY)
    e.ingest_syllabus(spark.createDataFrame([(1, text), (2, fixtures.LEGACY.replace("Discharge rules and what they do to waiting.", BODY)), (3, None)], "doc_id long, text string")).collect()
    return e


def test_ingest_is_idempotent(spark, engine):
    before = engine.store.read("chunks").count()
    assert before > 0
    parse_id, preview = engine.parse_curriculum(spark.createDataFrame([(1, fixtures.STRUCTURED)], "doc_id long, text string"), "again")
    assert [r.already_ingested for r in preview.collect()] == [True]
    engine.ingest_selected(parse_id)
    assert engine.store.read("chunks").count() == before
    with pytest.raises(NoInput):
        engine.ingest_selected("no such stage")


def test_ingest_keeps_every_text(spark, tmp_path):
    """Documents without metadata, and two texts with one code, are all stored, once each."""
    e = CurriculumEngine(spark, f"file://{tmp_path}/store")
    plain = [f"{w} systems in practice: {BODY}" for w in ("alpha", "beta", "gamma")]
    coded = [fixtures.STRUCTURED.replace("Staff readings between two tides.", f"{w} {BODY}") for w in ("First", "Second")]
    docs = spark.createDataFrame(list(enumerate([*plain, plain[0], *coded])), "doc_id long, text string")
    n = e.ingest_syllabus(docs).count()
    assert n == 5 and e.store.exists("CE-V-OEC-OE-CE514C")
    texts = [r.text for r in e.store.read("chunks").collect()]
    assert all(sum(w in t for t in texts) == 1 for w in ("alpha systems", "beta systems", "gamma systems"))
    e.ingest_syllabus(docs.repartition(5)).collect()
    e.ingest_syllabus(spark.createDataFrame([(0, "delta systems in practice: " + BODY)], "doc_id long, text string")).collect()
    assert e.store.registry().count() == 6 and e.store.read("chunks").count() == len(texts) + 1
    assert e.parse_curriculum(docs)[0] == e.parse_curriculum(docs.orderBy(F.desc("doc_id")))[0] != e.parse_curriculum(docs.limit(2))[0]


def test_views(engine):
    ids = {r.syllabus_id for r in engine.list_syllabi().collect()}
    assert "CE-V-OEC-OE-CE514C" in ids and engine.departments() == ["Civil Engineering", "Information Technology"]
    assert engine.list_syllabi(semester="none").count() == 0 and engine.hierarchy().count() == 2
    assert engine.store.exists("CE-V-OEC-OE-CE514C") and engine.store.read("outcomes").count() >= 2


def test_audit(spark, engine):
    pastes = spark.createDataFrame([(1, "Q1. Explain the encryption and decryption protocol design Q2: Define bananas")], "paste_id long, text string")
    rows = engine.analyze_questions(pastes, "CE-V-OEC-OE-CE514C", 0.2).orderBy("pos").collect()
    assert [r.question for r in rows] == ["Explain the encryption and decryption protocol design", "Define bananas"]
    assert all(0 <= r.similarity <= 1 and r.n_chunks <= 3 for r in rows) and not rows[1].is_in_syllabus
    assert rows[0].bloom_level == "Create"
    d = engine.detect_subject(spark.createDataFrame([(1, "Subject Name: Other\nSemester: 4")], "doc_id long, text string")).first()
    assert (d.subject_name, d.semester) == ("Other", "4")


def test_get_and_orphans(spark, engine):
    rows = engine.store.get("chunks", "module is not null and syllabus_id = 'CE-V-OEC-OE-CE514C'", ["chunk_no", "text"], 1).collect()
    assert [(r.chunk_no, len(r)) for r in rows] == [(0, 2)]
    assert {r.table: r.n for r in engine.store.orphans().collect()}["concepts"] == engine.store.read("concepts").join(engine.store.read("chunks"), "syllabus_id", "left_anti").count()


class Table:
    """Vectors of given texts; all others are alike and far from them."""

    name = "table"

    def __init__(self, **vectors):
        self.vectors = {k.replace("_", " "): v for k, v in vectors.items()}

    def vector(self, text, task):
        out = F.array(*(F.lit(0.0) for _ in range(3)), F.lit(1.0))
        for k, v in self.vectors.items():
            out = F.when(F.lower(text) == k, F.array(*(F.lit(float(x)) for x in v))).otherwise(out)
        return out


def stored(spark, folder, embedder, text, syllabus="s"):
    e = CurriculumEngine(spark, f"file://{folder}/own", embedder)
    row = [(syllabus, 0, text, "M1", None, None, None, None, "CORE")]
    e.store.append("chunks", spark.createDataFrame(row, "syllabus_id string, chunk_no int, text string, module string, department string, semester string, subject_code string, subject_name string, elective_type string"))
    return e


def test_concepts_boost_paraphrases(spark, tmp_path):
    """An application question near the chunk and with a concept near one of its own passes by the strong override."""
    question, text = "How would you implement Redundancy Removal", "Normalization of relations and tables in database design with functional dependencies, decomposition and lossless joins of every kind."
    near = {"redundancy removal": [1, 0.5, 0, 0], "normalization": [1, 0.4, 0, 0], question.lower(): [1, 0.3, 0, 0], text.lower(): [1, 0.3, 0, 0]}
    embedder = Table()
    embedder.vectors = near
    e = stored(spark, tmp_path, embedder, text)
    pastes = spark.createDataFrame([(1, question)], "paste_id long, text string")
    got = e.analyze_questions(pastes, "s", 0.2).first()
    assert got.similarity == pytest.approx(0.92) and got.decision == "YES" and got.is_in_syllabus
    embedder.vectors = near | {"redundancy removal": [0, 0, 1, 0]}
    got = e.analyze_questions(pastes, "s", 0.2).first()
    assert got.similarity == pytest.approx(0.8) and got.decision == "NO"


def test_scope_takes_synonyms_and_outcomes_are_mapped(spark, tmp_path):
    from auditlark.operators import scope

    near = Table(car=[1, 0.1, 0, 0], automobile=[1, 0, 0, 0], boat=[0.5, 1, 0, 0])
    q = spark.createDataFrame([(1, "s", "car boat"), (2, "t", "car")], "query_id long, syllabus_id string, question string")
    concepts = spark.createDataFrame([("s", "automobile"), ("t", "banana")], "syllabus_id string, concept string")
    got = {r.query_id: r.overlap for r in scope.concept_overlap(q, concepts, near).collect()}
    assert got == pytest.approx({1: 1 / 1.01**0.5 / 2, 2: 0})
    assert {r.overlap for r in scope.concept_overlap(q, concepts).collect()} == {0.0}

    embedder = Table()
    embedder.vectors = {"define keys": [0, 1, 0, 0], "use of keys": [0, 1, 0.1, 0], "other things": [1, 0, 0, 0]}
    e = stored(spark, tmp_path, embedder, BODY)
    schema = "syllabus_id string, course_code string, co string, full_co string, text string"
    e.store.append("outcomes", spark.createDataFrame([("s", "X1", "CO1", "X1.CO1", "other things"), ("s", "X1", "CO2", "X1.CO2", "use of keys")], schema))
    e.store.append("outcome_map", spark.createDataFrame([("s", "CO2", "PO3", None), ("t", "CO2", "PO9", None)], "syllabus_id string, co string, po string, strength int"))
    pastes = spark.createDataFrame([(1, "Define keys")], "paste_id long, text string")
    r = e.analyze_questions(pastes, "s", 0.2).first()
    assert (r.mapped_co, r.mapped_co_full, r.mapped_po) == ("CO2", "X1.CO2", "PO3")


def test_questions_without_chunks_are_answered(spark, engine):
    pastes = spark.createDataFrame([(1, "Q1. Define RSA in brief Q2: Design a cipher for mail")], "paste_id long, text string")
    rows = engine.analyze_questions(pastes, "no such syllabus", 0.2).orderBy("pos").collect()
    assert [(r.question, r.bloom_level, r.similarity, r.match_strength, r.match_type, r.decision, r.is_in_syllabus, r.gatekeeper_passed, r.n_chunks) for r in rows] == [
        ("Define RSA in brief", "Remember", 0.0, "NO_MATCH", "OUT_OF_CURRICULUM", "NO", False, False, 0),
        ("Design a cipher for mail", "Create", 0.0, "NO_MATCH", "OUT_OF_CURRICULUM", "NO", False, False, 0),
    ]


def test_stream(spark, engine, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "Define RSA")], "paste_id long, text string").write.parquet(str(source))
    stream = spark.readStream.schema("paste_id long, text string").parquet(str(source))
    q = audit_stream(engine, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_drops_repeats_and_keeps_count(spark, engine, tmp_path):
    """Equal questions within the watermark are answered once; a replay gives the same files; the summary runs along."""
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "paste_id long, text string, at timestamp"

    def put(*rows):
        spark.createDataFrame([(i, t, datetime.datetime(2026, 1, 1, h)) for i, t, h in rows], schema).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        q = audit_stream(engine, spark.readStream.schema(schema).parquet(str(source)), str(out), str(tmp_path / "state"), time="at", delay="2 hours")
        q.processAllAvailable()
        q.stop()
        s = summary_stream(spark, str(out), str(tmp_path / "summary"), str(tmp_path / "counts"))
        s.processAllAvailable()
        s.stop()
        asked = sorted((r.paste_id, r.question) for r in spark.read.parquet(str(out)).collect())
        total = spark.read.parquet(str(tmp_path / "summary")).first()
        assert total.n == len(asked) == total.n_in + total.n_borderline + total.n_out
        return asked

    put((1, "Q1. Define RSA Q2: Compare  trees", 1), (2, "define rsa", 1))
    assert len(first := run()) == 2 and {q.lower() for _, q in first} == {"define rsa", "compare  trees"}
    put((3, "compare Trees", 2), (4, "Design a cipher", 2))
    assert [x for x in run() if x not in first] == [(4, "Design a cipher")]
    files = {f.name: f.stat().st_mtime_ns for f in out.rglob("*.parquet")}
    again = sorted(int(f.name) for f in (tmp_path / "state" / "commits").iterdir() if f.name.isdigit())[-1]
    for name in (str(again), f".{again}.crc"):  # the last batch was written, its commit lost
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    assert len(run()) == 3 and {f.name: f.stat().st_mtime_ns for f in out.rglob("*.parquet")} == files


def test_judge_is_asked_once_for_each_prompt(spark, tmp_path):
    calls = []

    def ask(prompts):
        rows = prompts.collect()
        calls.append(len(rows))
        return spark.createDataFrame([(r.prompt_id, None if "broken" in r.prompt else "DECISION: YES\nJUSTIFICATION: it is covered by a unit\nMODULE: M2", "timeout" if "broken" in r.prompt else None) for r in rows], "prompt_id string, reply string, error string")

    chunk = {"text": "x" * 500}
    rows = spark.createDataFrame([(1, "How to use a", [chunk] * 5), (2, "How to use a", [chunk] * 5), (3, "How to use b", []), (4, "broken", [{"text": None}]), (5, None, None)], "query_id long, question string, chunks array<struct<text:string>>")
    made = rows.where("query_id = 1").select(prompt(F.col("question"), F.col("chunks")).alias("p")).first().p
    assert made.count("- " + "x" * 200 + "\n") == 3 and "x" * 201 not in made and "How to use a" in made
    judge = CachedJudge(spark, f"file://{tmp_path}/replies", ask)
    got = {r.query_id: r.reply for r in judge(rows).collect()}
    assert calls == [4] and got[1] == got[2] and got[1].startswith("DECISION: YES") and got[4] == ""
    assert [(r.error,) for r in judge.errors().collect()] == [("timeout",)]
    assert {r.query_id: r.reply for r in judge(rows).collect()} == got and calls == [4, 1]  # only the error again
    assert {r.query_id: r.reply for r in judge(rows.where("query_id <> 4")).collect()} == {k: v for k, v in got.items() if k != 4} and calls == [4, 1]
    assert judge(rows.limit(0)).count() == 0 and calls == [4, 1]


def test_delete_cascades(spark, tmp_path):
    e = CurriculumEngine(spark, f"file://{tmp_path}/store")
    e.ingest_syllabus(spark.createDataFrame([(1, fixtures.STRUCTURED.replace("Staff readings between two tides.", BODY))], "doc_id long, text string"))
    assert e.store.exists("CE-V-OEC-OE-CE514C")
    e.delete_syllabus("CE-V-OEC-OE-CE514C")
    assert not e.store.exists("CE-V-OEC-OE-CE514C") and e.store.read("outcomes").count() == 0
    assert e.purge_all() == 0


def docx(paragraph):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>{paragraph}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.docx").write_bytes(docx("hello"))
    (folder / "b.docx").write_bytes(b"plain after all")
    (folder / "c.txt").write_bytes(b"\xff\xfe")
    got = {r.source.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.read_documents(spark, str(folder)).collect()}
    assert got == {"a.docx": ("hello\na b", None), "b.docx": ("plain after all", None), "c.txt": (None, "cannot read c.txt")}
    data = tmp_path / "d.json"
    data.write_text(json.dumps([{"question": " a ", "expected": True}, {"question": "REPLACE_ME", "expected": True}, {"question": "", "expected": False}, {"question": "b"}]))
    assert [tuple(r) for r in readers.read_dataset(spark, str(data)).collect()] == [("a", True)]
    pages = spark.createDataFrame([(1, "u", "<p>a&nbsp;b</p>"), (2, "u", "<p> </p>"), (3, "u", None)], "page_id long, url string, html string")
    assert [(r.page_id, r.text) for r in readers.read_pages(pages).collect()] == [(1, "a b")]
    with pytest.raises(ValueError):
        readers.pasted(spark, " ")
    assert readers.pasted(spark, "x").select(F.length("doc_id")).first()[0] == 64
