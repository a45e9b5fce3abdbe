"""The grid of cells, the inverted-file index and the sparse embedder against numpy."""

import math
import os
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from auditlark.functions.lemmas import lemma
from auditlark.operators import grid, phrases, scope, store
from auditlark.operators.embed import HashedWords, counted, sparse_cosine
from auditlark.operators.index import VectorIndex, _probing, fit_centroids
from auditlark.plans.engine import CurriculumEngine

LINES = ["one two two three", "", None, "Three; THREE three_x", "été Ωmega 42", " ".join(f"w{i % 90}" for i in range(3000))]


def as_rows(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, round(r.cosine, 9) + 0.0))
    return {q: sorted(v) for q, v in out.items()}


def exact(queries, chunks, k, size):
    """queries, chunks: {id: vector}; the k best by cosine and id."""
    unit = lambda v: np.zeros(size) if v is None or len(v) != size or not np.any(v) else np.asarray(v, float) / np.linalg.norm(v)
    table, names = np.stack([unit(v) for v in chunks.values()]), list(chunks)
    out = {}
    for q, v in queries.items():
        best = sorted((-round(float(s), 12), n) for s, n in zip(table @ unit(v), names))[:k]
        out[q] = [(i + 1, n, round(-s, 9) + 0.0) for i, (s, n) in enumerate(best)]
    return out


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    return {i: (centres[i % 12] + 0.5 * rng.normal(size=16)).round(3).tolist() for i in range(1200)} | {5000: None, 5001: [0.0] * 16, 5002: [1.0]}


def frame(spark, rows, name):
    return spark.createDataFrame(list(rows.items()), f"{name} long, vector array<double>").repartition(3)


@pytest.mark.parametrize("query_rows, chunk_rows", [(8192, 8192), (13, 100), (8192, 50), (7, 8192)])
def test_every_cell_counts(spark, numbers, query_rows, chunk_rows):
    queries = {i: numbers[i] for i in range(60)}
    got = grid.top_k(frame(spark, queries, "query_id"), frame(spark, numbers, "chunk_id"), 5, query_rows=query_rows, chunk_rows=chunk_rows)
    assert as_rows(got) == exact(queries, numbers, 5, 16)


def test_groups_of_all_sizes(spark, numbers):
    """A group with most rows gets more cells; a null group is one; groups of one side make none."""
    group = lambda i: None if i % 40 == 0 else "large" if i % 3 else f"g{i % 9}"
    columns = "long, vector array<double>, group string"
    chunks = spark.createDataFrame([(i, v, group(i)) for i, v in numbers.items()], f"chunk_id {columns}")
    queries = {i: numbers[i] for i in range(50)}
    asked = spark.createDataFrame([(i, v, group(i)) for i, v in queries.items()] + [(9000, numbers[1], "nobody")], f"query_id {columns}")
    want = {}
    for i, v in queries.items():
        want |= exact({i: v}, {j: w for j, w in numbers.items() if group(j) == group(i) and j != i}, 4, 16)
    assert as_rows(grid.top_k(asked, chunks, 4, grouped=True, apart=True, query_rows=10, chunk_rows=30)) == want


def test_the_plan_does_not_grow(spark, numbers):
    """As many nodes and scans for a hundred blocks of queries as for two."""
    chunks = frame(spark, numbers, "chunk_id")

    def plan(rows):
        found = grid.top_k(spark.range(rows).select(F.col("id").alias("query_id"), F.array_repeat(F.col("id").cast("double"), 16).alias("vector")), chunks, 3, query_rows=10)
        return re.sub(r"#\d+L?|\d+", "", found._jdf.queryExecution().optimizedPlan().toString())

    assert plan(1000) == plan(15)


def sparse(spark, rows, name):
    listed = [(i, None if v is None else (16, [k for k, x in enumerate(v) if x], [x for x in v if x])) for i, v in rows.items()]
    return spark.createDataFrame(listed, f"{name} long, vector {grid.SPARSE}").repartition(3)


def test_sparse_vectors_are_searched_alike(spark, numbers, monkeypatch):
    thin = {i: None if v is None else [x if (i + k) % 3 else 0.0 for k, x in enumerate(v)] for i, v in numbers.items() if v is None or len(v) == 16}
    queries = {i: thin[i] for i in (*range(40), 5000, 5001)}
    got = grid.top_k(sparse(spark, queries, "query_id"), sparse(spark, thin, "chunk_id"), 5, query_rows=11, chunk_rows=200)
    assert as_rows(got) == exact(queries, thin, 5, 16)


def test_products_in_slices(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    kind = pa.struct([("size", pa.int64()), ("slots", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])
    make = lambda n: [{"size": 9, "slots": (s := sorted(rng.choice(9, 4, replace=False).tolist())), "values": rng.normal(size=4).tolist()} for _ in range(n)]
    a, b = make(7), make(5)
    table = lambda rows: np.array([[dict(zip(r["slots"], r["values"])).get(k, 0.0) for k in range(9)] for r in rows])
    for most in (1, 10, 1000):
        monkeypatch.setattr(grid, "PRODUCTS", most)
        got = grid.Sparse(pa.array(b, kind)).products(grid.Sparse(pa.array(a, kind)), 1, 4)
        assert np.allclose(got, table(a) @ table(b)[1:4].T)


@pytest.mark.parametrize("form", [frame, sparse])
def test_index(spark, numbers, tmp_path, form):
    rows = {i: v for i, v in numbers.items() if form is frame or v is None or len(v) == 16}
    chunks, queries = form(spark, rows, "chunk_id"), form(spark, {i: rows[i] for i in range(0, 1200, 10)}, "query_id")
    folder = f"file://{tmp_path}/index"
    assert VectorIndex.open(spark, folder) is None
    index = VectorIndex.build(chunks, folder, cells=24, sample=400)
    assert index.rows().count() == len(rows) and index.rows().select("cell").distinct().count() > 12
    assert as_rows(index.search(queries, 8, probes=24)) == as_rows(index.exact(queries, 8)) == as_rows(grid.top_k(queries, chunks, 8))
    few, many = (index.recall(queries, 8, probes=p) for p in (1, 6))
    assert few <= many and 1 <= index.probes < 24 and index.recall(queries, 8) >= 0.9
    again = VectorIndex.open(spark, folder)
    assert again.path.rsplit("/", 1)[1] == index.path.rsplit("/", 1)[1] and np.allclose(again.centroids, index.centroids)
    more = form(spark, {9000: rows[3]}, "chunk_id")
    assert again.probes == index.probes
    again.append(more)
    found = as_rows(again.search(form(spark, {3: rows[3]}, "query_id"), 2, probes=1))
    assert [c for _, c, _ in found[3]] == [3, 9000]
    only = spark.createDataFrame([(9000,), (7,)], "chunk_id long")
    assert {c for v in as_rows(again.search(queries, 3, probes=24, among=only)).values() for _, c, _ in v} == {7, 9000}
    (tmp_path / "index" / "99999999999999999999-broken" / "rows").mkdir(parents=True)  # a build that failed
    assert VectorIndex.open(spark, folder).path == again.path


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, vector array<double>")
    index = VectorIndex.build(none, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert index.search(asked, 3).count() == 0 and index.recall(asked, 3) == 1.0
    zeros = VectorIndex.build(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "chunk_id long, vector array<double>"), f"file://{tmp_path}/zeros")
    assert zeros.rows().count() == 2 and len(fit_centroids(np.eye(3), 7)) == 3


def test_embedder(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "i int, text string")
    got = {r.i: r.v for r in rows.select("i", HashedWords(64).vector(F.col("text")).alias("v")).collect()}
    slot = {r.w: r.s for r in spark.createDataFrame([(w,) for t in LINES for w in re.split(r"[\W]+", (t or "").lower())], "w string").distinct().select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("s")).collect()}
    for i, text in enumerate(LINES):
        if text is None:
            assert got[i] is None
            continue
        want = Counter(slot[w] for w in re.split(r"[\W]+", text.lower()) if w)
        assert dict(zip(got[i].slots, got[i]["values"])) == want and got[i].slots == sorted(want) and got[i].size == 64


def test_sparse_cosine(spark):
    rows = spark.createDataFrame([(a, b) for a in LINES for b in LINES], "a string, b string")
    e = HashedWords(4096)
    made = rows.select("a", "b", e.vector(F.col("a")).alias("x"), e.vector(F.col("b")).alias("y"))
    for r in made.select("a", "b", sparse_cosine("x", "y").alias("c")).collect():
        x, y = (Counter(w for w in re.split(r"[\W]+", (t or "").lower()) if w) for t in (r.a, r.b))
        norms = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        if r.a is None or r.b is None:
            assert r.c is None
        else:
            assert r.c == pytest.approx(sum(v * y[w] for w, v in x.items()) / norms if norms else 0, abs=1e-9)
    assert spark.range(1).select(counted(F.array().cast("array<bigint>"), 5).alias("v")).first().v.slots == []


def test_engine_stores_vectors(spark, tmp_path):
    """Ingest stores them, an audit reads them, and an index of all cells gives the same audit."""
    e = CurriculumEngine(spark, f"file://{tmp_path}/store")
    body = "{} systems and the {} of protocols, with encryption, decryption and a comparison of every algorithm in use, number {}."
    docs = spark.createDataFrame([(i, " ".join(body.format(w, v, i) for v in ("design", "analysis", "theory"))) for i, w in enumerate(("alpha", "beta", "gamma", "delta"))], "doc_id long, text string")
    e.ingest_syllabus(docs).collect()
    chunks = e.store.read("chunks")
    kind = chunks.select(e.embedder.vector(F.col("text"), "passage").alias("v")).dtypes[0][1]
    stored = e.store.vectors(e.embedder.name, kind)
    assert stored.count() == chunks.count() > 0
    fresh = chunks.select("syllabus_id", "chunk_no", e.embedder.vector(F.col("text"), "passage").alias("v"))
    assert stored.join(fresh, ["syllabus_id", "chunk_no"]).where("vector <> v").count() == 0
    pastes = spark.createDataFrame([(1, "Q1. Explain the theory of beta protocols Q2: Define gamma systems")], "paste_id long, text string")
    plain = sorted(map(str, e.analyze_questions(pastes).collect()))
    assert e.index() is None and sorted(map(str, e.analyze_questions(pastes, probes=4).collect())) == plain
    index = e.build_index(cells=3)
    assert sorted(map(str, e.analyze_questions(pastes, probes=len(index.centroids)).collect())) == plain
    one = chunks.first().syllabus_id
    e.delete_syllabus(one)
    assert e.store.vectors(e.embedder.name, kind).where(F.col("syllabus_id") == one).count() == 0
    left = sorted(map(str, e.analyze_questions(pastes).collect()))
    assert sorted(map(str, e.analyze_questions(pastes, probes=3).collect())) == left
    e.reset_vectors()
    assert e.store.vectors(e.embedder.name, kind).count() == 0


def test_key_phrases(spark):
    text = "Tidal flats and the tidal gauge, a brass gauge; 42 - The one two three four five words that go too far\nTidal flats"
    rows = spark.createDataFrame([("s", text), ("t", None), ("u", ""), (None, "brass gauge")], "syllabus_id string, text string")
    found = {r.i: r.p for r in rows.select(F.col("syllabus_id").alias("i"), phrases.candidate_phrases("text").alias("p")).collect()}
    assert found["s"] == ["tidal flats", "tidal gauge", "brass gauge", "words", "far", "tidal flats"] and found["t"] is None and found["u"] == []
    got = [(r["rank"], r.phrase, round(r.score, 6), r.n) for r in phrases.key_phrases(rows, 3).where("syllabus_id = 's'").orderBy("rank").collect()]
    assert got == [(1, "brass gauge", 4.0, 1), (2, "tidal flats", 4.0, 2), (3, "tidal gauge", 4.0, 1)]
    assert phrases.key_phrases(rows, 9).where("syllabus_id is null").first().phrase == "brass gauge"
    both = rows.where("syllabus_id = 's'").select(scope.concepts_of("text", phrases=phrases.candidate_phrases).alias("c")).first().c
    assert set(found["s"]) < set(both) and len(set(both)) == len(both)


@pytest.mark.parametrize("word, base", [("classes", "class"), ("boxes", "box"), ("studies", "study"), ("studied", "study"), ("keys", "key"), ("bus", "bus"), ("glass", "glass"), ("planned", "plan"), ("planning", "plan"), ("computed", "compute"), ("tested", "test"), ("testing", "test"), ("matrices", "matrix"), ("went", "go"), ("string", "string"), ("analysis", "analysis"), ("x2s", "x2s"), ("", ""), ("été", "été"), ("routing", "route"), ("encoded", "encod")])
def test_lemmas(spark, word, base):
    got = spark.createDataFrame([(word,)], "w string").select(lemma("w").alias("a"), lemma("w", {"encoded": "encode"}).alias("b")).first()
    assert got.a == base and got.b == ("encode" if word == "encoded" else base)


def test_summary(spark):
    rows = [("a", 0, "M1", "D", "I"), ("a", 1, "M1", None, None), ("a", 2, None, "X", "IX"), ("b", 5, "unknown", "D", "II"), ("c", 0, "M", None, None)]
    got = {(r.level, r.department, r.semester): (r.n_subjects, r.n_modules, r.n_chunks) for r in store.summary(spark.createDataFrame(rows, "syllabus_id string, chunk_no int, module string, department string, semester string")).collect()}
    assert got == {(0, "D", "I"): (1, 1, 3), (0, "D", "II"): (1, 0, 1), (1, "D", None): (2, 1, 4), (0, "Unknown Department", "Unknown"): (1, 1, 1), (1, "Unknown Department", None): (1, 1, 1), (3, None, None): (3, 2, 5)}


def test_executors_need_no_copy_of_the_package(tmp_path):
    """What tasks run is pickled whole: a process that can't import the package runs it."""
    made = cloudpickle.dumps((grid._nearest(1, False), grid._highest(True), _probing(np.eye(2), 1)))
    code = """if True:
        import pickle, sys
        import pyarrow as pa
        nearest, highest, probing = pickle.load(sys.stdin.buffer)
        q = pa.table({"query_id": [1, 2], "vector": [[1.0, 0.0], [0.0, 1.0]]})
        c = pa.table({"chunk_id": [1, 2], "vector": [[0.5, 0.0], [1.0, 2.0]]})
        assert nearest(q, c).column("chunk_id").to_pylist() == [1, 2]
        assert highest(q, c).column("score").to_pylist() == [1.0]
        batch = c.select(["vector"]).to_batches()[0]
        assert [b.column(0).to_pylist() for b in probing(iter([batch]))] == [[[0], [1]]]
        assert not any(m.split(".")[0] == "auditlark" for m in sys.modules)
        try:
            import auditlark
        except ModuleNotFoundError:
            print("alone")
    """
    ran = subprocess.run([sys.executable, "-c", code], input=made, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True)
    assert ran.stdout == b"alone\n", ran.stderr.decode()[-2000:]
