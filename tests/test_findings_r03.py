"""What the third review found."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditlark.functions import text as T
from auditlark.functions import words as W
from auditlark.operators import gates, grid, parse, phrases, retrieve
from auditlark.operators.embed import HashedWords


def test_percent_rounds_as_c_does(spark):
    """Halves go to the even digit, numbers a hair beside a half to their own side, thousands get no mark."""
    values = [0.4425, 0.4435, 0.4475, 0.0025, 0.00125, 0.00375, 0.0005, 0.1005, 0.333333, 1.0, 0.0, -0.0125, 12.34567, *(i / 2000 for i in range(2001))]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", gates.percent("x").alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: f"{x * 100:.1f}" for i, x in enumerate(values)}
    assert spark.range(1).select(gates.percent(F.lit(None).cast("double")).alias("s")).first().s is None


def _peak_mb(run):
    gc.collect()
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_a_sparse_cell_is_bounded():
    """Half a million products at a time: the peak of a cell stays small beside its tables."""
    random = np.random.default_rng(1)

    def side(name, n):
        slots = [np.unique(random.integers(0, 3000, 60)) for _ in range(n)]
        vector = pa.array([{"size": 0, "slots": s, "values": np.ones(len(s))} for s in slots], pa.struct([("size", pa.int64()), ("slots", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))]))
        return pa.table({name: pa.array(range(n)), "vector": vector}), slots

    (q, asked), (c, chunks) = side("query_id", 900), side("chunk_id", 4000)
    found, peak = _peak_mb(lambda: grid._highest(False)(q, c))
    want = max(len(np.intersect1d(asked[0], s)) for s in chunks)
    assert dict(zip(found["query_id"].to_pylist(), found["score"].to_pylist(), strict=True))[0] == want
    assert peak < 90


def test_a_dense_cell_is_bounded():
    random = np.random.default_rng(1)
    side = lambda name, n: pa.table({name: pa.array(range(n)), "vector": pa.array(list(random.normal(size=(n, 16))), pa.list_(pa.float64()))})
    q, c = side("query_id", 2000), side("chunk_id", 4000)
    found, peak = _peak_mb(lambda: grid._nearest(8, False)(q, c))
    a, b = (np.array(t["vector"].to_pylist()) for t in (q, c))
    sims = (a[0] @ b.T) / np.linalg.norm(a[0]) / np.linalg.norm(b, axis=1)
    assert [x for x, y in zip(found["chunk_id"].to_pylist(), found["query_id"].to_pylist(), strict=True) if y == 0] == list(np.argsort(-sims)[:8])
    assert peak < 90


def test_slabs_follow_bytes(spark, monkeypatch):
    """Long texts make smaller slabs, with the scores of one slab."""
    texts = spark.range(60).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("word"), (i * F.col("id") % 997).cast("string")))).alias("text"))
    asked = texts.where("chunk_id % 6 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("question"))
    scores = lambda f: {r.query_id: round(r.score, 9) for r in f(asked, texts, apart=True).collect()}
    want = [scores(f) for f in (retrieve.keyword_scores, retrieve.tfidf_scores)]
    monkeypatch.setattr(grid, "PART_BYTES", 16_000, raising=False)
    assert [scores(f) for f in (retrieve.keyword_scores, retrieve.tfidf_scores)] == want
    sparse = texts.select("chunk_id", HashedWords(2**60).vector(F.col("text")).alias("vector"))
    sizes = lambda left, right: pa.table({"query_id": [0], "score": [float(right.num_rows)]})
    rows = grid.cells(sparse.withColumnRenamed("chunk_id", "query_id"), sparse, sizes, grid.SCORED).collect()
    assert max(r.score for r in rows) < 40


def test_segments_route_only_what_a_parser_can_read(spark):
    """Routes are by regular expressions over whole texts; of plain texts none is evaluated, and each comes back once."""
    docs = spark.createDataFrame([(1, "plain words only"), (2, None), (3, "Course Title: Cryptography\nCourse Code: CS601\nCourse Objectives:\nLearn ciphers.\nCourse Outcomes:\nCO1: Explain AES.")], "doc_id long, text string")
    rows = {r.doc_id: r.route for r in parse.segments(docs).collect()}
    assert rows == {1: "FALLBACK", 2: "FALLBACK", 3: "STRUCTURED"}
    plan = parse.segments(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") == 0 and "Articulation" not in plan


def test_metadata_without_its_fixed_string(spark):
    """Each pattern's fixed string is in all that the pattern finds."""
    heads = ["SUBJECT NAME: Ciphers", "name of the Subject - Keys", "course title: Modes", "x\nBLOCK CIPHERS\ny", "Subject Code: A-1", "Paper code: B2", "CODE - C3", "semester: IV", "5th SEMESTER", "Program: B.Tech", "COURSE: MCA", "Department: IT", "DEPT. : CS", "Board of Studies: X", "bos: Y", "", None]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, text string").select("i", *(v.alias(k) for k, v in T.metadata("text").items())).collect()
    old = {}
    for field, patterns in W.METADATA.items():
        found = [T.strip(F.regexp_replace(T.strip(F.regexp_extract("text", f"(?i){p}", 1)), r"[:\-]$", "")) for p in patterns]
        old[field] = F.coalesce(*(F.when(f != "", f) for f in found))
    want = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, text string").select("i", *(v.alias(k) for k, v in old.items())).collect()
    assert sorted(got) == sorted(want) and {f: sum(r[f] is not None for r in got) > 0 for f in W.METADATA} == dict.fromkeys(W.METADATA, True)


def test_key_phrases_deal_texts_once(spark, monkeypatch):
    """Small keys' words aren't shuffled with their phrases; large keys, spread over tasks, get the same."""
    rows = spark.createDataFrame([("s", "brass gauge, the red gauge\nbrass gauge"), ("s", "red valve of brass"), (None, "odd brass gauge"), ("t", ""), ("u", None)], "syllabus_id string, text string")
    found = lambda: sorted(map(repr, phrases.key_phrases(rows, 4).collect()))
    want = found()
    for large in (-1, 20):
        monkeypatch.setattr(phrases, "LARGE", large)
        assert found() == want and len(want) == 5
    monkeypatch.undo()
    plan = phrases.key_phrases(rows, 4)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
