"""The pipeline's stages against brute force on the same documents, stage by stage."""

import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import VOCABULARY, contamination, words
from tokenizers import Tokenizer

import corpus_pipeline
from auditlark.llm.mixing import targets_of
from auditlark.llm.toxicity import fit_toxicity, score_toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, top = random.Random(12), tmp_path_factory.mktemp("sf")
    item = " ".join(rng.choice(VOCABULARY[8:]) + str(k) for k in range(20))
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(VOCABULARY) + rng.choice("abcdefgh") for _ in range(rng.randrange(8, 60))]
        toxic = int(i % 6 == 0)
        if toxic:
            w[3:3] = [rng.choice(["vile", "awful", "wretch"])] * 2
        if i % 50 == 7:
            w[5:5] = item.split()
        rows.append((i, " ".join(w), "en", f"s{i % 3}" if i % 4 else "s0", None))
        labels.append((i, 1, toxic))
        if i % 10 == 3:
            rows.append((10_000 + i, " ".join([*w, "more"]) if len(w) > 30 else " ".join(w), "en", "s1", None))
    rows.append((20_000, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), [("1", item)]


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, folder):
    sf, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = f"{sf}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        outs.append(docs.collect())
    start = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in score_toxicity(start, fit_toxicity(start, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    clean, unique, decontaminated, mixed, tokens = outs
    assert all(list(r.__fields__) == columns for rows in outs[:4] for r in rows[:1])
    assert sorted(r.doc_id for r in clean) == sorted(i for i, p in scores.items() if not p) and len(clean) < start.count()

    sets = {r.doc_id: shingles(r.text) for r in clean}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in unique) == sorted({root(i) for i in ids}) and len(unique) < len(clean)

    assert sorted(r.doc_id for r in decontaminated) == sorted(r.doc_id for r in unique if not contamination(r.text, items)[4])
    assert len(decontaminated) < len(unique)

    sizes = {}
    for r in decontaminated:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    for s, t in targets_of(list(sizes.items())).items():
        assert abs(taken.get(s, 0) - t) <= 2 * max(len(words(r.text)) for r in decontaminated)

    t, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        own = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
        at += len(own)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens) == sorted(want)


def test_near_duplicates_of_repeated_and_null_ids(spark, tmp_path):
    a, b, c = ("one two three four five six seven " + " ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (3, None), (3, None), (4, c + " more")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, a), (2, b), (3, None), (3, None), (4, c + " more")], key=repr)
    alone = docs.where("doc_id is null and text is not null").limit(3)
    assert corpus_pipeline.near_duplicates(spark, alone, str(tmp_path)).count() == 2


CLASHES = ["row", "key", "kept", "score", "copies", "id", "n", "spans", "items", "n_words", "component_id", "label", "size", "target", "predicted"]


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "mixing"])
def test_stages_on_odd_tables(spark, folder, name):
    """Empty tables, columns named like those of the operators, null and repeated ids, a very long text."""
    sf, items = folder
    stage = dict(corpus_pipeline.STAGES)[name]
    kinds = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    extra = ["x"] * len(CLASHES)
    assert stage(spark, spark.createDataFrame([], kinds), sf).columns == ["doc_id", "text", "source", *CLASHES]
    clean = [" ".join(f"{w}{k}" for k in range(12)) for w in ("alpha", "beta", "gamma")]
    long = " ".join(f"long{k}" for k in range(150_000))
    rows = [(1, clean[0], "s"), (1, clean[1], "s"), (None, clean[2], None), (None, None, "s"), (2, "", "t"), (3, long, "t"), (1, items[0][1], "s"), (None, items[0][1] + " end", "s")]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], kinds)
    out = stage(spark, docs, sf).collect()
    got = sorted([(r.doc_id, r.text) for r in out], key=repr)
    assert all([r[c] for c in CLASHES] == extra for r in out)
    want = [(i, t) for i, t, _ in rows]
    if name == "decontamination":
        want = [r for r in want if not contamination(r[1], items)[4]]
        assert len(want) == len(rows) - 2
    if name == "near_duplicates":  # the two that hold the item are near copies: the one with an id stays
        want.remove((None, items[0][1] + " end"))
    if name == "mixing":
        assert got and set(got) <= set(want)
    else:
        assert got == sorted(want, key=repr)


def test_token_output_of_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (5, "x " * 100_000), (5, ""), (5, "y")], "doc_id long, text string")
    out = corpus_pipeline.token_output(spark, docs, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted([(str(r.doc_id), len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect()])
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == want and sorted(r.start for r in out)[0] == 0
    assert corpus_pipeline.token_output(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run(spark, folder):
    sf, _ = folder
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.agg(F.count("*")).first()[0] > 0
