"""Vector graphs, spelling variants and vector codes against brute force: nulls, ties, repeated rows, masses of copies."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from auditlark.llm import queries, spelling
from auditlark.llm.hnsw import Graph, audited_beam, unit
from auditlark.llm.spelling import near_pairs, spelling_groups, word_counts
from auditlark.llm.vector_codes import Codebooks, reassign, squares, vector_codes
from auditlark.llm.vector_dedup import vector_dedup

VECTORS = "vec_id long, embedding array<float>, label int, v int, n long, entry string, block long, id string"
DOCS = "doc_id long, text string, n long, word string, block int"


def same(got, want):
    """Rows of Spark and of DuckDB, whatever their order and that of columns."""
    columns = sorted(got.columns)
    return Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.select(", ".join(columns)).fetchall())


@pytest.mark.parametrize("name", ["op11_vector_dedup", "op12_spelling_variants", "op13_vector_codes"])
def test_statements(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    assert same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), duck.sql(queries.ORACLE[name]))


def turned(rng, v, cosine):
    """A vector at this cosine from v."""
    z = rng.normal(size=len(v))
    z -= z @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


@pytest.fixture(scope="module")
def vectors():
    """A mass of near copies, a chain, pairs on both sides of the threshold, equal ones, other sizes, and unsound ones."""
    rng = np.random.default_rng(4)
    out = list(rng.normal(size=(250, 24)))
    for spread in (0.03, 0.12, 0.2):  # balls, and masses wider than a ball
        mass = rng.normal(size=24)
        out += [mass / np.linalg.norm(mass) + spread * rng.normal(size=24) / math.sqrt(24) for _ in range(90)]
    chain = rng.normal(size=24)
    for _ in range(12):
        chain = turned(rng, chain, 0.96)
        out.append(chain)
    out += [turned(rng, out[i], c) for i in range(40) for c in (0.9505, 0.9495)]
    rows = [(i * 13 % 1009, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]
    rows += [(2000 + i, rows[i % 3][1]) for i in range(60)] + [rows[5], rows[300]]
    rows += [(3000 + i, [2.0 * x for x in rows[i][1]]) for i in range(5)]
    rows += [(4000, [1.0, 0.0]), (4001, [1.0, 0.001]), (4002, [1.0]), (4003, [1e-30, 1e-30]), (4004, [1e30, 1e30]), (None, rows[7][1])]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [float("inf")] + [0.0] * 23), (5005, [None] + [1.0] * 23)]
    return [(i, v, None if k % 3 == 0 else k % 4, 1, 2, "x", 3, "y") for k, (i, v) in enumerate(rows)]


def expected_links(rows, least=0.95):
    kept = [(k, np.array(r[1])) for k, r in enumerate(rows) if r[0] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, a) in enumerate(kept):
        for j, b in kept[:x]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r[0])
    return Counter((r[0], n[k], c := min((i for i in groups[find(k)] if i is not None), default=None), r[0] == c or r[0] is None) for k, r in enumerate(rows))


@pytest.mark.parametrize("shard_rows, block_rows", [(16_384, 4_096), (100, 60)])
def test_vector_links(spark, vectors, shard_rows, block_rows):
    got = vector_dedup(spark.createDataFrame(vectors, VECTORS).repartition(3), shard_rows=shard_rows, block_rows=block_rows)
    assert Counter(map(tuple, got.collect())) == expected_links(vectors)


def test_graph_recall_and_audit():
    rng = np.random.default_rng(8)
    v = unit(rng.normal(size=(4000, 32))).astype(np.float32)
    graph = Graph(v, rng.integers(0, 2**63, 4000), 0.98)
    queries_ = np.stack([turned(rng, x.astype(float), 0.951) for x in v[:300]]).astype(np.float32)
    q, node = graph.within(queries_, 0.9, audited_beam(graph, 0.9, 0.95, 1, 0.999, 200))
    assert len({(a, b) for a, b in zip(q, node) if a == b}) >= 297
    again = Graph.from_bytes(v, graph.to_bytes())
    assert all((a == b).all() for a, b in zip(again.within(queries_, 0.9, 32), graph.within(queries_, 0.9, 32)))
    one = np.repeat(v[:1], 500, axis=0)
    assert len(Graph(one, np.arange(500), 0.98).layers[0].nodes) == 1


def lloyd(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * c) for c in r[1]]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([[math.floor(4096 * c) for c in r[1]] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        gap = np.stack([squares(x[:, p], books[p]) for p in range(parts)], axis=1)
        entry = gap.argmin(axis=2)
        for p in range(parts) if r < rounds else ():
            for e in range(books.shape[1]):
                if (mine := x[entry[:, p] == e, p]).size:
                    books[p, e] = [sum(map(int, column)) // len(mine) for column in mine.T]
    error = np.take_along_axis(gap, entry[:, :, None], axis=2).sum(axis=(1, 2)).tolist()
    labels = Counter()
    for r, e in zip(kept, error, strict=True):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()
    return Counter((r[0], "".join(f"{e:02x}" for e in codes), e, labels[r[2]], digest) for r, codes, e in zip(kept, entry.tolist(), error, strict=True))


def test_vector_codes(spark, vectors):
    rows = [r for r in vectors if not r[1] or len(r[1]) == 24]
    rows += [(6000 + i, [float(i % 2)] * 24, 1, 1, 2, "x", 3, "y") for i in range(30)] + [(-1, [-0.5] * 24, None, 1, 2, "x", 3, "y")]
    frame = spark.createDataFrame(rows, VECTORS)
    assert Counter(map(tuple, vector_codes(frame.repartition(3)).collect())) == lloyd(rows)
    few = rows[:5] + rows[:2]
    assert Counter(map(tuple, vector_codes(spark.createDataFrame(few, VECTORS)).collect())) == lloyd(few)
    with pytest.raises(Exception, match="a component is"):
        vector_codes(spark.createDataFrame([(1, [1e6] * 8, 1, 1, 2, "x", 3, "y")], VECTORS)).collect()


def test_bounds_skip_scans_and_keep_ties():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (2000, 2, 3))
    books = Codebooks(np.ascontiguousarray(x[:8].transpose(1, 0, 2)), np.zeros((2, 8)))
    books.entries[:, 3] = books.entries[:, 1]  # equal entries: always a tie
    state, scans = (np.zeros((2000, 2), int), np.full((2000, 2), np.inf), np.zeros((2000, 2))), []
    for _ in range(12):
        *state, made = reassign(x, *state, books)
        scans.append(made)
        best = np.stack([squares(x[:, p], books.entries[p]).argmin(axis=1) for p in range(2)], axis=1)
        assert (state[0] == best).all()
        new = books.entries.copy()
        for p in range(2):
            for e in range(8):
                if (mine := x[best[:, p] == e, p]).size:
                    new[p, e] = mine.sum(axis=0) // len(mine)
        books = Codebooks(new, np.sqrt(((new - books.entries) ** 2).sum(axis=2)))
    assert scans[-1] < 2000 < scans[0]


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_groups(counts, factor=5):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {w: f if (f := min(vs, key=lambda v: (-counts[v], v), default=None)) and counts[f] >= factor * counts[w] else None for w, vs in near.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return Counter((w, n, len(near[w]), form[w], form[w] and counts[form[w]], root(w)) for w, n in counts.items())


def expected_counts(rows, least_length=6, least_n=5, slips=199):
    seen = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slips == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least_length and n >= least_n}


def corpus():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéÀÿ") for _ in range(rng.randrange(5, 9))) for _ in range(120)] + ["straße", "ÉCOLES", "Banana", "a" * 5000, "ba" * 2500]
    texts = [None, "", "日本 \x00 '", "x" * 100_000 + "ж"]
    for i in range(400):
        picked = rng.choices(stems, weights=[1 / (k + 1) for k in range(len(stems))], k=40)
        texts.append(rng.choice([" ", "-", "42", "'", "ж"]).join(picked))
    rows = [(None if i == 9 else i // 2, t, 1, "w", 2) for i, t in enumerate(texts)]
    return rows + [rows[20]]


@pytest.mark.parametrize("slips, most", [(199, 32), (7, 3)])
def test_spelling(spark, slips, most):
    rows = corpus()
    counts = expected_counts(rows, slips=slips)
    words = word_counts(spark.createDataFrame(rows, DOCS).repartition(3), slips=slips)
    assert dict(map(tuple, words.collect())) == counts
    want = expected_groups(counts)
    assert Counter(map(tuple, spelling_groups(words, most_in_block=most).select("word", "n", "n_near", "form", "form_n", "root").collect())) == want
    assert sum(form is not None for _, _, _, form, _, _ in want) > (1 if slips == 199 else 10)


def test_one_block_is_divided(spark):
    """All words share long halves: blocks fall apart by the fronts and backs of their rests, until letters are left."""
    letters = "abcdefghij"
    words = {f"{a}common{b}{c}tail{d}": 5 + i for i, (a, b, c, d) in enumerate((a, b, c, d) for a in letters[:4] for b in letters[:5] for c in letters[:5] for d in letters[:5])}
    words |= {w[:-1]: 3 for w in list(words)[:60]} | {"x": 1, "xy": 1, "y": 9, "": 1}
    del words[""]
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {(r.a, r.b) for r in near_pairs(frame, 4).collect()}
    assert pairs == {(a, b) for a in words for b in words if a < b and edits(a, b)}
    assert spelling.MOST_IN_BLOCK < len(words)


def test_chains_and_empty_tables(spark):
    chain = {f"chain{'x' * i}": 5**i for i in range(1, 14)} | {"alone": 5}
    got = {r.word: r for r in spelling_groups(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert all(r.root == (f"chain{'x' * 13}" if w != "alone" else "alone") for w, r in got.items())
    none = spark.createDataFrame([], VECTORS)
    for made in (vector_dedup(none), vector_codes(none), spelling_groups(word_counts(spark.createDataFrame([], DOCS)))):
        assert made.count() == 0
    only_odd = spark.createDataFrame([(1, None, 1, 1, 2, "x", 3, "y"), (None, [1.0], 1, 1, 2, "x", 3, "y")], VECTORS)
    assert sorted(vector_dedup(only_odd).collect(), key=str) == sorted([(1, 0, 1, True), (None, 0, None, True)], key=str)
    assert vector_codes(only_odd).count() == 0
