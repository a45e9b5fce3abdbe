"""The operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditlark.llm import decontaminate, personal_data
from auditlark.llm.exact_dedup import exact_dedup
from auditlark.llm.mixing import mix, mixed_documents, targets_of
from auditlark.llm.ngram_join import ngram_join
from auditlark.llm.quality import fit_quality, score_quality
from auditlark.llm.token_counts import token_counts
from auditlark.llm.token_files import ShardReader, from_planes, read_token_files, to_planes, write_token_files
from auditlark.llm.toxicity import fit_toxicity, score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n int, h long, key long"
BLANK = re.compile(r"[\x20\x09-\x0D]+")
VOCABULARY = ["the", "Of", "tion", "ère", "naïve,", "x.", "über", "don't", "42", "日本", "sun", "moon", "red", "blue", "stone", "Rain"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in BLANK.split(lower(text or "")) if w]


def corpus():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "One", "two words", "two\twords ", "a b c d", "a b c d e", "\x1c odd\x85  space", "<|endoftext|> in  a text", "end ", " lead", "tab\t in\n\ntext", "it's  we'll \n x"]
    long = " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(6000))
    texts += [long, long + " tail", long.replace(" ", "  ", 3)]
    for g in range(12):
        base = [rng.choice(VOCABULARY) + rng.choice(["", str(g)]) for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    texts += texts[20:30] + ["one"] * 5
    rows = [(i * 7 % 1009, t, None if i % 9 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[40], rows[3]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(docs, rows):
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = ngram_join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((r[0], len(sets[r[0]]), root(r[0])) for r in rows)
    assert len({root(i) for i in ids}) < len(ids) - 20


def test_exact_dedup(docs, rows):
    groups = {}
    norm = lambda t: BLANK.sub(" ", t or "")
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = sorted((r[0], min(groups[norm(r[1])]), len(groups[norm(r[1])]), r[0] == min(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted(tuple(r) for r in exact_dedup(docs).collect()) == want


def test_exact_dedup_tells_equal_digests_apart(spark):
    """With a digest of one hexadecimal sign, most groups of equal digests hold several texts."""
    rng = random.Random(4)
    rows = [(k if k % 7 else None if k % 2 else k, rng.choice(["a", "b  c", "b c", "", None, "d\te"]) if k % 3 else f"text {rng.randrange(60)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANK.sub(" ", t or ""), []).append(i)
    want = sorted(((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=repr)
    got = exact_dedup(docs, digest_of=lambda t: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(t, 256), 1, 1))))
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got.collect()), key=repr) == want


def test_token_counts_and_their_cache(docs, rows, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = sorted((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 2048) for r in rows)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time all counts are stored
        assert sorted(tuple(r)[:4] for r in token_counts(docs, cache).collect()) == want
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert len({want_[3] for want_ in want}) == 2


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(docs, rows, planes):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = read_token_files(write_token_files(docs, planes=planes, block=512)).collect()
    at, want = 0, []
    for r in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_planes_round_trip():
    import numpy as np

    for n in (0, 1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        for planes in ("byte", "bit"):
            assert (from_planes(to_planes(ids, planes), n, planes) == ids).all()
    with pytest.raises(ValueError):
        import pyarrow as pa

        ShardReader(pa.BufferReader(b"no shard at all, but long enough to look"))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, window=13):
    w = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        v = WORD.findall(lower(item or ""))
        size = min(window, len(v))
        grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
        for k in range(len(w) - size + 1) if v else ():
            if tuple(w[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add(name)
    return len(w), len(hit), len(found), decontaminate.digest_of(list(found)), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most_words", [1_000_000, 60])
def test_decontamination(spark, docs, rows, most_words):
    rng = random.Random(1)
    pool = [r[1] for r in rows if r[1] and len(words(r[1])) > 20]
    items = [("9", None), ("8", ""), ("7", "..."), ("6", "one"), ("5", "two words"), ("55", "Sun, moon")]
    for k in range(12):
        w = words(rng.choice(pool))
        a = rng.randrange(len(w) - 15)
        items.append((str(100 + k), ", ".join(w[a : a + rng.randrange(8, 40)]) + "!"))
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    got = decontaminate.contract_columns(decontaminate.benchmark_matches(docs, bench, most_words=most_words)).collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], *contamination(r[1], items)) for r in rows)
    assert {r.contaminated for r in got} == {True, False}
    none = decontaminate.contract_columns(decontaminate.benchmark_matches(docs, bench.limit(0)))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)


def test_decontamination_of_shared_words(spark):
    """Items and documents of the same few words, with items in items, repeats and windows across documents' ends."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices("abcd", (8, 4, 2, 1), k=n))
    items = [(str(k), text(rng.choice([2, 5, 9, 12, 13, 14, 30]))) for k in range(30)]
    items += [("90", "a " * 20), ("91", items[0][1]), ("92", "zz " + items[3][1]), ("93", "only_here")]
    rows = [(k, text(rng.randrange(60))) for k in range(150)] + [(200 + k, " ".join([text(5), i[1], text(5)])) for k, i in enumerate(items)]
    rows += [(300, " ".join(i[1] for i in items) * 2), (301, "a " * 300), (302, "b only"), (303, "here only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    for most_words in (1_000_000, 40):
        got = decontaminate.contract_columns(decontaminate.benchmark_matches(docs, bench, most_words=most_words)).collect()
        assert sorted(tuple(r) for r in got) == sorted((r[0], *contamination(r[1], items)) for r in rows)


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. a b c d e f g h i j k l m! And this", "en"), (2, "clean", "fr"), (3, None, "de")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    out = decontaminate.without_spans(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "Keep this. ! And this"), (2, "clean"), (3, None)]


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_of(text):
    out = [(m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(PII) for m in pattern.finditer(text or "") if good(m[0])]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(out)), [sum(x[1] == k for x in out) for k in range(4)]


def test_base_personal_data(spark):
    rng = random.Random(3)
    parts = ["a.b@c.d", "x@y", "_d@e.f", "a@b.c_d@e.f", "1.2.3.4", "300.1.1.1", "007.01.0.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+49 (30) 123-456-78", "+1", "+1 2", "é", "日", "𝒳", " ", ",", "12345678901234567890", "@", ".", "00000000000000"]
    texts = [None, "", *("".join(rng.choice(parts) + rng.choice(["", " ", " word "]) for _ in range(rng.randrange(1, 12))) for _ in range(300)), "9" * 20_000, "a" * 50_000 + "@"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in personal_data.contract_columns(personal_data.find_personal_data(docs)).collect():
        spans, counts = base_of(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert {s for s in spans.split(",") if s} <= set(r.spans.split(","))


def test_context_finds_unseen_identifiers(spark):
    """Nine hosts after the same words teach the pattern; the tenth, no address by its numbers, is found by it."""
    texts = [f"note {i} the host at 10.0.{i}.{i + 7}, today" for i in range(9)] + ["then the host at 999.1.2.3, again", "we met the host at 1999 there", "then some thing by 999.1.2.3, again"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100, texts[9])], "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.contract_columns(personal_data.find_personal_data(docs)).collect()}
    assert got[9].spans == got[100].spans == "ip:17:26" and (got[9].n_ip, got[9].n_added) == (0, 1)
    assert got[10].spans == "" and got[11].spans == "" and got[0].spans == f"ip:{texts[0].index('10.')}:{texts[0].index(',')}"


def test_context_finds_identifiers_with_blanks(spark):
    """Cards and phones written with blanks, wrong or short by their numbers, are marked whole by what stands before."""
    cards = [f"4{i:03d} 1111 1111 1{i:03d}" for i in range(200)]
    seeds = [c for c in cards if base_of(c)[1][2]][:6]
    texts = [f"my card number {c}, thanks" for c in seeds] + [f"call me on +49 30 12345{i:02d} today" for i in range(6)]
    unseen = ["so my card number 4111 1111 1111 1112, thanks", "please call me on +49 30 1234 today", "please call me on +49 30 1234. 7 came", "chapter 4111 1111 1111 1112", "my card number 12 and call me on 1999", "call me on +49 30 1234\t5"]
    docs = spark.createDataFrame(list(enumerate(texts + unseen)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.contract_columns(personal_data.find_personal_data(docs)).collect()}
    assert len(seeds) == 6 and all(got[i].n_added == 0 and len(got[i].spans.split(",")) == 1 for i in range(len(texts)))
    assert [got[len(texts) + i].spans for i in range(len(unseen))] == ["card:18:37", "phone:18:29", "phone:18:29", "", "", "phone:11:22"]


def test_identifiers_that_others_hide(spark):
    """A card behind a phone makes one number of both, which is neither; what stands before the phone marks that one."""
    cards = [c for i in range(400) if base_of(c := f"4111111111{i:06d}")[1][2]][:12]
    texts = [f"{'w' * (i + 1)} {c} and" for i, c in enumerate(cards[:8])] + [f"so +1 (212) 555-01{i:02d} v" for i in range(8)] + [f"so +1 (212) 555-0199 {cards[9]} there"]
    got = personal_data.contract_columns(personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    last = max(got, key=lambda r: r.doc_id)
    assert (last.n_card, last.n_phone, last.n_added, last.spans) == (0, 0, 1, "phone:3:20")
    assert all(r.n_added == 0 for r in got if r.doc_id < 16)


def test_many_numbers_in_one_text(spark):
    text = " ".join(f"{1000 + k}." if k % 3 else f"1.2.3.{k % 256}" for k in range(20_000))
    got = personal_data.contract_columns(personal_data.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    spans, counts = base_of(text)
    assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == counts and got.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def plain_discovery(edges, rounds, least, sure):
    """What discovered() finds, by loops."""
    def parts(word, before):
        rough = re.sub(" +", " ", re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", word)))
        last, prefix = before.split(" ")[-1] if before else "", re.match("[^=:0-9]*[=:][\"']?", word.lower())
        return {*([("2:" + before, rough)] if before != last else []), *([("1:" + last, rough)] if last else []), *([("=:" + prefix[0], rough)] if prefix else [])}

    rich = lambda word: len(re.sub("[^0-9]", "", word)) >= 4 or "@" in word
    seed = {}
    for _, _, _, word, before, kind in edges:
        for p in parts(word, before):
            seed[p, word] = max((x for x in (seed.get((p, word)), kind) if x is not None), default=None)
    trust = {pair: float(k is not None) for pair, k in seed.items()}
    steps = 0
    while True:
        steps, score = steps + 1, dict(trust)
        for r in range(rounds):
            by = {}
            for (p, word), v in score.items():
                by.setdefault(p, []).append((v, seed[p, word]))
            sure_of = {}
            for p, held in by.items():
                kinds = [k for _, k in held if k is not None]
                if len(kinds) >= least:
                    sure_of[p] = sum(v for v, _ in held) / len(held), min(k for k in kinds if kinds.count(k) == max(map(kinds.count, kinds)))
            if r < rounds - 1:
                for pair in score:
                    doubts = [max(1e-9, 1 - sure_of[p][0]) for p, w in score if w == pair[1] and p in sure_of]
                    score[pair] = max(trust[pair], 1 - math.prod(doubts) if doubts else 0.0)
        new = {}
        for (p, word), k in seed.items():
            if k is None and rich(word) and p in sure_of and sure_of[p][0] >= sure:
                new[word] = min(new.get(word, (0, 9)), (-sure_of[p][0], sure_of[p][1]))
        if not new:
            break
        for pair, k in seed.items():
            if k is None and pair[1] in new:
                trust[pair], seed[pair] = -new[pair[1]][0], new[pair[1]][1]
    out = set()
    for key, start, end, word, before, kind in edges:
        best = [(-sure_of[p][0], sure_of[p][1]) for p in parts(word, before) if p in sure_of and sure_of[p][0] >= sure]
        if kind is None and best and rich(word):
            out.add((key, start, end, min(best)[1]))
    return out, steps


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_discovery_scores(spark, rounds):
    rng = random.Random(rounds)
    edges = []
    for k in range(400):
        word = rng.choice(["{}.{}.{}.{}", "{} {}", "a{}", "key={}", "{}@x"]).format(*(rng.randrange(1, 4000) for _ in range(4)))
        known = next((e[5] for e in edges if e[3] == word), rng.choice([None, 1, 2]) if "." in word or "=" in word else None)
        edges.append((k % 90, k * 10, k * 10 + len(word), word, rng.choice(["", "at", "host at", "call me", "no"]), known))
    frame = spark.createDataFrame(edges, "key long, start int, end int, word string, before string, seed int")
    got = {tuple(r) for r in personal_data.discovered(frame, rounds, 3, 0.55).collect()}
    want, steps = plain_discovery(edges, rounds, 3, 0.55)
    assert got == want and got and steps > 1


def test_findings_are_seeds_and_planted_identifiers(spark):
    """Hosts that no fixed pattern takes (a part above 255): the first context has seeds; the second one holds numbers
    that only the first tells, the third those of the second. Others look alike, in contexts without seeds."""
    rng = random.Random(4)
    host = lambda bad: ".".join(str(rng.randrange(1, 255)) for _ in range(3)) + f".{rng.randrange(300, 999) if bad else rng.randrange(1, 255)}"
    first, second, third = [host(True) for _ in range(8)], [host(True) for _ in range(8)], [host(True) for _ in range(3)]
    texts = [f"n{k} please reach server {host(False)} now" for k in range(90)] + [f"please reach server {h} now" for h in first]
    start = len(texts) - len(first)
    texts += [f"the machine named {h} is up" for h in [*first, *second]] + [f"log of node {h} here" for h in [*second, *third]]
    marked = set(range(start, len(texts)))
    texts += [f"see chapter {host(True)} for it" for _ in range(20)] + [f"word{k} {host(True)} and" for k in range(20)] + [f"the version of {h} is old" for h in first[:1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r.doc_id for r in personal_data.contract_columns(personal_data.find_personal_data(docs)).collect() if r.n_added}
    assert added == marked


def test_targets():
    assert targets_of([]) == {}
    got = targets_of([("b", 10), ("a", 10), (None, 100)])
    assert got == {"a": 20.0, "b": 30.0, None: 70.0} or sum(got.values()) == pytest.approx(120)
    capped = targets_of([("a", 1000), ("b", 10), (None, 0)])
    assert capped["b"] == 30 and capped[None] == 0 and capped["a"] == pytest.approx(980)


def test_mixing(docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    targets = targets_of(list(sizes.items()))
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in targets.items():
        biggest = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - t) <= 2 * biggest
    key = lambda r: (r.doc_id, r.key, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mix(docs.repartition(5)).collect()))
    out = mixed_documents(docs, mix(docs))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_flight_keeps_sums():
    import numpy as np

    from auditlark.llm.mixing import draws, flight, land

    rng = np.random.default_rng(2)
    p, size = rng.random(500), rng.integers(0, 1000, 500)
    out = flight(p, size, draws(1))
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert set(land(out, size, draws(2))) <= {0.0, 1.0}
    mean = np.mean([land(flight(p[:9], size[:9], draws(k)), size[:9], draws(k + 10_000)) for k in range(3000)], axis=0)
    assert np.abs(mean - p[:9]).max() < 0.05


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(VOCABULARY) + rng.choice("abcdef") for _ in range(rng.randrange(5, 60))]
        toxic, quality = int(i % 5 == 0), int(i % 7 != 0)
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "awful", "wretch"]))
        if not quality:
            w = [w[0]] * len(w)
        rows.append((i, " ".join(w), 1.0))
        if i % 3:
            labels.append((i, quality, toxic))
    rows += [(5000, None, 1.0), (5001, "", 1.0), (None, "vile", 1.0)]
    labels += [(None, 1, 1), (5001, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    model = fit_toxicity(docs, labels)
    assert 0 < len(model.index) < 5000
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == docs.count()
    out = [(i, r) for i, r in got.items() if i is not None and i < 1200 and r.held_out]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out for i, r in got.items() if i is not None)
    assert sum(r.predicted == (i % 5 == 0) for i, r in out) / len(out) > 0.9  # 640 short rows to learn from
    assert got[5000].score == got[5001].score < 0.5
    none = score_toxicity(docs, fit_toxicity(docs, labels.limit(0)))
    assert none.where("predicted = 1").count() == 0


def test_accuracy_on_the_test_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic = score_toxicity(docs, fit_toxicity(docs, labels)).where("held_out").join(labels, "doc_id")
    r = toxic.agg(F.count("*").alias("n"), F.count_if(F.expr("predicted = toxic")).alias("right"), F.count_if(F.expr("predicted = 1 and toxic = 0")).alias("false_alarms")).first()
    assert r.n > 500 and r.right / r.n > 0.97 and r.false_alarms / r.n < 0.01
    good = score_quality(docs, fit_quality(docs, labels)).where("held_out").join(labels, "doc_id")
    r = good.agg(F.count("*").alias("n"), F.count_if(F.expr("selected = (quality = 1)")).alias("right")).first()
    assert r.right / r.n > 0.9


def test_quality_held_out(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    out = [(i, r) for i, r in got.items() if i is not None and i < 1200 and r.held_out]
    assert sum(r.selected == (i % 7 != 0) for i, r in out) / len(out) > 0.9
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())
    assert score_quality(docs, fit_quality(docs, labels.limit(0))).count() == docs.count()


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for made in (
        ngram_join(empty), exact_dedup(empty), token_counts(empty), read_token_files(write_token_files(empty)), decontaminate.benchmark_matches(empty, bench),
        personal_data.find_personal_data(empty), mix(empty), score_toxicity(empty, fit_toxicity(empty, labels)), score_quality(empty, fit_quality(empty, labels)),
    ):
        assert made.count() == 0
