"""N-gram Jaccard join by vertical partitioning.

The global order of shingles is cut into fragments; each fragment counts its part of an overlap by itself,
and the parts are summed. It serves three times:

1. Fragments of the hash order count, for each document, how many of its shingles occur anywhere else. A
   document that shares fewer than ``threshold * size`` shingles with all others together links with none.
2. Documents of equal sets collapse to one class; classes left order their shared shingles by frequency and
   hash, and only the rarest ``shared - ceil(threshold * size) + 1`` of each class (its prefix) propose pairs.
3. A proposed pair's overlap is summed over the fragments of the frequency order, and compared exactly.

Pairs are proposed as stars (the heaviest class of a prefix shingle with the others) for a few rounds, whose links
join classes to components, and at last all remaining pairs between different components are. So a group of
thousands of near copies costs about as many pairs as members, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlark.llm.common import documents_of, dropped, returning_memory, written
from auditlark.llm.components import connected_components
from auditlark.llm.kernels import U, blank_bytes, set_digests, shingles_of, slices, words_of

#: Documents and shingles of one chunk, within which a shingle is sent once.
CHUNK_DOCS, CHUNK_BYTES = 60_000, 6 << 20
#: Bytes of texts for each fragment: about 350,000 entries, so that the 32 bits that tell a fragment's shingles apart
#: leave one pair in ten thousand together, whatever the size of the input; and so that a worker holds little at a time.
FRAGMENT_BYTES = 2 << 20
PART = "frag int, chunk long, hashes binary, rows binary, doc_id array<long>, digest array<binary>, n array<int>, shared array<int>"
COUNTED = "chunk long, rows binary, counts binary, doc_id array<long>, digest array<binary>, n array<int>, shared array<int>"
SUMMED = "doc_id long, digest binary, n int, shared int"


def _parts(size: int, fragments: int):
    """Map side: each distinct shingle of a chunk once, dealt to fragments by its upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parting, ids, held, taken = blank_bytes(), [], [], 0
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), most_rows=CHUNK_DOCS // 2):
                ids.append(batch.column(0).slice(lo, hi - lo))
                held.append(shingles_of(words_of(data, offsets, parting), size))
                taken += len(data)
                if taken >= CHUNK_BYTES or sum(map(len, ids)) > CHUNK_DOCS // 2:
                    yield _chunk(ids, held, fragments)
                    ids, held, taken = [], [], 0
        if ids:
            yield _chunk(ids, held, fragments)

    return returning_memory(run)


PART_SCHEMA = pa.schema(
    [("frag", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("rows", pa.binary()), ("doc_id", pa.list_(pa.int64())),
     ("digest", pa.list_(pa.binary())), ("n", pa.list_(pa.int32())), ("shared", pa.list_(pa.int32()))]
)


def _chunk(ids: list[pa.Array], held: list[tuple[np.ndarray, np.ndarray]], fragments: int) -> pa.RecordBatch:
    values, n = np.concatenate([v for v, _ in held]), np.concatenate([np.diff(bounds) for _, bounds in held])
    bounds = np.concatenate(([0], np.cumsum(n)))
    digests = set_digests(values, bounds)
    # documents with equal sets count once, so that copies in a chunk add nothing
    keys = np.ascontiguousarray(digests).view("V16").ravel()
    _, first, same = np.unique(keys, return_index=True, return_inverse=True)
    chunk = int(set_digests(np.asarray(digests[:, 0]), np.array([0, len(digests)]))[0, 0].astype(np.int64)) ^ len(digests)
    leads = np.zeros(len(n), bool)
    leads[first] = True
    row_of = np.repeat(np.arange(len(n)), n)
    mine = leads[row_of]
    order = np.argsort(values[mine], kind="stable")
    sorted_values, sorted_rows = values[mine][order], row_of[mine][order]
    shared = np.zeros(len(n), np.int64)
    if len(sorted_values):
        new = np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(sorted_values)))
        shared += np.bincount(sorted_rows[np.repeat(sizes > 1, sizes)], minlength=len(n))
        send = sorted_values[starts]
        who = np.where(sizes == 1, sorted_rows[starts], 0xFFFF).astype(np.uint16)
        frag = ((send >> U(32)) * U(fragments)) >> U(32)
        # copies within the chunk link anyway: they take what their lead gets
    else:
        send, who, frag = np.zeros(0, U), np.zeros(0, np.uint16), np.zeros(0, U)
    copied = np.bincount(same, minlength=len(first))[same] > 1
    shared[copied] = n[copied]
    low = (send & U(0xFFFFFFFF)).astype(np.uint32)
    own, cuts = np.unique(frag, return_index=True)
    rows = [
        (f, chunk, low[a:b].tobytes(), who[a:b].tobytes(), None, None, None, None)
        for f, a, b in zip(own.tolist(), cuts, np.append(cuts, len(frag))[1:], strict=True)
    ]
    about = [digests[i].tobytes() for i in range(len(n))]
    rows.append((chunk % fragments, chunk, None, None, pa.concat_arrays(ids).to_pylist(), about, n.tolist(), shared.tolist()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PART_SCHEMA.types, strict=True)], schema=PART_SCHEMA)


def _counted(table: pa.Table) -> pa.Table:
    """Reduce side: a fragment's part of each document's count of shingles that occur in other chunks.

    One row for each chunk that the fragment has a part for; what a chunk says of its documents passes through.
    """
    chunks = table.column("chunk").to_numpy()
    about = table.filter(pc.is_null(table.column("hashes")))
    empty = pa.nulls(len(about), pa.binary())
    out = [pa.table([about.column("chunk"), empty, empty, *(about.column(c) for c in NAMES[3:])], schema=COUNTED_SCHEMA)]
    h, r = (_joined(table.column(c), kind) for c, kind in (("hashes", np.uint32), ("rows", np.uint16)))
    if len(h):
        sizes = pc.fill_null(pc.binary_length(table.column("rows")), 0).to_numpy() // 2
        order = np.argsort(h, kind="stable")
        s = h[order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:]
        hit = order[twice]
        del order, s, twice, h
        hit = hit[r[hit] != 0xFFFF]
        w = np.repeat(np.arange(len(sizes)), sizes)
        pair, count = np.unique(w[hit] << 16 | r[hit], return_counts=True)
        places, row, count = pair >> 16, (pair & 0xFFFF).astype(np.uint16), count.astype(np.uint32)
        own = np.unique(places)
        cuts = np.append(np.searchsorted(places, own), len(places))
        packed = [(int(chunks[k]), row[a:b].tobytes(), count[a:b].tobytes(), None, None, None, None) for k, a, b in zip(own, cuts, cuts[1:], strict=False)]
        if packed:
            out.append(pa.table([pa.array(c, t) for c, t in zip(zip(*packed, strict=True), COUNTED_SCHEMA.types, strict=True)], schema=COUNTED_SCHEMA))
    return pa.concat_tables(out)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The bytes of all values of a binary column, one behind the other, as numbers."""
    parts = [np.frombuffer(c.buffers()[2], np.uint8)[o[c.offset] : o[c.offset + len(c)]] for c in column.chunks if len(c) and c.buffers()[2] is not None for o in [np.frombuffer(c.buffers()[1], np.int32)]]
    return np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)


NAMES = ["chunk", "rows", "counts", "doc_id", "digest", "n", "shared"]
COUNTED_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("rows", pa.binary()), ("counts", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("digest", pa.list_(pa.binary())), ("n", pa.list_(pa.int32())), ("shared", pa.list_(pa.int32()))]
)


def _summed(table: pa.Table) -> pa.Table:
    """All fragments' parts of one chunk -> one row for each of its documents."""
    about = table.filter(pc.is_valid(table.column("doc_id")))
    parts = table.filter(pc.is_valid(table.column("rows")))
    out = []
    for ids, digests, n, shared in zip(*(about.column(c).to_pylist() for c in NAMES[3:]), strict=True):
        total = np.array(shared, np.int64)
        for rows, counts in zip(parts.column("rows").to_pylist(), parts.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(rows, np.uint16)] += np.frombuffer(counts, np.uint32)
        out.append(pa.table([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(n, pa.int32()), pa.array(total.astype(np.int32))], names=["doc_id", "digest", "n", "shared"]))
    return pa.concat_tables(out)


def _sets(size: int):
    """(doc_id, text) -> (digest, n, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parting = blank_bytes()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                values, bounds = shingles_of(words_of(data, offsets, parting), size)
                digests = set_digests(values, bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(np.diff(bounds).astype(np.int32)), lists], names=["digest", "n", "shingles"]
                )

    return returning_memory(run)


def _at_least(of, threshold: Fraction):
    """ceil(threshold * of) in whole numbers."""
    return F.expr(f"cast(({of} * {threshold.numerator}L + {threshold.denominator - 1}) div {threshold.denominator} as int)")


def ngram_join(
    docs: DataFrame, size: int = 5, threshold: float = 0.75, fragments: int | None = None, star_rounds: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of at least threshold.

    Returns one row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id of all that links
    reach), set_digest. Words part at blanks, A-Z count as a-z. A document of 1 to size-1 words is one shingle;
    one without words, or null, has none and links with nothing. Equal sets link. Rows with the same doc_id are
    rows of their own; a null doc_id counts only where a component has no other (component_id is then null).
    An empty table gives no rows. Columns besides the two are ignored.
    """
    t = Fraction(threshold).limit_denominator(1000)
    spark = docs.sparkSession
    docs = documents_of(docs, doc_id, text)
    if not fragments:
        size_of_all = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        fragments = max(1, -(-size_of_all // FRAGMENT_BYTES))
    parts = docs.mapInArrow(_parts(size, fragments), PART)
    counted = parts.groupBy("frag").applyInArrow(_counted, COUNTED)
    rows = written(counted.groupBy("chunk").applyInArrow(_summed, SUMMED), "ngram-rows")
    # one class for each set that may link at all
    need = _at_least("n", t)
    classes = written(
        rows.where((F.col("n") > 0) & (F.col("shared") >= need)).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")),
        "ngram-classes",
    )
    texts = docs.join(classes.select(F.col("doc_id").alias("id")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = texts.mapInArrow(_sets(size), "digest binary, n int, shingles array<long>")
    postings = (
        sets.join(classes.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]).select("digest", "n", F.explode("shingles").alias("h"))
    )
    postings = written(postings, "ngram-postings")
    # a table of its own: Spark can then split the join where one shingle has very many postings
    often = written(postings.groupBy("h").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "ngram-often")
    common = postings.join(often, "h")
    order = "row_number() over (partition by digest order by df, h)"
    common = written(
        common.select(
            "*",
            F.expr("count(*) over (partition by digest)").cast("int").alias("m"),
            (F.expr("sum(df) over (partition by digest)") / F.col("n")).alias("weight"),
            F.expr(order).alias("pos"),
        ).where(F.col("m") >= need),
        "ngram-common",
    )
    dropped(spark, postings, often)
    # a class of high weight shares most of its shingles with many others: the likely centre of their group
    prefix = common.where(F.col("pos") <= F.col("m") - need + 1).select("h", "digest", "n", "m", "pos", "weight", F.col("digest").alias("root"))
    tested, links, roots = None, None, None
    for _ in range(star_rounds):
        if roots is not None:
            prefix = _rooted(prefix, roots)
        pairs = _stars(prefix, t)
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = written(_overlaps(written(pairs, "ngram-stars"), common, t), "ngram-tested")
        tested = found if tested is None else tested.unionByName(found)
        links = tested.where("linked").select("a", "b")
        if not found.where("linked").limit(1).count():
            break
        roots = written(connected_components(links), "ngram-roots")
    # what is left: classes of different components that share a prefix shingle, but for those that their
    # distances to the same centre keep apart (the Jaccard distance obeys the triangle inequality)
    prefix = _rooted(prefix, roots) if roots is not None else prefix
    mixed = prefix.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("weight", "digest"))["digest"].alias("centre")).where("lo < hi")
    near = tested.select(F.explode(F.array(F.struct(F.col("a").alias("centre"), F.col("b").alias("digest"), "distance"), F.struct(F.col("b").alias("centre"), F.col("a").alias("digest"), "distance"))).alias("x")).select("x.*")
    mixed = prefix.join(mixed.select("h", "centre"), "h").join(near, ["centre", "digest"], "left")
    mixed = written(mixed.select("h", "digest", "n", "m", "pos", "root", F.when(F.col("digest") == F.col("centre"), 0.0).otherwise(F.col("distance")).alias("d")), "ngram-mixed")
    left, right = (mixed.select("h", *(F.col(c).alias(f"{side}_{c}") for c in ("digest", "n", "m", "pos", "root", "d"))) for side in "ab")
    apart = F.coalesce(F.abs(F.col("a_d") - F.col("b_d")), F.lit(0.0)) <= 1 - float(t) + 1e-9
    # an overlap's first shingle in the order leaves room for it among the shared shingles behind
    needed = F.expr(f"({t.numerator}L * (a_n + b_n) + {t.numerator + t.denominator - 1}) div {t.numerator + t.denominator}")
    room = F.expr("1 + least(a_m - a_pos, b_m - b_pos)") >= needed
    rest = (
        left.join(right, "h")
        .where((F.col("a_root") < F.col("b_root")) & _sized(t) & room & apart)
        .select(F.least("a_digest", "b_digest").alias("a"), F.greatest("a_digest", "b_digest").alias("b"), F.expr("if(a_digest < b_digest, a_n, b_n)").alias("a_n"), F.expr("if(a_digest < b_digest, b_n, a_n)").alias("b_n"))
        .distinct()
        .join(tested.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = written(_overlaps(written(rest, "ngram-rest"), common, t), "ngram-more").where("linked").select("a", "b")
    roots = written(connected_components(links.unionByName(more)), "ngram-roots")
    # back to documents: the smallest doc_id of each component
    named = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")).where("n > 0")
    named = named.join(roots, named["digest"] == roots["node"], "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select(F.col("digest").alias("of"), "component_id")
    return rows.join(named, F.col("digest") == F.col("of"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.hex("digest").alias("set_digest")
    )


def _sized(t: Fraction):
    """Whether the sizes a_n and b_n let a pair link."""
    return _at_least("greatest(a_n, b_n)", t) <= F.expr("least(a_n, b_n)")


def _rooted(prefix: DataFrame, roots: DataFrame) -> DataFrame:
    return prefix.drop("root").join(roots, prefix["digest"] == roots["node"], "left").select("h", "digest", "n", "m", "pos", "weight", F.coalesce("root", "digest").alias("root"))


def _stars(prefix: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of the heaviest class that has a prefix shingle with the heaviest one of every other component there."""
    best = prefix.groupBy("h", "root").agg(F.max(F.struct("weight", "digest", "n")).alias("x"))
    hubs = best.groupBy("h").agg(F.max("x").alias("hub"), F.count("*").alias("k")).where("k > 1")
    pairs = best.join(hubs, "h").where(F.col("x.digest") != F.col("hub.digest"))
    ordered = F.col("x.digest") < F.col("hub.digest")
    side = lambda name, first: F.when(ordered == first, F.col(f"x.{name}")).otherwise(F.col(f"hub.{name}"))
    return pairs.select(side("digest", True).alias("a"), side("digest", False).alias("b"), side("n", True).alias("a_n"), side("n", False).alias("b_n")).where(_sized(t)).distinct()


def _overlaps(pairs: DataFrame, common: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, overlap, linked): parts of each pair's overlap by fragment of the frequency order, summed."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    # a fragment: shingles of about the same frequency, in one of eight ranges of the hash
    fragment = F.expr("cast(log2(df) as int) * 8 + cast(shiftrightunsigned(h, 61) as int)")
    segments = common.join(involved, "digest", "left_semi").groupBy("digest", fragment.alias("f")).agg(F.collect_list("h").alias("seg"))
    left = pairs.join(segments.select(F.col("digest").alias("a"), "f", F.col("seg").alias("left")), "a")
    both = left.join(segments.select(F.col("digest").alias("b"), "f", F.col("seg").alias("right")), ["b", "f"])
    parts = both.select("a", "b", "a_n", "b_n", F.size(F.array_intersect("left", "right")).alias("part"))
    summed = parts.groupBy("a", "b", "a_n", "b_n").agg(F.sum("part").alias("overlap"))
    distance = (1 - F.col("overlap") / (F.col("a_n") + F.col("b_n") - F.col("overlap"))).alias("distance")
    return summed.select("a", "b", "overlap", distance, F.expr(f"{t.denominator}L * overlap >= {t.numerator}L * (a_n + b_n - overlap)").alias("linked"))
