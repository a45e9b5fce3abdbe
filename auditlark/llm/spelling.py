"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One edit leaves the front or the back half of a word as it is. So a word's near ones stand beside it either where all
words are sorted, in the block of its front half, or where all reversed words are, in the block of its back half. In a
block too large to compare, the rest behind the shared half has the one edit, and one half of that rest is whole again:
the block falls into smaller ones, by the front and by the back of the rests. Blocks are ranges of a sorted table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import documents_of, dropped, returning_memory, written

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, in lower case; the latter letters have two bytes, LEAD first.
RUN, LEAD = re.compile(rb"(?:[a-z]+|\xC3[\x80-\xBF])+"), b"\xC3"
#: Distinct words that a task counts before it hands them on.
MOST_WORDS = 200_000
#: Rows of a block that are compared with each other; larger blocks are divided while their rests have two letters.
MOST_IN_BLOCK = 32
#: Letters of two compared rests that are held at a time.
LETTERS = 4_000_000
ROWS = "block string, size int, rest string, longer boolean, word string, n long"
PAIRS = "a string, a_n long, b string, b_n long"


def word_counts(docs: DataFrame, least_length: int = 6, least_n: int = 5, slips: int | None = 199, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of Latin letters of whole texts, A-Z in lower case, that have the length and occur often enough.

    slips plants one misspelling in so many runs: where it divides h, the CRC of "<doc_id>:<run>", the letter at
    h % length goes. None plants nothing. A null text has no runs, a null doc_id is written as nothing. Tasks count their
    own words, MOST_WORDS at a time, before these meet.
    """
    rows = documents_of(docs, doc_id, text).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Counter(RUN.findall(text.as_py().lower())) if text.is_valid else {}  # of bytes, lower() changes A-Z alone
                before = zlib.crc32(f"{name}:".encode())
                for word, n in words.items():
                    if len(word) - word.count(LEAD) >= least_length:
                        if slips is not None and (h := zlib.crc32(word, before)) % slips == 0:
                            word = without_letter(word, h)
                        seen[word] += n
                if len(seen) > MOST_WORDS:
                    yield _counts(seen)
                    seen.clear()
        yield _counts(seen)

    words = rows.mapInArrow(returning_memory(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.length("word") >= least_length) & (F.col("n") >= least_n))


def without_letter(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counts(seen: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array(seen.keys(), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "n"])


def _halved(block: Column, text: Column, size: Column) -> Column:
    """The two blocks of a text by its front and by its back half, where the shorter texts of the block have size letters."""
    half = F.floor(size / 2).cast("int")

    def side(name: str, s: Column) -> Column:
        key = F.concat(block, F.lit(name), F.substring(s, F.lit(1), half))
        return F.struct(key.alias("block"), (size - half).cast("int").alias("size"), F.substring(s, half + 1, F.length(s)).alias("rest"))

    return F.explode(F.array(side("<", text), side(">", F.reverse(text))))


def first_blocks(words: DataFrame) -> DataFrame:
    """Each word in the blocks of its length, as one of the shorter words, and of the length below, as a longer one."""
    length = F.length("word")
    roles = F.explode(F.array(F.struct(length.alias("of"), F.lit(False).alias("longer")), F.struct((length - 1).alias("of"), F.lit(True).alias("longer")))).alias("role")
    rows = words.select("word", "n", roles).where("role.of > 0")
    return rows.select("word", "n", "role.longer", _halved(F.col("role.of").cast("string"), F.col("word"), F.col("role.of")).alias("x")).select("x.*", "longer", "word", "n")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a column as code points, and where each text begins."""
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _letters(points: np.ndarray, starts: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    at, size = starts[rows][:, None] + np.arange(width), (starts[rows + 1] - starts[rows])[:, None]
    return np.where(np.arange(width) < size, points[np.minimum(at, len(points) - 1)], 0)


def one_edit(points: np.ndarray, starts: np.ndarray, short: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether texts at short, and at other, as long or one longer, are exactly one edit apart."""
    out, size = np.zeros(len(short), bool), starts[other + 1] - starts[other]
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        ahead = size[order[at : at + LETTERS]] + 1
        now = order[at : at + max(1, int(np.searchsorted(ahead * np.arange(1, len(ahead) + 1), LETTERS, side="right")))]
        at += len(now)
        width = int(size[now].max(initial=1))
        a, b = _letters(points, starts, short[now], width), _letters(points, starts, other[now], width + 1)
        same = a == b[:, :width]
        front = np.where(same.all(axis=1), width, same.argmin(axis=1))  # the first place where they differ
        moved = (a == b[:, 1:]) | (np.arange(width) < front[:, None])  # behind the inserted letter
        longer = size[now] > starts[short[now] + 1] - starts[short[now]]
        out[now] = np.where(longer, moved.all(axis=1), (~same).sum(axis=1) == 1)
    return out


def _compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of whole blocks, in slices of bounded size."""
    block = table.column("block").combine_chunks()
    _, code = np.unique(block.to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    longer = table.column("longer").to_numpy(zero_copy_only=False).astype(bool)
    ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
    last = ends[np.searchsorted(ends, np.arange(len(code)), side="right")]  # behind each row's block
    points, starts = _codes(table.column("rest").combine_chunks())
    # shorter words stand before longer ones in a block, so the partners of a short word all stand behind it
    partners = np.where(longer, 0, last - np.arange(len(code)) - 1)
    done = np.concatenate(([0], np.cumsum(partners)))
    lo = 0
    while lo < len(code):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + LETTERS // 8, side="right")) - 1)
        count = partners[lo:hi]
        a = np.repeat(np.arange(lo, hi), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        near = one_edit(points, starts, a, b) if len(a) else np.zeros(0, bool)
        lo = hi
        if near.any():
            x, y = table.take(pa.array(a[near])), table.take(pa.array(b[near]))
            columns = [c.combine_chunks() for c in (x.column("word"), x.column("n"), y.column("word"), y.column("n"))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "a_n", "b", "b_n"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: the last block of a batch waits for the rest of its rows."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        block = table.column("block")
        cut, final = table.num_rows - 1, block[table.num_rows - 1].as_py()
        while cut and block[cut - 1].as_py() == final:
            cut -= 1
        kept = table.slice(cut)
        if cut:
            yield from _compare(table.slice(0, cut))
    if kept is not None:
        yield from _compare(kept)


def near_pairs(words: DataFrame, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """word_counts() -> a, a_n, b, b_n: each two words that are exactly one edit apart, once.

    Blocks are counted first: the rows of large ones are divided where they are and never meet in one task. What can't be
    divided shares all but one letter, so that the alphabet bounds it.
    """
    rows, pairs = written(first_blocks(words), "spelling"), None
    while True:
        large = written(rows.where("size > 1").groupBy("block").agg(F.count("*").alias("m")).where(F.col("m") > most_in_block).select("block"), "spelling")
        small = rows.join(large, "block", "left_anti").select("block", "rest", "longer", "word", "n")
        sorted_ = small.repartitionByRange("block").sortWithinPartitions("block", "longer", "word")
        found = written(sorted_.mapInArrow(returning_memory(_scan), PAIRS), "spelling")
        pairs = found if pairs is None else pairs.unionByName(found)
        if large.isEmpty():
            break
        again = rows.join(large, "block", "left_semi")
        divided = again.select(_halved(F.col("block"), F.col("rest"), F.col("size")).alias("x"), "longer", "word", "n").select("x.*", "longer", "word", "n")
        old, rows = rows, written(divided, "spelling")
        dropped(words.sparkSession, old)
    swap = F.col("a") > F.col("b")
    return pairs.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("a_n", "b_n"), ("b", "a"), ("b_n", "a_n")))).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root), the last of each word's forms. A form is so much more frequent than its word that no
    chain has more than 2 ** 5 links; each round doubles the links that are followed."""
    up = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(5):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        if up.join(above, "root", "left_semi").isEmpty():
            break
        up = written(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root")), "spelling-roots")
    return up


def spelling_groups(words: DataFrame, factor: int = 5, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """word_counts() -> one row per word: word, n, n_near, form, form_n, root.

    form is the most frequent near word (of equally frequent ones the first by code points), if it occurs factor
    times as often as the word; the root is found by following forms, and is the word itself if it has none. Without near
    words n_near is 0. No words give no rows.
    """
    if factor < 2:
        raise ValueError("forms of a factor below 2 can make circles")
    words = written(words, "spelling-words")
    pairs = near_pairs(words, most_in_block)
    sides = F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("o"), F.col("b_n").alias("k")), F.struct(F.col("b").alias("w"), F.col("a").alias("o"), F.col("a_n").alias("k")))).alias("x")
    best = pairs.select(sides).groupBy("x.w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.k")).alias("k"), F.col("x.o").alias("o"))).alias("best"))
    formed = F.col("best").isNotNull() & (-F.col("best.k") >= factor * F.col("n"))
    table = words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.o")).alias("form"), F.when(formed, -F.col("best.k")).alias("form_n"),
    )
    table = written(table, "spelling-forms")
    roots = roots_of(table.where("form IS NOT NULL"))
    return table.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
