"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton reads a document word by word and tracks the longest match with any item. A hit needs a whole window,
so numpy first compares the hashes of all runs of a window's length with those of the items' windows, whatever words
the benchmark and the documents share; the automaton reads the stretches that such runs cover.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import documents_of, returning_memory, small_batches, written
from auditlark.llm.kernels import BASE, Words, mixed, non_alphanumeric_bytes, slices, words_of

#: Words of stretches whose readings a task remembers at most; beyond it the memory starts anew.
MOST_READ = 1_000_000


def run_hashes(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length up to longest: hashes of that many consecutive words, by the word where they begin."""
    factors = mixed(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    value = np.zeros(len(words), np.uint64)
    for k in range(min(longest, len(words))):
        value = value[: len(words) - k] + words[k:] * factors[k]
        yield k + 1, value


class HashSet:
    """A sorted set of hashes with a table of their upper bits, which most other hashes miss."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        bits = min(24, max(16, len(values).bit_length() + 4))
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[self._upper(self.values)] = True

    def _upper(self, values: np.ndarray) -> np.ndarray:
        return (values >> self.shift).astype(np.int64)

    def places(self, values: np.ndarray) -> np.ndarray:
        """Which of values are members."""
        maybe = np.flatnonzero(self.seen[self._upper(values)])
        at = np.minimum(np.searchsorted(self.values, values[maybe]), len(self.values) - 1)
        return maybe[self.values[at] == values[maybe]]


class SuffixAutomaton:
    """All factors of several word sequences, in flat arrays of numbers (about 50 bytes a word).

    Words are codes, their places in the sorted vocabulary of hashes. Most states have one move, which lies in two
    arrays; the moves beyond lie in one table by state and code.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        """items: names and word hashes; those without words count for nothing."""
        items = [(name, words) for name, words in items if len(words)]
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary = np.unique(np.concatenate([words for _, words in items])) if items else np.zeros(0, np.uint64)
        self.runs = self._runs([words for _, words in items])
        self.only, self.to = array("i", [-1]), array("i", [-1])
        self.link, self.length = array("i", [0]), array("i", [0])
        self.more: dict[int, int] = {}
        self.branches: dict[int, list[int]] = {}  # codes of a state's further moves, for copies
        ends, sizes = array("q"), array("i")  # state << 32 | item, for each prefix of an item
        for k, (_, words) in enumerate(items):
            last = 0
            for w in np.searchsorted(self.vocabulary, words).tolist():
                last = self._extend(last, w)
                ends.append(last << 32 | k)
            sizes.append(len(words))
        self._finish(np.array(ends, np.int64), np.array(sizes, np.int64))

    def _runs(self, items: list[np.ndarray]) -> dict[int, HashSet]:
        """The hashes of all windows by their length: the window's, or that of a shorter item."""
        first = np.concatenate(([0], np.cumsum([len(words) for words in items]))).astype(np.int64)
        sizes, out = np.diff(first), {}
        for length, value in run_hashes(np.concatenate(items), self.window) if items else ():
            if length < self.window:
                at = first[:-1][sizes == length]
            else:
                at = np.arange(len(value))
                at = at[at + length <= first[np.searchsorted(first, at, side="right")]]
            if len(at):
                out[length] = HashSet(value[at])
        return out

    def stretches(self, w: Words) -> list[tuple[int, int, int]]:
        """(document, from, to) of runs of words outside of which no window occurs, by place; none is across documents."""
        begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, value in run_hashes(w.hash, max(self.runs, default=0)):
            if length in self.runs:
                at = self.runs[length].places(value)
                at = at[at + length <= w.first[np.searchsorted(w.first, at, side="right")]]
                begins.append(at)
                ends.append(at + length)
        begin = np.concatenate(begins)
        order = np.argsort(begin, kind="stable")
        begin, reach = begin[order], np.maximum.accumulate(np.concatenate(ends)[order])
        new = np.flatnonzero(np.concatenate(([True], begin[1:] >= reach[:-1]))) if len(begin) else np.zeros(0, np.int64)
        stop = reach[np.append(new[1:] - 1, len(reach) - 1)] if len(begin) else new
        return list(zip((np.searchsorted(w.first, begin[new], side="right") - 1).tolist(), begin[new].tolist(), stop.tolist(), strict=True))

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Places of word hashes in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def _move(self, state: int, w: int) -> int:
        return self.to[state] if self.only[state] == w else self.more.get(state * len(self.vocabulary) + w, -1)

    def _set(self, state: int, w: int, to: int) -> None:
        if self.only[state] in (-1, w):
            self.only[state], self.to[state] = w, to
        else:
            key = state * len(self.vocabulary) + w
            if key not in self.more:
                self.branches.setdefault(state, []).append(w)
            self.more[key] = to

    def _new(self, length: int, link: int) -> int:
        for column, value in ((self.only, -1), (self.to, -1), (self.link, link), (self.length, length)):
            column.append(value)
        return len(self.only) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q that stands for its factors of at most length[p] + 1 words."""
        copy = self._new(self.length[p] + 1, self.link[q])
        for code in ([self.only[q]] if self.only[q] >= 0 else []) + self.branches.get(q, []):
            self._set(copy, code, self._move(q, code))
        self.link[q] = copy
        while self._move(p, w) == q:
            self._set(p, w, copy)
            if not p:
                break
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (q := self._move(last, w)) >= 0:  # the sequence so far is a factor already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.length[last] + 1, 0), last
        while self._move(p, w) < 0:
            self._set(p, w, state)
            if not p:
                return state
            p = self.link[p]
        q = self._move(p, w)
        self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _finish(self, ends: np.ndarray, sizes: np.ndarray) -> None:
        """Arrays for reading: each state's window (the state of its last window words), the items of each window,
        and where short items end."""
        self.only, self.to, self.link, self.length = (np.array(x, np.int32) for x in (self.only, self.to, self.link, self.length))
        keys = np.fromiter(self.more.keys(), np.int64, len(self.more))
        order = np.argsort(keys)
        more_to = np.fromiter(self.more.values(), np.int32, len(keys))[order]
        del self.more, self.branches
        short_end = np.zeros(len(self.link), bool)
        state, item = ends >> 32, ends & 0xFFFFFFFF
        whole = (sizes[item] < self.window) & (self.length[state] == sizes[item])
        short_end[state[whole]] = True
        self.at_window, self.short = np.zeros(len(self.link), np.int32), np.zeros(len(self.link), np.int32)
        for s in np.argsort(self.length, kind="stable")[1:].tolist():
            up = self.link[s]
            self.at_window[s] = self.at_window[up] or (s if self.length[s] >= self.window else 0)
            self.short[s] = s if short_end[s] else self.short[up]
        self.window_items = self._grouped(self.at_window[state], item, self.at_window[state] > 0)
        self.short_items = self._grouped(state, item, whole)
        # plain arrays give Python its numbers several times faster
        self.more_keys = array("q", keys[order].tobytes())
        self.only, self.to, self.link, self.length, self.at_window, self.short, self.more_to = (
            array("i", x.tobytes()) for x in (self.only, self.to, self.link, self.length, self.at_window, self.short, more_to)
        )

    @staticmethod
    def _grouped(state: np.ndarray, item: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of those chosen, sorted: states, items."""
        pairs = np.unique(state[chosen].astype(np.int64) << 32 | item[chosen])
        return (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)

    @staticmethod
    def _of(grouped: tuple[np.ndarray, np.ndarray], wanted: set[int]) -> set[int]:
        """The items of the states wanted."""
        states, items = grouped
        lo, hi = (np.searchsorted(states, np.fromiter(wanted, np.int32, len(wanted)), side=side) for side in ("left", "right"))
        size = hi - lo
        return set(np.unique(items[np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)]).tolist())

    def _read_move(self, state: int, w: int) -> int:
        if self.only[state] == w:
            return self.to[state]
        key = state * len(self.vocabulary) + w
        at = bisect_left(self.more_keys, key)
        return self.more_to[at] if at < len(self.more_keys) and self.more_keys[at] == key else -1

    def read(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (from, to) of words that a window covers, and the items of those windows. Codes are of codes()."""
        state = run = 0
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()
        shorts: set[int] = set()
        for i, w in enumerate(codes):
            if w < 0:
                state = run = 0
                continue
            while (to := self._read_move(state, w)) < 0 and state:
                state = self.link[state]
                run = self.length[state]
            if to < 0:
                continue
            state, run = to, run + 1
            if run >= self.window:
                windows.add(self.at_window[state])
                spans.append((i + 1 - run, i + 1))
            at, longest = self.short[state], 0
            while at:
                if self.length[at] <= run:
                    shorts.add(at)
                    longest = longest or self.length[at]
                at = self.short[self.link[at]]
            if longest:
                spans.append((i + 1 - longest, i + 1))
        return joined(spans), self._of(self.window_items, windows) | self._of(self.short_items, shorts)


def _words(column: pa.Array) -> Iterator[tuple[int, int, object]]:
    parting = non_alphanumeric_bytes()
    for lo, hi, data, offsets in slices(column):
        yield lo, hi, words_of(data, offsets, parting)


def automata(benchmark: DataFrame, window: int, most_words: int, item_id: str = "item_id", text: str = "text") -> Iterator[SuffixAutomaton]:
    """The items in blocks of at most most_words words (or one longer item); each block has an automaton, made in turn."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    held, size = [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        for _, _, w in _words(pa.array([row.text], pa.string())):
            if held and size + len(w.hash) > most_words:
                yield SuffixAutomaton(held, window)
                held, size = [], 0
            held.append((row.id, w.hash))
            size += len(w.hash)
    yield SuffixAutomaton(held, window)


SPANS = "array<struct<from:int,to:int>>"


def _matches(shared, window: int):
    """Adds to (row, text, n_words, spans, items) what one block of the benchmark hits; all rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: SuffixAutomaton = shared.value  # read once a worker
        held: dict[bytes, tuple] = {}  # copies are read once
        size = 0
        for batch in batches:
            for lo, hi, w in _words(batch.column(1)):
                spans, items = {}, {}
                for d, a, b in automaton.stretches(w):
                    codes = automaton.codes(w.hash[a:b])
                    if (key := codes.tobytes()) not in held:
                        size += b - a
                        if size > MOST_READ:
                            held.clear()
                            size = b - a
                        held[key] = automaton.read(codes.tolist())
                    found, which = held[key]
                    if found:
                        start = a - int(w.first[d])
                        spans.setdefault(d, []).extend((start + x, start + y) for x, y in found)
                        items.setdefault(d, set()).update(automaton.names[k] for k in which)
                part = batch.slice(lo, hi - lo)
                merged = [part.column(3), part.column(4)]
                if spans:
                    old, names = merged[0].to_pylist(), merged[1].to_pylist()
                    for d in spans:
                        old[d] = [{"from": x, "to": y} for x, y in joined([*((s["from"], s["to"]) for s in old[d]), *spans[d]])]
                        names[d] = sorted({*names[d], *items[d]})
                    merged = [pa.array(old, merged[0].type), pa.array(names, merged[1].type)]
                columns = [part.column(0), part.column(1), pa.array(np.diff(w.first).astype(np.int64)), *merged]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_words", "spans", "items"])

    return returning_memory(run)


def joined(spans) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matched_rows(docs: DataFrame, benchmark: DataFrame, window: int = 13, most_words: int = 1_000_000, text: str = "text") -> DataFrame:
    """Each row of docs as one column `row`, with text, n_words, spans and items; no row is joined to any other.

    Words are runs of digits, letters and all characters beyond ASCII, A-Z as a-z. A window is `window` consecutive
    words of an item, or a whole shorter item. A null or empty document has no words and no spans; a null or empty
    item has no window; items with the same id count once. An automaton that executors get holds at most most_words
    words of items, about 50 bytes each; a larger benchmark is read in such blocks, one written pass each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as {SPANS})").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = rows.schema
    for k, block in enumerate(automata(benchmark, window, most_words)):
        rows = written(rows, "decontaminate") if k else rows
        rows = rows.mapInArrow(_matches(spark.sparkContext.broadcast(block), window), schema)
    return rows


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, most_words: int = 1_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (of word numbers, end exclusive), items (ids, sorted), as
    matched_rows() has them. Extra columns are ignored; an empty table gives no rows."""
    rows = matched_rows(documents_of(docs, doc_id, text), benchmark, window, most_words)
    return rows.select("row.doc_id", "n_words", "spans", "items")


def judged(matches: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit, n_items and contaminated: at least one word in share is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return matches.withColumn("n_hit", hit).select(
        "*", F.size("items").cast("long").alias("n_items"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = 13, most_words: int = 1_000_000, text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, whatever those are called.

    Each row is judged by its own text alone, so null and repeated ids and repeated rows need no care.
    """
    rows = judged(matched_rows(docs, benchmark, window, most_words, text), share)
    return rows.where(~F.col("contaminated")).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, window: int = 13, most_words: int = 1_000_000, text: str = "text") -> DataFrame:
    """docs with each hit span of at least least_words words cut out of the text; all rows and other columns stay.

    A cut takes the span's characters from its first to its last word.
    """
    rows = matched_rows(docs, benchmark, window, most_words, text)
    spans = F.filter("spans", lambda s: s["to"] - s["from"] >= least_words)
    word = r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"
    # pieces[i] parts word i-1 from word i; a word stays unless a span holds its number
    pieces, words = F.split("text", word, -1), F.regexp_extract_all("text", F.lit(word), 1)
    kept = F.transform(words, lambda w, i: F.when(F.exists("cuts", lambda s: (i >= s["from"]) & (i < s["to"])), "").otherwise(w))
    gaps = F.transform(pieces, lambda p, i: F.when(F.exists("cuts", lambda s: (i > s["from"]) & (i < s["to"])), "").otherwise(p))
    cut = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), kept.alias("w")), lambda x: F.concat(x["g"], F.coalesce(x["w"], F.lit("")))), "")
    new = F.when(F.size("cuts") > 0, cut).otherwise(F.col("text"))
    return rows.withColumn("cuts", spans).select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def contract_columns(matches: DataFrame) -> DataFrame:
    return judged(matches).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def digest_of(items: list[str]) -> str:
    """What items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
