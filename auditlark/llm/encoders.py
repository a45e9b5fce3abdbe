"""Exact tokenizer encodings of whole texts, with the work shared between equal units.

A tokenizers file is run by the tokenizers library. Both supported files cut a text into units before any merge, so
that a text's ids are those of its units in turn. numpy finds the units of many texts at a time, Arrow the distinct
ones; units repeat far more often than texts, and a worker keeps the ids of those it has met. The class of a character
beyond Latin-1 is asked of the library once a worker, and texts with such characters are normalised by the library
where a file says so. A text that may hold a special token's string is encoded whole by the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from auditlark.llm.common import worker_state

#: Units that a worker remembers at most; beyond it the memory starts anew.
MOST_UNITS = 250_000
#: Bytes of texts that are cut at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
BLANK, APOSTROPHE = 32, 39
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)

# Byte-level files write printable bytes as themselves and the others, in order, from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CODES = np.arange(256, dtype="<u4")
BYTE_CODES[[b for b in range(256) if b not in PRINTABLE]] = np.arange(256, 512 - len(PRINTABLE))


class Units(dict):
    """unit (bytes) -> number; ids of unit k are flat[starts[k]:starts[k] + sizes[k]]. Number 0 has no ids."""

    def __init__(self, tokenizer: Tokenizer, dropped: frozenset[bytes]):
        super().__init__()
        self.merge, self.dropped = tokenizer.model.tokenize, dropped
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used, self.count = np.zeros(8192, np.uint32), 0, 1

    def _ids(self, units: list[bytes]) -> Iterator[list[int]]:
        """The library's merges take a unit directly, as byte characters."""
        text = BYTE_CODES[np.frombuffer(b"".join(units), np.uint8)].tobytes().decode("utf-32-le")
        at = 0
        for unit in units:
            yield [t.id for t in self.merge(text[at : at + len(unit)])]
            at += len(unit)

    def learn(self, units: list[bytes]) -> None:
        good = [u for u in units if u[:1] not in self.dropped and u[:2] not in self.dropped]
        if len(good) < len(units):
            self.update(zip(units, repeat(0)))
        ids = list(self._ids(good))
        first, n = self.count, len(ids)
        sizes = np.fromiter(map(len, ids), np.int64, n)
        total = int(sizes.sum())
        while first + n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.sizes[first : first + n] = sizes
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.update(zip(good, range(first, first + n), strict=True))
        self.used, self.count = self.used + total, first + n

    def numbers(self, units: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            self.learn(new)
            found[missing] = [self[u] for u in new]
        return found


class Encoder:
    """Encodes many texts at a time as the tokenizers library does for one whole text, without added special tokens.

    A unit is a run of letters, a run of numbers, a run of other signs (each with the blank before it), white space,
    or an apostrophe with s, t, re, ve, m, ll or d where no blank and no other sign is before it. Files that drop white
    space count letters without case, take numbers one by one, and know no blank before a unit.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        # a byte-level file keeps the blank before a word with the word; the other drops all blanks
        alone = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a b", "a", " b", "b")]
        self.leading = len(alone[0]) == len(alone[1]) + len(alone[2]) and alone[2] != alone[3]
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)  # by code point
        self._kinds_of(np.concatenate((np.arange(256), np.arange(0x2000, 0x2070), [0x1680, 0x180E, 0x3000, 0xFEFF])))
        spaces = [chr(c).encode() for c in np.flatnonzero(self.kinds == SPACE).tolist()]
        self.units = Units(self.tokenizer, frozenset(() if self.leading else spaces))

    def _kind(self, char: str) -> int:
        """What the library's own cutting takes a character for."""
        pieces = lambda c: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(c + char + c))
        if pieces("a") == 1:
            return LETTER
        if pieces("!") == 1:
            return OTHER
        return NUMBER if pieces("1") == (1 if self.leading else 3) else SPACE

    def _kinds_of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            for c in np.unique(points[kinds == UNKNOWN]).tolist():
                self.kinds[c] = self._kind(chr(c))
            kinds = self.kinds[points]
        return kinds

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes where units begin."""
        kind = self.kinds[data]
        lead = np.flatnonzero(data >= 0xC2)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            points = first & (0x7F >> size)
            for k in (1, 2, 3):
                more = size > k
                points[more] = points[more] << 6 | data[lead[more] + k] & 63
            kind[lead] = kinds = self._kinds_of(points)
            for k in (1, 2, 3):
                kind[lead[size > k] + k] = kinds[size > k]
        head = np.zeros(len(data), bool)
        head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = head.copy()
        start[1:] |= kind[1:] != kind[:-1]
        within = (data & 0xC0) == 0x80
        if self.leading:
            # white space leaves its last character to what follows; a blank joins it, any other stands by itself
            after = np.flatnonzero(start & ~head & (kind != SPACE))
            after = after[kind[after - 1] == SPACE]
            last = after - 1
            for _ in range(3):  # to the character's first byte
                last = last - within[last]
            start[last] = True
            start[after[data[after - 1] == BLANK]] = False
        else:
            start |= (kind == NUMBER) & ~within
        mark = np.flatnonzero((data == APOSTROPHE) & start)
        mark = mark[mark + 1 < len(data)]
        mark = mark[(kind[mark + 1] == LETTER) & ~head[mark + 1]]
        if len(mark):
            padded = np.concatenate((data, np.zeros(2, np.uint8)))
            one, two = padded[mark + 1], np.where(np.concatenate((head, [True, True]))[mark + 2], 0, padded[mark + 2])
            size = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
            size[np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
            mark, size = mark[size > 0], size[size > 0]
            start[mark + 1] = False
            start[(mark + 1 + size)[mark + 1 + size < len(data)]] = True
        return np.flatnonzero(start)

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts, and where each text's begin."""
        offsets, data = _buffers(texts)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        if not self.leading:
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
            wide = np.flatnonzero(data[:-1] == 0xC3) + 1
            wide = wide[(data[wide] <= 0x9E) & (data[wide] != 0x97)]
            data[wide] += 32
        if len(self.units) > MOST_UNITS:
            self.units.clear()
        starts = self._starts(data, offsets)
        places = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, places, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        return self.units.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()], np.searchsorted(starts, offsets)

    def _normalised(self, texts: pa.Array) -> pa.Array:
        """texts, those with characters beyond Latin-1 as the library normalises them; blanks and case of others are
        seen to in numbers. Nothing is composed across a blank, so that equal words are normalised once."""
        offsets, data = _buffers(texts)
        seen = np.concatenate(([0], np.cumsum(data >= 0xC4)))
        odd = seen[offsets[1:]] > seen[offsets[:-1]]
        if not odd.any():
            return texts
        words = pc.split_pattern(texts.filter(pa.array(odd)).cast(pa.string()), " ")
        coded = words.flatten().dictionary_encode()
        normal = pa.array([w if w.isascii() else self.tokenizer.normalizer.normalize_str(w) for w in coded.dictionary.to_pylist()], pa.string())
        again = pa.ListArray.from_arrays(pc.subtract(words.offsets, words.offsets[0]), normal.take(coded.indices))
        return pc.replace_with_mask(texts, pa.array(odd), pc.binary_join(again, " ").cast(texts.type))

    def _slices(self, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, list[list[int]]]]:
        """Slices of texts: those to cut, which of all they are, and the ids of the others, which the library encodes."""
        ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
        while lo < len(texts):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            part = pc.fill_null(texts.slice(lo, hi - lo), "")
            offsets, data = _buffers(part)
            odd = np.zeros(len(data), bool)
            odd[:-1] = (data[:-1] == ord("<")) & (data[1:] == ord("|"))
            seen = np.concatenate(([0], np.cumsum(odd)))
            plain = seen[offsets[1:]] == seen[offsets[:-1]]
            others = [] if plain.all() else part.filter(pa.array(~plain)).to_pylist()
            kept = part.filter(pa.array(plain)) if others else part
            yield kept if self.leading else self._normalised(kept), plain, [self.tokenizer.encode(t, add_special_tokens=False).ids for t in others]
            lo = hi

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; null counts as empty."""
        out = [np.zeros(0, np.int64)]
        for part, plain, others in self._slices(texts):
            numbers, bounds = self._numbered(part)
            ends = np.concatenate(([0], np.cumsum(self.units.sizes[numbers], dtype=np.int64)))
            sizes = np.zeros(len(plain), np.int64)
            sizes[plain], sizes[~plain] = np.diff(ends[bounds]), [len(x) for x in others]
            out.append(sizes)
        return np.concatenate(out)

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of texts in turn: the ids of its texts, one behind the other, and how many each has."""
        for part, plain, others in self._slices(texts):
            numbers, bounds = self._numbered(part)
            each = self.units.sizes[numbers].astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(each)))
            ids = self.units.flat[np.arange(ends[-1]) + np.repeat(self.units.starts[numbers] - ends[:-1], each)]
            sizes = np.zeros(len(plain), np.int64)
            sizes[plain], sizes[~plain] = np.diff(ends[bounds]), [len(x) for x in others]
            if others:
                cuts = np.cumsum(np.where(plain, sizes, 0))[~plain]
                runs = zip(np.split(ids, cuts), [*(np.array(x, np.uint32) for x in others), np.zeros(0, np.uint32)], strict=True)
                ids = np.concatenate([x for pair in runs for x in pair])
            yield ids, sizes


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array of strings without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def encoder(file: str) -> Encoder:
    """The worker's encoder for a file, loaded once."""
    held = worker_state().setdefault("encoders", {})
    if file not in held:
        held[file] = Encoder(file)
    return held[file]
