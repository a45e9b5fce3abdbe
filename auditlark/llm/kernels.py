"""Vectorised kernels over Arrow string buffers: word bounds, word hashes and shingle sets by numpy alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
ODD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_table() -> np.ndarray:
    """A random 64-bit value for each byte, equal for A-Z and a-z."""
    table = mixed(np.arange(1, 257, dtype=U) * U(ODD))
    table[65:91] = table[97:123]
    return table


def blank_bytes() -> np.ndarray:
    """Bytes that part words in documents."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def non_alphanumeric_bytes() -> np.ndarray:
    """Bytes that part words for benchmark comparison: all ASCII but digits and letters."""
    out = np.zeros(256, bool)
    out[:128] = True
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        out[lo:hi] = False
    return out


@dataclass
class Words:
    """Words of a run of documents: first[i]:first[i+1] are those of document i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 20, most_rows: int = 30_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about most_bytes: (row from, row to, bytes, offsets). Null is empty.

    The kernels below need about 60 bytes for each byte of a run, so a run is small, but for a longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends, lo, n = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64), 0, len(column)
    while lo < n:
        before = int(ends[lo - 1]) if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))), lo + most_rows, n)
        # only the run's rows are copied where nulls are filled
        part = pc.fill_null(column.slice(lo, hi - lo).cast(pa.large_string()), "")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + hi - lo + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        yield lo, hi, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> Words:
    """Bounds and 64-bit hashes (A-Z as a-z) of the words between parting bytes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(len(offsets), np.int64))
    inside = ~parting[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][(offsets[1:] > 0)] - 1
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers = np.full(n + 1, U(BASE))
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, U)
    np.cumsum(byte_table()[data] * powers[:n], out=sums[1:])
    inverse = np.full(n + 1, U(BASE_INVERSE))
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    return Words(start, end, mixed((sums[end] - sums[start]) * inverse[start]), np.searchsorted(start, offsets))


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin.

    A document of fewer words than size has its whole sequence as its one shingle; one without words has none.
    """
    factors = mixed(np.arange(1, size + 1, dtype=U) * U(BASE)) | U(1)
    counts = np.diff(words.first)
    n = len(words.hash)
    if n >= size:
        value = words.hash[: n - size + 1] * factors[0]
        for k in range(1, size):
            value += words.hash[k : n - size + 1 + k] * factors[k]
        value = mixed(value)
    else:
        value = np.zeros(0, U)
    out, lengths = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        lo, c = words.first[i], counts[i]
        if c >= size:
            own = np.sort(value[lo : lo + c - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            with np.errstate(over="ignore"):
                own = mixed(np.array([(words.hash[lo : lo + c] * factors[:c]).sum(dtype=U) + U(c)], U))
        lengths[i] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate(([0], np.cumsum(lengths)))


def set_digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit digests (n x 2) of sets of hashes; the empty set has zeros."""
    out = np.zeros((len(bounds) - 1, 2), U)
    for k, salt in enumerate((ODD, BASE)):
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mixed(values ^ U(salt)), dtype=U)))
        out[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out
