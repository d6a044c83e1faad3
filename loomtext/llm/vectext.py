"""Vectorised work on the UTF-8 bytes of an Arrow string column.

A *slice* is a run of rows of one batch whose texts have at most about ``max_bytes`` bytes
together (one longer text is a slice of its own), so temporary arrays stay small. Null texts
count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the word rule: blank, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of every slice."""
    data, offs = buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes that are not separators; runs end with their row."""
    inside = ~separator[data]
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span, by prefix sums of a polynomial."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] ^ ((e - s).astype(U) << U(56)))


def lowered(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """A-Z in lower case; with latin, the two-byte capitals U+00C0 to U+00DE as well."""
    out = LOWER[data]
    if latin and len(out) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
        out[at] += 32
    return out


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row) of all n-word shingles in order; a row with fewer words has one, of all of them."""
    counts = np.bincount(row, minlength=n_rows)
    starts = np.concatenate(([0], np.cumsum(counts)))
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    offs = np.concatenate(([0], np.cumsum(made)))
    if not len(words):
        return np.zeros(0, U), offs
    total = len(words)
    acc = np.zeros(total, U)
    for k in range(min(n, total)):
        acc[: total - k] += mix(words[k:] + U(k + 1)) * U(2 * k + 3)
    acc = mix(acc + U(n))
    keep = np.zeros(total, bool)
    ends = np.repeat(starts[1:], counts)
    keep[np.arange(total) + n <= ends] = True
    out = np.zeros(offs[-1], U)
    long = counts >= n
    target = np.repeat(long, made)
    out[target] = acc[keep]
    for r in np.flatnonzero((counts > 0) & ~long):
        w = words[starts[r] : starts[r + 1]]
        k = np.arange(len(w), dtype=U)
        out[offs[r]] = mix(np.add.reduce(mix(w + k + U(1)) * (U(2) * k + U(3)), keepdims=True) + U(len(w)) + U(1 << 40))[0]
    return out, offs


def row_sums(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of the values of each row, as double."""
    return np.bincount(row, weights=values, minlength=n_rows)
