"""Vector kernels over the UTF-8 buffers of Arrow string columns.

Everything works on whole texts in chunks of whole documents: a chunk ends after the document that passes CHUNK bytes.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = -(-n // (1 << 17)) << 17
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            run = np.full(size, x, dtype=U)
            run[0] = 1
            both.append(np.cumprod(run, dtype=U))
        have = _powers[base] = (both[0], both[1])
    return have


BASE_BYTES, BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span, by prefix sums of a polynomial."""
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, dtype=U)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def windows_hash(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all runs of n values."""
    if len(values) < n:
        return np.zeros(0, dtype=U)
    s = np.arange(len(values) - n + 1)
    return spans_hash(values, s, s + n, base)


@dataclass
class Chunk:
    """Whole documents lo..hi of a batch: their bytes, and offsets of documents in them."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offs = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="left")))
        hi = min(hi, len(column))
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def words(c: Chunk, spaces: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunk's words, and for each document (and the end) the number of its first word. spaces: for
    each byte, whether it stands between words."""
    space = spaces[c.data]
    start, end = ~space, ~space
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    full = c.offs[1:] > c.offs[:-1]
    first, last = c.offs[:-1][full], c.offs[1:][full] - 1
    start[first], end[last] = ~space[first], ~space[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, c.offs)


def word_hashes(c: Chunk, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    t = _bytes_table(1)
    return spans_hash((t[LOWER] if lower else t)[c.data], starts, ends, BASE_BYTES)


def inside(n: int, firsts: np.ndarray, total: int) -> np.ndarray:
    """For each start of a run of n units, whether the run lies in one document. firsts: as from words()."""
    runs = max(0, total - n + 1)
    ok = np.zeros(total + 1, dtype=np.int32)
    ends = firsts[1:] - n + 1
    good = ends > firsts[:-1]
    np.add.at(ok, firsts[:-1][good], 1)
    np.add.at(ok, ends[good], -1)
    return np.cumsum(ok)[:runs].astype(bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, n = x, 1
    while 2 * n <= w:
        have = np.minimum(have[: len(have) - n], have[n:])
        n *= 2
    if n < w:
        have = np.minimum(have[: len(have) - (w - n)], have[w - n :])
    return have


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
