"""Vectorised text primitives over Arrow buffers (numpy, no Python loop per word).

Texts are read as UTF-8 bytes straight from the Arrow string buffer. A word is
a maximal run of bytes that are none of ``\\t \\n \\v \\f \\r`` and space; null
texts count as empty. Word and shingle hashes are 64-bit: a polynomial over
random per-byte values, mixed; equal words hash equal in every task.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def random_u64(name: str, n: int) -> np.ndarray:
    """``n`` fixed 64-bit values derived from ``name``: the same in every process."""
    return np.frombuffer(hashlib.shake_256(name.encode()).digest(8 * n), dtype="<u8").copy()


BYTE_VALUES = [random_u64(f"bytes {i}", 256) | U64(1) for i in range(2)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(random_u64("base", 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


_held: dict[str, dict] = {}


def held_by(operator: str) -> dict:
    """What a Python worker keeps between the tasks of one operator. Workers are
    used again by later stages: what another operator kept is dropped here."""
    if operator not in _held:
        _held.clear()
        _held[operator] = {}
    return _held[operator]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    k = 1
    while k < n:  # doubling: p[k + i] = p[i] * base^k
        m = min(k, n - k)
        out[k:k + m] = out[:m] * U64(pow(base, k, 1 << 64))
        k *= 2
    return out


_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse. One pair of tables is kept, about as long as the longest chunk so far."""
    if not _tables or len(_tables[0]) < n:
        drop_powers()
        size = 1 << max(18, int(n - 1).bit_length())
        _tables[:] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables[0], _tables[1]


def drop_powers() -> None:
    """Give back the tables of ``powers``; they are made again when needed."""
    _tables.clear()


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Hand what Arrow's and C's allocators hold without use, and the tables of ``powers``, back to the system."""
    drop_powers()
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that ends with ``give_back``. An executor keeps the workers of
    finished tasks for later ones, often more of them than it has cores, each with its unused memory."""
    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, dtype=np.int64 if large else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return off - off[0], raw[off[0]:off[-1]]


def chunks(off: np.ndarray, raw: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b) with their own offsets and bytes: about ``size`` bytes each, at least one row."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        b = min(b, n, a + 4096)
        yield a, b, off[a:b + 1] - off[a], raw[off[a]:off[b]]
        a = b


def words(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every word."""
    if not len(raw):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = ~SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True  # a row's edge separates words
    prev = np.concatenate(([False], word[:-1]))
    start = np.flatnonzero(word & (~prev | cut[:-1]))
    nxt = np.concatenate((word[1:], [False]))
    end = np.flatnonzero(word & (~nxt | cut[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; ``which`` (0 or 1) gives a second, independent one."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    up, down = powers(len(raw) + 1)
    c = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(BYTE_VALUES[which][LOWER[raw] if lower else raw] * up[:len(raw)], out=c[1:])
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(U64))


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of a row and their rows, in row order.
    A row with 1 to k - 1 words has one shingle, of all its words."""
    if len(h) >= k:
        g = np.zeros(len(h) - k + 1, dtype=U64)
        for j, odd in enumerate(random_u64("shingle", k) | U64(1)):
            g += mix(h[j:len(h) - k + 1 + j] ^ odd) * odd
        ok = row[:len(h) - k + 1] == row[k - 1:]
        g, r = mix(g[ok]), row[:len(h) - k + 1][ok]
    else:
        g, r = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    n = np.bincount(row, minlength=n_rows)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(row, short)
        s = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            has = n[short] > j
            s[has] = mix(s[has] + h[first[has] + j] + U64(j + 1))
        g, r = np.concatenate((g, s)), np.concatenate((r, short))
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    return g, r
