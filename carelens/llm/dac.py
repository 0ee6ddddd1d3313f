"""Directly addressable codes for one segment of token ids.

An id is cut into chunks of given widths, low bits first. Level l holds the
chunk of every id that reaches it, plus one continuation bit each; the rank of
a set bit is the id's position on the next level. A rank directory (set bits
before every 512-bit block) makes each rank a lookup and a partial popcount,
so any id is read without decoding its neighbours.

Bytes, little endian::

    "DAC1" | uint32 levels | uint64 ids | per level:
    uint32 width | uint64 entries | chunk bits (MSB first, padded to bytes) |
    continuation bits (padded to bytes) | rank directory (uint32 per 512 bits)
    -- the last level has no continuation bits and no directory
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512


def choose_widths(ids: np.ndarray, max_levels: int = 4) -> tuple[int, ...]:
    """Widths of least total size: dynamic programme over the ids' bit lengths."""
    if not len(ids):
        return (1,)
    ids = ids.astype(np.int64)
    bits = np.maximum(1, np.ceil(np.log2(ids + 1)).astype(np.int64))
    top = int(bits.max())
    over = np.array([(bits > b).sum() for b in range(top + 1)])  # ids with bits at b and above
    over[0] = len(ids)
    best = {(top, n): (0, ()) for n in range(max_levels + 1)}
    for n in range(1, max_levels + 1):
        for at in range(top - 1, -1, -1):
            options = []
            for w in range(1, top - at + 1):
                rest = best.get((at + w, n - 1))
                if rest is not None:
                    last = at + w == top
                    options.append((int(over[at]) * (w + (0 if last else 1)) + rest[0], (w, *rest[1])))
            if options:
                best[(at, n)] = min(options)
    return min(best[(0, n)] for n in range(1, max_levels + 1) if (0, n) in best)[1]


def _pack(values: np.ndarray, width: int) -> bytes:
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8)).tobytes()


def _unpack(buf: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(buf, count=n * width).reshape(n, width)
    out = np.zeros(n, dtype=np.uint32)
    for j in range(width):
        out = (out << np.uint32(1)) | bits[:, j]
    return out


def encode(ids: np.ndarray, widths: tuple[int, ...] | None = None) -> bytes:
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    widths = widths or choose_widths(ids)
    out = [MAGIC, struct.pack("<IQ", len(widths), len(ids))]
    rest = ids
    for level, w in enumerate(widths):
        out.append(struct.pack("<IQ", w, len(rest)))
        out.append(_pack(rest & np.uint32((1 << w) - 1), w))
        high = (rest >> np.uint32(w)) if w < 32 else np.zeros_like(rest)
        if level + 1 < len(widths):
            more = high > 0
            out.append(np.packbits(more).tobytes())
            sums = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0)
            out.append(np.concatenate(([0], np.cumsum(sums)))[:-1].astype("<u4").tobytes() if len(more) else b"")
            rest = high[more]
        elif high.any():
            raise ValueError("ids need more bits than the widths hold")
    return b"".join(out)


class Reader:
    """Random access into one encoded segment."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        levels, self.n = struct.unpack_from("<IQ", body, 4)
        raw, at = np.frombuffer(body, dtype=np.uint8), 16
        self.levels = []
        for level in range(levels):
            w, n = struct.unpack_from("<IQ", body, at)
            at += 12
            size = (n * w + 7) // 8
            chunk, at = raw[at:at + size], at + size
            more = ranks = None
            if level + 1 < levels:
                size = (n + 7) // 8
                more, at = raw[at:at + size], at + size
                size = 4 * ((n + BLOCK - 1) // BLOCK)
                ranks, at = np.frombuffer(body, dtype="<u4", count=size // 4, offset=at), at + size
            self.levels.append((w, n, chunk, more, ranks))

    def __len__(self) -> int:
        return self.n

    def get(self, i: int) -> int:
        """Id number ``i``: one chunk and one rank per level, nothing else is decoded."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for w, _, chunk, more, ranks in self.levels:
            a, b = i * w, (i + 1) * w
            bits = int.from_bytes(chunk[a // 8:(b + 7) // 8].tobytes(), "big")
            out |= ((bits >> (-b % 8)) & ((1 << w) - 1)) << shift
            if more is None or not (int(more[i // 8]) >> (7 - i % 8)) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(more[block * BLOCK // 8:i // 8 + 1], count=i - block * BLOCK)
            i = int(ranks[block]) + int(before.sum())
            shift += w
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n, dtype=np.uint32)
        at, shift = np.arange(self.n), 0
        for w, n, chunk, more, _ in self.levels:
            out[at] |= _unpack(chunk, n, w) << np.uint32(shift)
            if more is None:
                break
            at = at[np.unpackbits(more, count=n).view(bool)]
            shift += w
        return out
