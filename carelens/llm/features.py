"""Text statistics per document, as a dense float matrix (bounded width)."""

from __future__ import annotations

import numpy as np

from . import text as T

# byte classes: each byte has one
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\v\f", ".,;:", "?",
           "!", "'\"()-", "#", "*", "$", "%", "&", "|", "<>", "@", "/\\", "=+^~", "_[]{}`"]
CLASSES = len(_GROUPS) + 2  # and other ASCII, and bytes beyond ASCII
_CLASS = np.full(256, len(_GROUPS), dtype=np.int64)
_CLASS[128:] = len(_GROUPS) + 1
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i
EXTRA = ["log_words", "mean_word", "distinct_words", "repeats_previous", "capital_words", "marked_words",
         "lines_per_word", "top_word"]
WIDTH = CLASSES + len(EXTRA)
_LETTER = (_CLASS == 0) | (_CLASS == 1) | (_CLASS == len(_GROUPS) + 1)


def _per_row(row: np.ndarray, weight, n: int) -> np.ndarray:
    return np.bincount(row, weights=weight, minlength=n)


def document_stats(off: np.ndarray, raw: np.ndarray, spans=None) -> np.ndarray:
    """(rows, WIDTH): shares of byte classes, then the EXTRA word statistics.
    An empty text is all zeros. ``spans``: words and their hashes, if known."""
    n = len(off) - 1
    size = np.maximum(1, np.diff(off))
    where = np.repeat(np.arange(n), np.diff(off))
    share = np.bincount(where * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]
    if spans is None:
        start, end, row = T.words(off, raw)
        h = T.span_hashes(raw, start, end)
    else:
        start, end, row, h = spans
    words = np.bincount(row, minlength=n)
    per = np.maximum(1, words)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    first = np.concatenate(([True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1]))) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    runs = np.diff(np.append(at, len(hs)))
    top = np.zeros(n)
    np.maximum.at(top, rs[at], runs)
    same = np.zeros(len(h), dtype=bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    upper = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_CLASS[raw] == 1, out=upper[1:])
    capital = (upper[end] - upper[start] >= 2) & (2 * (upper[end] - upper[start]) >= end - start)
    marked = ~_LETTER[raw[end - 1]] if len(end) else np.zeros(0, bool)
    marked &= (_CLASS[raw[end - 1]] != 6) if len(end) else marked
    extra = np.stack([
        np.log1p(words), _per_row(row, end - start, n) / per, _per_row(rs[at], None, n) / per,
        _per_row(row, same, n) / per, _per_row(row, capital, n) / per, _per_row(row, marked, n) / per,
        share[:, 4] * size / per, top / per], axis=1)
    return np.concatenate([share, extra], axis=1).astype(np.float32)
