"""Benchmark decontamination by edit distance (operator 2).

Texts and items are compared without white space and with A-Z lower-cased, as
bytes. An item occurs in a document if some stretch of it, starting at a word or
inside a long one, has an edit distance of at most ``max_edit`` times the item's length.

Search, in one map over the documents per block of items, without a shuffle:

1. Windows. An item is searched by windows of its own that start at words, half
   a window apart and at its end, each of the largest size class (lengths
   growing by ``CLASS_GROWTH``, at most ``WINDOW``) it is long enough for. Any
   of them finds it, so a long item is found rather better than a short one. In
   a document a window of each class may start at every word; it is kept if it
   holds at least two *seeds*, the ``SEED`` bytes from a word's start that are
   also found in some item.
   Where white space gives no starts - in words longer than ``LONG`` bytes, as in
   Chinese, Thai, URLs or code - windows start at places chosen by content
   (minimizers of ``GRAM`` bytes), in items and documents alike. Items under
   ``MIN_ITEM`` bytes are looked up by the hash of their whole length, at every
   word and at every byte of a long word.
2. CGK embedding. A random walk reads a window's bytes, at each step staying or
   going on by a random bit of (step, byte): edit distance becomes Hamming
   distance between the symbols read. Items are embedded alike.
3. Bit-sampling LSH. ``walks`` embeddings times ``bands`` samples of ``bits``
   positions each; equal samples make a candidate. A stretch at the largest
   distance allowed is found with a probability measured in the tests.
4. Exact edit distance (banded, free start and end) decides, once for the
   candidates that put the item at about the same place. Before it, places that
   hold too few of the item's ``COMMON`` byte grams for any stretch within the
   distance are dropped: an edit spoils at most ``COMMON`` grams, so none is lost.

Items are taken in blocks of at most ``BLOCK_BYTES``, which bounds what is
broadcast however large the benchmark is.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

SEED = 12
MIN_ITEM = 32
CLASS_GROWTH = 1.4
WINDOW = 96
GRAM = 8
COMMON = 5
LONG = 16
BLOCK_BYTES = 32 << 20
FILTER_BITS = 1 << 22


def compact(off: np.ndarray, raw: np.ndarray):
    """Offsets and bytes without white space, word starts and rows, and each byte's place in ``raw``."""
    keep = ~T.SPACE[raw]
    upto = np.concatenate(([0], np.cumsum(keep)))
    start, _, row = T.words(off, raw)
    return upto[off], T.LOWER[raw[keep]], upto[start], row, np.flatnonzero(keep)


def _long_words(off, raw, start, row) -> np.ndarray:
    """The bytes of words longer than LONG."""
    end = np.minimum(np.append(start[1:], len(raw)), off[row + 1])
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    long = end - start > LONG
    np.add.at(edge, start[long], 1)
    np.add.at(edge, end[long], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def minimizers(off, raw, at):
    """Places chosen by content, and their rows: of each GRAM neighbouring places
    from one of ``at`` on, the one whose GRAM bytes have the least hash."""
    row = np.searchsorted(off, at, side="right") - 1
    ok = at + 2 * GRAM - 1 <= off[row + 1]
    at = at[ok]
    if not len(at):
        return at, row[ok]
    places = np.flatnonzero(np.arange(len(raw)) + GRAM <= len(raw))
    h = T.span_hashes(raw, places, places + GRAM, lower=False)
    got = np.unique(at + h[at[:, None] + np.arange(GRAM)].argmin(axis=1))
    return got, np.searchsorted(off, got, side="right") - 1


def _seeds(off, raw, start, row):
    ok = np.flatnonzero(start + SEED <= off[row + 1])
    return T.span_hashes(raw, start[ok], start[ok] + SEED, lower=False), ok


def _walk_bits(walk: int, steps: int) -> np.ndarray:
    body = hashlib.shake_256(f"cgk {walk}".encode()).digest(steps * 32)
    return np.unpackbits(np.frombuffer(body, np.uint8)).reshape(steps, 256)


def cgk(strings: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """Symbols read by the random walk: (n, steps) from (n, size) bytes; 0 beyond the end."""
    n, size = strings.shape
    flat = np.concatenate([strings, np.zeros((n, steps - size if steps > size else 1), np.uint8)], axis=1)
    width = flat.shape[1]
    flat, at = flat.ravel(), np.arange(n, dtype=np.int64) * width
    out, bits = np.empty((steps, n), dtype=np.uint8), _walk_bits(walk, steps)
    for j in range(steps):
        symbol = flat[at]
        out[j] = symbol
        at += bits[j][symbol]
    return out


class Embedder:
    """Band keys of strings of one size class."""

    def __init__(self, size: int, walks: int, bands: int, bits: int):
        self.size, self.walks, self.bands, self.bits = size, walks, bands, bits
        self.steps = 2 * size  # the walk goes on every other step: about the whole string
        draw = T.random_u64(f"bands {size}", walks * bands * bits) % T.U64(self.steps)
        self.at = draw.astype(np.int64).reshape(walks, bands, bits)
        self.odd = T.random_u64("band symbols", bits) | T.U64(1)

    def keys(self, strings: np.ndarray) -> np.ndarray:
        """(n, walks * bands) 64-bit keys."""
        out = np.empty((self.walks * self.bands, len(strings)), dtype=T.U64)
        for w in range(self.walks):
            symbols = cgk(strings, w, self.steps)
            for b in range(self.bands):
                k = np.full(len(strings), (self.size << 16) + w * self.bands + b, dtype=T.U64)
                for at, odd in zip(self.at[w, b], self.odd):
                    k += symbols[at] * odd
                out[w * self.bands + b] = T.mix(k)
        return out.T


def edit_distances(items: np.ndarray, m: np.ndarray, texts: np.ndarray, size: np.ndarray,
                   limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the distance of the item (``m`` bytes) to the best beginning of the
    text (``size`` bytes), and that beginning's length; limit + 1 if above ``limit``.
    All rows at once, in a band as wide as the largest limit needs."""
    n, top = len(m), int(limit.max(initial=0))
    shift = np.arange(2 * top + 1, dtype=np.int32)           # cell: text position i + shift - top after i item bytes
    far = np.int32(1 << 20)
    row = np.where(shift >= top, shift - top, far)[None, :].repeat(n, 0).astype(np.int32)
    row[shift[None, :] - top > size[:, None]] = far
    longest = int(m.max(initial=0))
    padded = np.full((n, longest + 2 * top + 2), 256, dtype=np.int16)
    width = min(texts.shape[1], longest + top + 1)
    padded[:, top + 1:top + 1 + width] = texts[:, :width]
    d, used = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(longest + 1):
        if i:
            at = i + shift - top                             # text bytes used
            gone = row + (padded[:, i:i + len(shift)] != items[:, i - 1:i])
            gone[:, :-1] = np.minimum(gone[:, :-1], row[:, 1:] + 1)
            out = (at < 0) | (at > size[:, None])
            gone[out] = far
            row = np.minimum.accumulate(gone - shift, axis=1) + shift  # text bytes left over
            row[out] = far
        done = m == i
        if done.any():
            d[done] = row[done].min(axis=1)
            used[done] = i + row[done].argmin(axis=1) - top
    return np.where(d <= limit, d, limit + 1), used


def stretch_ends(items: np.ndarray, m: np.ndarray, texts: np.ndarray, first: np.ndarray, size: np.ndarray,
                 width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the distance of the item (``m`` bytes) to the best stretch of the text's
    bytes ``first`` to ``size``, and that stretch's end. After i item bytes, i to i + ``width`` - 1
    text bytes lie before the path: a stretch starts within the first ``width`` bytes."""
    n, longest = len(m), int(m.max(initial=0))
    shift = np.arange(width, dtype=np.int32)
    far = np.int32(1 << 20)
    padded = np.full((n, longest + width), 256, dtype=np.int16)
    padded[:, :min(texts.shape[1], longest + width)] = texts[:, :longest + width]
    d, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    row = np.zeros((n, width), dtype=np.int32)
    for i in range(longest + 1):
        out = (i + shift < first[:, None]) | (i + shift > size[:, None])
        if i:
            gone = row + (padded[:, i - 1:i - 1 + width] != items[:, i - 1:i])
            gone[:, :-1] = np.minimum(gone[:, :-1], row[:, 1:] + 1)
            gone[out] = far
            row = np.minimum.accumulate(gone - shift, axis=1) + shift
        row[out] = far
        done = m == i
        if done.any():
            d[done] = row[done].min(axis=1)
            end[done] = i + row[done].argmin(axis=1)
    return d, end


def may_be_near(items: np.ndarray, m: np.ndarray, texts: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the text of each row holds as many of the item's grams as any text with a
    stretch at a distance of ``limit`` or less does; never False for one that has it."""
    slots = 1 << max(12, int(16 * texts.shape[1]).bit_length())  # of each row; two grams in one slot only let more rows through
    row = np.arange(len(m), dtype=np.int64)[:, None] * slots

    def grams(body):
        n = max(0, body.shape[1] - COMMON + 1)
        key = np.zeros((len(body), n), dtype=T.U64)
        for k in range(COMMON):
            key = (key << T.U64(8)) | body[:, k:k + n].astype(T.U64)
        return ((key * T.U64(0x9E3779B97F4A7C15)) >> T.U64(65 - slots.bit_length())).view(np.int64) + row
    there = np.zeros(len(m) * slots, dtype=bool)
    there[grams(texts).ravel()] = True
    found = there[grams(items)]
    found &= np.arange(found.shape[1]) < (m - COMMON + 1)[:, None]
    return found.sum(axis=1) >= m - COMMON + 1 - COMMON * limit


def _window_starts(start: np.ndarray, m: int, size: int) -> list[int]:
    """Of an item's starts those of its windows: half a window apart, and the last that fits."""
    fits = start[start + size <= m]
    got: list[int] = []
    for x in fits.tolist():
        if not got or x >= got[-1] + size // 2:
            got.append(x)
    return sorted({*got, *fits[-1:].tolist()})


class ItemBlock:
    """The items of one block, ready for search."""

    def __init__(self, ids: list, texts: list, max_edit: float, walks: int, bands: int, bits: int):
        off, raw, start, row, _ = compact(*T.buffers(pa.array(texts, pa.large_string())))
        size = np.diff(off)
        self.max_edit = max_edit
        use = np.flatnonzero(size >= MIN_ITEM)
        small = np.flatnonzero((size > 0) & (size < MIN_ITEM))
        self.ids = [ids[i] for i in [*use, *small]]
        self.items = [raw[off[i]:off[i + 1]] for i in [*use, *small]]
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # length -> hash -> items
        for k, (i, h) in enumerate(zip(small, T.span_hashes(raw, off[small], off[small + 1], lower=False).tolist())):
            self.short[int(size[i])][h].append(len(use) + k)
        chosen, chosen_row = minimizers(off, raw, np.arange(len(raw)))
        word_seeds, ok = _seeds(off, raw, start, row)
        has_seed = start[ok]
        seeds = np.concatenate((word_seeds, _seeds(off, raw, chosen, chosen_row)[0]))
        self.seed_bits = np.zeros(FILTER_BITS, dtype=bool)
        self.seed_bits[(seeds & T.U64(FILTER_BITS - 1)).view(np.int64)] = True
        self.by_word, self.by_content = [], []  # (embedder, table, filter, seeds needed) of each class
        if not len(use):
            return
        top, least = min(WINDOW, int(size.max())), int(size[use].min())
        for starts, rows, cut_off, out in ((start, row, 0, self.by_word), (chosen, chosen_row, 2 * GRAM, self.by_content)):
            sizes = [min(top, least - cut_off)]  # a place chosen by content lies within 2 * GRAM bytes of the item's start
            while sizes[-1] * CLASS_GROWTH <= top:
                sizes.append(int(np.ceil(sizes[-1] * CLASS_GROWTH)))
            windows: dict[int, list[tuple[int, int]]] = defaultdict(list)  # class -> (item, place in it)
            need: dict[int, int] = defaultdict(lambda: 2)
            cut = np.searchsorted(rows, np.arange(len(size) + 1))
            for k, i in enumerate(use.tolist()):
                mine, m = starts[cut[i]:cut[i + 1]] - off[i], int(size[i])
                c = sizes[int(np.searchsorted(sizes, m - cut_off, side="right")) - 1]
                places = _window_starts(mine, m, c)
                windows[c] += [(k, x) for x in places]
                seeded = has_seed[np.searchsorted(has_seed, off[i]):np.searchsorted(has_seed, off[i + 1])] - off[i]
                for x in places:  # no more than the item itself has
                    need[c] = min(need[c], int(np.searchsorted(seeded, x + c) - np.searchsorted(seeded, x)))
            for c, places in sorted(windows.items()):
                if places:
                    one = cut_off or c < 5 * SEED
                    out.append((*self._table(Embedder(c, walks, bands, bits), places), 1 if one else max(1, need[c])))

    def _table(self, e: Embedder, places: list[tuple[int, int]]):
        """Sorted keys of all windows with the window of each (12 bytes an entry), and the windows' items and places."""
        keys, held = [], np.zeros(FILTER_BITS, dtype=bool)
        for a in range(0, len(places), 4096):
            keys.append(e.keys(np.stack([self.items[i][x:x + e.size] for i, x in places[a:a + 4096]])))
            held[(keys[-1].ravel() & T.U64(FILTER_BITS - 1)).view(np.int64)] = True
        n = np.concatenate([np.full(k.shape[0], k.shape[1]) for k in keys])
        flat, owner = np.concatenate([k.ravel() for k in keys]), np.repeat(np.arange(len(places), dtype=np.int32), n)
        order = np.argsort(flat, kind="stable")
        return e, (flat[order], owner[order], np.array(places, dtype=np.int64)), held

    def candidates(self, off, raw, start, row) -> dict[tuple[int, int], set[int]]:
        """(row, item) -> where the item would start for its windows to lie where a document's window shares a band with them."""
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        inside = _long_words(off, raw, start, row)
        if self.short:
            at = np.union1d(start, inside)
            at_row = np.searchsorted(off, at, side="right") - 1
            for size, items in self.short.items():
                ok = np.flatnonzero(at + size <= off[at_row + 1])
                h = T.span_hashes(raw, at[ok], at[ok] + size, lower=False)
                known = np.isin(h, np.fromiter(items, dtype=T.U64, count=len(items)))
                for k, x in zip(ok[known].tolist(), h[known].tolist()):
                    for item in items[x]:
                        found[int(at_row[k]), item].add(int(at[k]))
        self._shared_bands(found, self.by_word, off, raw, start, row)
        if self.by_content and len(inside):
            self._shared_bands(found, self.by_content, off, raw, *minimizers(off, raw, inside))
        return found

    def _shared_bands(self, found, classes, off, raw, start, row) -> None:
        seeds, ok = _seeds(off, raw, start, row)
        hit = np.zeros(len(start), dtype=bool)
        hit[ok] = self.seed_bits[(seeds & T.U64(FILTER_BITS - 1)).view(np.int64)]
        if not hit.any():
            return
        upto = np.concatenate(([0], np.cumsum(hit)))
        end = off[row + 1]
        padded = np.concatenate((raw, np.zeros(max((e.size for e, *_ in classes), default=0), dtype=np.uint8)))
        for e, (known, owner, places), held, need in classes:
            reach = np.searchsorted(start, np.minimum(start + int(e.size * (1 + self.max_edit)) + 1, end))
            windows = np.flatnonzero((upto[reach] - upto[:-1] >= need) & (end - start >= e.size * (1 - self.max_edit)))
            for a in range(0, len(windows), 4096):
                w = windows[a:a + 4096]
                strings = np.lib.stride_tricks.sliding_window_view(padded, e.size)[start[w]]
                over = np.flatnonzero(start[w] + e.size > end[w])
                strings[over] *= np.arange(e.size) < (end[w] - start[w])[over, None]
                keys = e.keys(strings)
                r, c = np.nonzero(held[(keys & T.U64(FILTER_BITS - 1)).view(np.int64)])
                first, last = (np.searchsorted(known, keys[r, c], side=x) for x in ("left", "right"))
                for i, a0, b0 in zip(r[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist()):
                    for item, x in places[owner[a0:b0]].tolist():
                        found[int(row[w[i]]), item].add(int(start[w[i]]) - x)

    def search(self, off, raw, start, row):
        """(row, item, first byte, end byte, distance) of the best stretch of each item found."""
        body = raw.tobytes()
        open_ = []  # (row, item, first and last place of a group) still to be measured
        for (r, i), places in sorted(self.candidates(off, raw, start, row).items()):
            item, first, end = self.items[i], int(off[r]), int(off[r + 1])
            m, order = len(item), sorted(places)
            whole = item.tobytes()
            exact = next((p for p in order if first <= p and p + m <= end and body.startswith(whole, p)), None)
            if exact is not None:
                yield r, i, exact, exact + m, 0
                continue
            room, low = int(m * self.max_edit) // 4, order[0]
            for p, after in zip(order, [*order[1:], None]):
                if after is None or after > low + room:
                    open_.append((r, i, low, p))
                    low = after
        open_.sort(key=lambda x: len(self.items[x[1]]))      # alike lengths share a batch
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        a = 0
        while a < len(open_):
            part = open_[a:a + 256]
            part = part[:max(1, (1 << 19) // len(self.items[part[-1][1]]))]
            a += len(part)
            m = np.array([len(self.items[i]) for _, i, _, _ in part])
            limit = (m * self.max_edit).astype(np.int64)
            items = np.zeros((len(part), int(m.max())), dtype=np.int16)
            for k, (_, i, _, _) in enumerate(part):
                items[k, :m[k]] = self.items[i]
            rows = np.array([r for r, _, _, _ in part])
            zero = np.array([p for _, _, p, _ in part]) - limit  # where a text of this batch begins
            width = int((np.array([q - p for _, _, p, q in part]) + 2 * limit).max()) + 1
            at = zero[:, None] + np.arange(int(m.max()) + width)
            texts = raw[np.clip(at, 0, len(raw) - 1)]
            near = np.flatnonzero(may_be_near(items, m, texts, limit))
            if not len(near):
                continue
            part, items, m, limit, rows, zero, texts = [part[k] for k in near], items[near], m[near], limit[near], rows[near], zero[near], texts[near]
            d, last = stretch_ends(items, m, texts, np.maximum(off[rows] - zero, 0), off[rows + 1] - zero, width)
            hit = np.flatnonzero(d <= limit)
            if not len(hit):
                continue
            # backwards from the end: where the stretch starts
            m, limit, last, zero = m[hit], limit[hit], last[hit] + zero[hit], zero[hit]
            back = np.zeros((len(hit), int(m.max())), dtype=np.int16)
            for k, h in enumerate(hit):
                back[k, :m[k]] = items[h, :m[k]][::-1]
            at = last[:, None] - 1 - np.arange(int((m + limit).max()))
            d, used = edit_distances(back, m, raw[np.clip(at, 0, len(raw) - 1)],
                                     np.minimum(last - off[rows[hit]], m + limit), limit)
            for k, h in enumerate(hit):
                r, i = part[h][:2]
                best[r, i] = min(best.get((r, i), (1 << 30, 0, 0)), (int(d[k]), int(last[k] - used[k]), int(last[k])))
        for (r, i), (distance, first, end) in sorted(best.items()):
            yield r, i, first, end, distance


def _block(token: str, shared, *options) -> ItemBlock:
    """The block of one broadcast, built once per Python worker."""
    held = T.held_by("decontamination")
    if token not in held:
        held.clear()
        held[token] = ItemBlock(*shared.value, *options)
    return held[token]


def _matches(block: ItemBlock, texts: pa.Array):
    """(first row, chunk's offsets, byte places, hits) of each chunk with a hit."""
    for a, _, o, r in T.chunks(*T.buffers(texts), 1 << 21) if block.items else ():
        off, raw, start, row, place = compact(o, r)
        hits = list(block.search(off, raw, start, row))
        if hits:
            yield a, o, place, hits


def _blocks_of(items: DataFrame, block_bytes: int):
    """(token, broadcast ids and texts) of each block of ``items``, of about
    ``block_bytes`` each; the driver holds one block at a time."""
    items = items.select("item_id", "text").filter("text is not null")
    total = int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        got = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(
            (got["item_id"].to_pylist(), got["text"].to_pylist())), got.schema.field("item_id").type


def find_items(docs: DataFrame, items: DataFrame, max_edit: float = 0.1, walks: int = 6, bands: int = 24,
               bits: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_byte, end_byte, distance): the best place of each
    item of ``items (item_id, text)`` found in each row of ``docs (doc_id, text)``.

    Bytes count in the document's UTF-8 text; of equal distances the first
    place is given. Null and empty texts match nothing; items of fewer than 32
    bytes without white space are found exactly. Repeated documents or items each give
    their rows; null ids are kept as null. Other columns are ignored; empty
    tables give an empty result.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_byte long, end_byte long, distance int"
    parts = [docs.select("doc_id", "text").mapInArrow(_finder(*b, (max_edit, walks, bands, bits)), schema)
             for b in _blocks_of(items, block_bytes)]
    return reduce(DataFrame.union, parts)


def _finder(token, shared, id_type, options):
    @T.giving_back
    def run(batches):
        block = _block(token, shared, *options)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for a, o, place, hits in _matches(block, batch.column("text")):
                rows = np.array([h[0] for h in hits])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows + a)), pa.array([block.ids[h[1]] for h in hits], id_type),
                     pa.array([int(place[h[2]] - o[h[0]]) for h in hits], pa.int64()),
                     pa.array([int(place[h[3] - 1] + 1 - o[h[0]]) for h in hits], pa.int64()),
                     pa.array([h[4] for h in hits], pa.int32())],
                    ["doc_id", "item_id", "start_byte", "end_byte", "distance"])
    return run


def clean_documents(docs: DataFrame, items: DataFrame, max_edit: float = 0.1, walks: int = 6, bands: int = 24,
                    bits: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, all columns kept, decided
    row by row where they are (no join). Nulls and empty tables as in ``find_items``."""
    for token, shared, _ in _blocks_of(items, block_bytes):
        docs = docs.mapInArrow(_cleaner(token, shared, (max_edit, walks, bands, bits)), docs.schema)
    return docs


def _cleaner(token, shared, options):
    @T.giving_back
    def run(batches):
        block = _block(token, shared, *options)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for a, _, _, hits in _matches(block, batch.column("text")):
                keep[[a + h[0] for h in hits]] = False
            yield batch.filter(pa.array(keep))
    return run
