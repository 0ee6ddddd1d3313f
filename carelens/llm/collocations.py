"""Phrase collocation mining (operator 12).

The words of each language are counted first. The frequent ones get numbers
(one per language and word), and the texts are written once as streams of these
numbers, cut where no frequent phrase can lie: between pieces and at words that
are not frequent. Everything after that reads the streams.

Level by level: for a longer phrase to be frequent, its first and its last words
(all but one) must be frequent: such phrases are gathered from the streams, with
a bound of their support, and become candidates (Apriori). The candidates go
into broadcast double-array tries of bounded size, of which a worker holds one at
a time; a task advances the states of all its text positions together, one level
at a time, counts the accepting states with one bincount per trie, and the
counts of the shards are summed. What reaches the threshold is the next level's
frequent set. Shards go by a phrase's first two words, so a position is looked
up in one trie however many there are.

Words are looked up by 64-bit hashes of their lower-cased bytes and of their
language; every trie numbers its own symbols, and steps by two digits of that
number: no state has more children than a digit has values, which bounds the
room and the time that placing it takes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .tables import ship, stored

MAX_WORDS = 5
SHARD_PHRASES = 1 << 19     # candidates in one trie
GATHER_BYTES = 4 << 20      # text or stream whose candidates are summed before they leave a task
STRETCH_BYTES = 8 << 20     # stream for which each of several tries is read once
SPREAD = 1_000_003          # first word of a phrase, before its second is added, for the shard's number
ROW_SYMBOLS = 512           # numbers in a row of a stream, more only where a run is longer
SUM_ROWS = 1 << 17          # phrases whose counts a task sums before they leave it
EMIT_ROWS = 1 << 16         # rows handed to Spark at a time
ROUNDS = 6                  # places tried for the states of a size class before there is more room
DIRECT = 16                 # symbols below so many times their number are looked up in a table
_CUT = np.zeros(256, dtype=bool)
_CUT[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 32]] = True
WORDS = [f"w{i}" for i in range(1, MAX_WORDS + 1)]
BY = f"w1 * {SPREAD} + w2"  # deals phrases to shards


# --- double-array trie ---------------------------------------------------------

@dataclass
class Trie:
    """``symbols`` (sorted hashes) number the symbols from 1; a symbol is two digits, its number's
    upper bits and its lowest ``bits``. The child of state s by digit c is base[s] + c where
    check[base[s] + c] == s; ``leaf`` numbers the ``n`` phrases. ``direct`` has the numbers of symbols
    that are small themselves (all of a stream are), else None."""
    symbols: np.ndarray
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray
    n: int
    depth: int
    bits: int
    direct: np.ndarray | None

    def number(self, h: np.ndarray) -> np.ndarray:
        """Symbol numbers of hashes, 0 where unknown."""
        if self.direct is not None:
            return self.direct.take(h, mode="clip")  # both ends are 0
        i = np.minimum(np.searchsorted(self.symbols, h), len(self.symbols) - 1)
        return np.where(self.symbols[i] == h, i + 1, 0)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which of them exist."""
        half = self.base[state] + (symbol >> self.bits)
        to = self.base[half] + (symbol & ((1 << self.bits) - 1))
        return to, (self.check[half] == state) & (self.check[to] == half) & (symbol > 0)


def _place(owner: np.ndarray, digit: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """A base for each set of child digits (below ``width``; owners 0, 1, ... in order) so that no two
    children share a slot, and how many slots there are. Slot 0 is the root.

    Sets that fill a quarter of the width have a stretch each. The others follow by falling size, all of
    a size class together: at random places, where those without a clash stay and the rest try again, from
    time to time in new room. Single children take the slots that are free. No set is placed on its own,
    so the time grows with the children's number.
    """
    n = np.bincount(owner)
    base = np.zeros(len(n), dtype=np.int64)
    wide = np.flatnonzero(4 * n >= width)
    base[wide] = 1 + width * np.arange(len(wide))
    used = np.zeros(1 + width * (len(wide) + 1), dtype=bool)
    used[0] = True
    on = 4 * n[owner] >= width
    used[base[owner[on]] + digit[on]] = True
    r, top = np.random.default_rng(1), int(n.max(initial=0, where=4 * n < width))
    while top > 1:
        sets = np.flatnonzero((n <= top) & (2 * n > top) & (n > 1) & (4 * n < width))
        of = np.full(len(n), -1)
        of[sets] = np.arange(len(sets))
        on = of[owner] >= 0
        who, c, low, rounds = of[owner[on]], digit[on], 0, 0
        while len(sets):
            at = r.integers(low, len(used) - width + 1, len(sets))
            slot = at[who] + c
            claim = np.zeros(len(used), dtype=np.int32)
            claim[slot] = who
            bad = np.bincount(who[used[slot] | (claim[slot] != who)], minlength=len(sets)) > 0
            base[sets[~bad]] = at[~bad]
            used[slot[~bad[who]]] = True
            again = bad[who]
            sets, who, c = sets[bad], (np.cumsum(bad) - 1)[who[again]], c[again]
            rounds += 1
            if rounds % ROUNDS == 0 and len(sets):
                low = len(used) - width
                used = np.concatenate((used, np.zeros(max(width, 4 * len(c)), dtype=bool)))
        top //= 2
    one = np.flatnonzero((n == 1) & (4 * n < width))
    if len(one):
        free = width + np.flatnonzero(~used[width:])[:len(one)]
        more = len(one) - len(free)
        free = np.concatenate((free, max(len(used), width) + np.arange(more)))
        base[one] = free - digit[np.searchsorted(owner, one)]
        used = np.concatenate((used, np.ones(more, dtype=bool)))
    return base, len(used) + width


def build(phrases: np.ndarray) -> Trie:
    """The trie of the rows of ``phrases`` (symbols in order; distinct)."""
    symbols = np.unique(phrases)
    rows = np.searchsorted(symbols, phrases) + 1
    depth = rows.shape[1]
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    bits = (len(symbols).bit_length() + 1) // 2
    parent_of_row = np.zeros(len(rows), dtype=np.int64)
    node_parent, node_digit, n_nodes = [], [], 1
    for d in range(2 * depth):  # nodes of a level: the distinct prefixes
        digit = rows[:, d // 2] & ((1 << bits) - 1) if d % 2 else rows[:, d // 2] >> bits
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (digit[1:] != digit[:-1]) | (parent_of_row[1:] != parent_of_row[:-1])
        node = n_nodes + np.cumsum(new) - 1
        node_parent.append(parent_of_row[new])
        node_digit.append(digit[new])
        n_nodes += int(new.sum())
        parent_of_row = node
    parent, digit = np.concatenate(node_parent), np.concatenate(node_digit)  # of node 1, 2, ...; parents in order
    first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
    bases, size = _place(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(parent)))), digit, 1 << bits)
    node_base = np.zeros(n_nodes, dtype=np.int64)
    node_base[parent[first]] = bases
    state = np.zeros(n_nodes, dtype=np.int64)  # slot of a node
    state[1:] = node_base[parent] + digit
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[state] = node_base
    check[state[1:]] = state[parent]
    leaf[state[parent_of_row]] = order
    direct = None
    if symbols[0] > 0 and symbols[-1] < DIRECT * len(symbols) + (1 << 16):
        direct = np.zeros(symbols[-1] + 2, dtype=np.int32)
        direct[symbols] = np.arange(1, len(symbols) + 1)
    return Trie(symbols, base, check, leaf, len(rows), depth, bits, direct)


# --- text positions --------------------------------------------------------------

@dataclass
class Positions:
    hash: np.ndarray   # of each word
    piece: np.ndarray  # number of the piece it stands in
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def positions(off: np.ndarray, raw: np.ndarray) -> Positions:
    """All words of the texts in order."""
    cut = _CUT[raw]
    word = ~(cut | _BLANK[raw])
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    start = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | edge[1:])) + 1 if len(raw) else start
    row = np.searchsorted(off, start, side="right") - 1
    piece = np.cumsum(cut)[start] + row if len(raw) else start  # both only grow
    return Positions(T.span_hashes(raw, start, end).view(np.int64), piece, row, start, end)


def _batches(batches):
    """Positions, bytes, language hash per row and language names of stretches of text."""
    for batch in batches:
        off, raw = T.buffers(batch.column("text"))
        lang = batch.column("lang_hash").to_numpy(zero_copy_only=False)
        for a, b, o, r in T.chunks(off, raw, GATHER_BYTES):
            yield positions(o, r), r, lang[a:b], batch.column("lang").slice(a, b - a)
        pa.default_memory_pool().release_unused()


def reach(trie: Trie, symbols: np.ndarray, depth: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (and states) at which a path of ``depth`` symbols of the trie starts, among the places ``at`` (all without).
    A stream ends with 0, which no trie has, so no path leaves it."""
    if at is None:
        at = np.flatnonzero(symbols)
    state = np.zeros(len(at), np.int64)
    for d in range(depth):
        state, ok = trie.step(state, trie.number(symbols[at + d]))
        at, state = at[ok], state[ok]
    return at, state


def _reached(tries, symbols: np.ndarray, depth: int):
    """For each trie (None where a shard is empty) its number, the trie, and places and states that
    ``reach`` gives: a place is looked up in one of them only, that of its first two symbols."""
    shard = None
    if len(tries) > 1:
        at = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
        shard = (symbols[at] * SPREAD + symbols[at + 1]) % len(tries)
    for i, t in enumerate(tries):
        if t is not None:
            trie = _held(t, len(tries) == 1)
            yield i, trie, *reach(trie, symbols, depth, None if shard is None else at[shard == i])


def _words(batches):
    for p, raw, lang, names in _batches(batches):
        key = T.mix(p.hash.view(np.uint64) ^ T.mix(lang.view(np.uint64))[p.row])
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        low, key = T.LOWER[raw].tobytes(), None
        for a in range(0, len(first), EMIT_ROWS):
            at, found = first[a:a + EMIT_ROWS], n[a:a + EMIT_ROWS]
            words = [low[x:y].decode("utf-8", "replace") for x, y in zip(p.start[at], p.end[at])]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(p.row[at])), pa.array(lang[p.row[at]]), pa.array(p.hash[at]), pa.array(words, pa.string()), pa.array(found.astype(np.int64))],
                ["lang_name", "lang", "w1", "word", "n"])


def _schema(k: int) -> str:
    return ", ".join(f"{w} long" for w in WORDS[:k]) + ", n long"


def _emit(cols, n):
    """Batches of bounded size: both sides of the pipe hold one at a time."""
    for a in range(0, len(n), EMIT_ROWS):
        part = slice(a, a + EMIT_ROWS)
        yield pa.RecordBatch.from_arrays([*[pa.array(c[part]) for c in cols], pa.array(n[part].astype(np.int64))], [*WORDS[:len(cols)], "n"])


def _held(shared, alone: bool):
    """A broadcast's value; one of several is not kept, so a worker holds one trie at a time."""
    value = shared.value
    if not alone:
        shared.__dict__.pop("_value", None)  # read again from the executor's disk when it is needed
    return value


def stream(symbols: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The runs of two and more numbered words (not 0) of one piece, each followed by 0."""
    if not len(symbols):
        return symbols
    on = (symbols[:-1] > 0) & (symbols[1:] > 0) & (piece[:-1] == piece[1:])
    after = np.append(on, False)
    at = np.flatnonzero(after | np.concatenate(([False], on)))
    last = ~after[at]
    ends = np.cumsum(last)
    out = np.zeros(len(at) + int(last.sum()), dtype=np.int64)
    out[np.arange(len(at)) + ends - last] = symbols[at]
    return out


def _encode(tries):
    """Streams of the numbers of frequent words, in rows that end between runs. A word is looked up in one trie, that of its hash."""
    def run(batches):
        for p, _, lang, _ in _batches(batches):
            symbols = np.zeros(len(p.hash), dtype=np.int64)
            for i, t in enumerate(tries):
                if t is None:
                    continue
                trie, number = _held(t, len(tries) == 1)
                own = np.arange(len(p.hash)) if len(tries) == 1 else np.flatnonzero(p.hash % len(tries) == i)
                state, ok = trie.step(np.zeros(len(lang), np.int64), trie.number(lang))
                row = p.row[own]
                state, there = trie.step(state[row], trie.number(p.hash[own]))
                on = there & ok[row]
                symbols[own[on]] = number[trie.leaf[state[on]]]
            s = stream(symbols, p.piece)
            ends = np.flatnonzero(s == 0) + 1
            if not len(ends):
                continue
            cuts = ends[np.minimum(np.searchsorted(ends, np.arange(ROW_SYMBOLS, len(s) + ROW_SYMBOLS, ROW_SYMBOLS)), len(ends) - 1)]
            cuts = np.concatenate(([0], np.unique(cuts)))
            for a in range(0, len(cuts) - 1, EMIT_ROWS // 16):
                rows = cuts[a:a + EMIT_ROWS // 16 + 1]
                body = s[rows[0]:rows[-1]].astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(
                    pa.binary(), len(rows) - 1, [None, pa.py_buffer(((rows - rows[0]) * 8).astype(np.int32)), pa.py_buffer(body)])], ["s"])
    return run


def _streams(batches):
    T.drop_powers()  # left by the passes over texts
    for batch in batches:
        off, raw = T.buffers(batch.column("s"))
        for _, _, _, r in T.chunks(off, raw, GATHER_BYTES):
            yield r.view("<i8")
        pa.default_memory_pool().release_unused()


def _stretches(batches, tries):
    """Streams joined to longer stretches where more than one trie is read again for each."""
    held, n = [], 0
    for s in _streams(batches):
        if len(tries) < 2:
            yield s
            continue
        held.append(s)
        n += s.nbytes
        if n >= STRETCH_BYTES:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _parts(s: np.ndarray):
    """Bounds of parts of about GATHER_BYTES that end between runs."""
    a = 0
    while a < len(s):
        b = min(a + GATHER_BYTES // 8, len(s)) - 1
        b += int(np.argmin(s[b:])) + 1  # no number is below 0, and the last is 0
        yield a, b
        a = b


def _merged(parts):
    """(keys, columns, counts) of several stretches as one, equal keys summed."""
    if len(parts) < 2:
        return parts[0]
    key = np.concatenate([p[0] for p in parts])
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    n = np.add.reduceat(np.concatenate([p[2] for p in parts])[order], first)
    at = order[first]
    return key[at], [np.concatenate(c)[at] for c in zip(*[p[1] for p in parts])], n


def _tally(cols, bits: int | None):
    """(keys in order, columns, counts) of the distinct rows. A key is the numbers themselves where all numbers
    have at most ``bits`` bits and the row fits into 63, else a hash of them."""
    if bits is None or bits * len(cols) > 63:
        key = np.zeros(len(cols[0]), dtype=np.uint64)
        for c in cols:
            key = T.mix(key + c.view(np.uint64))
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        return key, [c[first] for c in cols], n
    key = cols[0].copy()
    for c in cols[1:]:
        key <<= bits
        key |= c
    key.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    return key, [(key >> bits * d) & ((1 << bits) - 1) for d in range(len(cols) - 1, -1, -1)], n


def _gather(tries, k: int, bits: int | None = None):
    """Phrases of k words whose first and last k - 1 words are phrases of the tries (any
    words of a stream if k is 2), with their number of places. ``bits``: of the largest number, if it is known."""
    def _marked(batches):
        """Stretches, and where in them one of the tries' phrases starts."""
        for s in _stretches(batches, tries):
            good = s > 0 if k == 2 else np.zeros(len(s), dtype=bool)
            for _, _, at, _ in _reached(tries, s, k - 1):
                good[at] = True
            for a, b in _parts(s) if len(tries) > 1 else [(0, len(s))]:
                yield s[a:b], good[a:b]

    def run(batches):
        held, rows = [], 0
        for s, good in _marked(batches):
            at = np.flatnonzero(good[:-1] & good[1:])
            if not len(at):
                continue
            held.append(_tally([s[at + d] for d in range(k)], bits))
            rows += len(held[-1][0])
            if rows > SUM_ROWS:
                held = [_merged(held)]
                rows = len(held[0][0])
                if 2 * rows > SUM_ROWS:
                    yield from _emit(*held[0][1:])
                    held, rows = [], 0
        if held:
            yield from _emit(*_merged(held)[1:])
    return run


def _count(tries, phrases_of, k: int):
    """Occurrences of the tries' phrases of k words: one bincount per trie and stretch of a stream, one row per phrase found and task."""
    def run(batches):
        total = {}
        for s in _stretches(batches, tries):
            for i, trie, _, state in _reached(tries, s, k):
                n = np.bincount(trie.leaf[state], minlength=trie.n)
                total[i] = total[i] + n if i in total else n
        for i, n in total.items():
            at, rows = np.flatnonzero(n), _held(phrases_of[i], len(tries) == 1)
            yield from _emit([rows[at, d] for d in range(k)], n[at])
    return run


def _dealt(phrases: DataFrame, by: str) -> tuple[DataFrame, int]:
    """The rows with a shard number _s, dealt by the long number ``by``, and how many shards of about SHARD_PHRASES rows there are."""
    parts = max(1, -(-phrases.count() // SHARD_PHRASES))
    return phrases.withColumn("_s", F.pmod(F.expr(by), F.lit(parts).cast("long"))), parts


def _shards(dealt: DataFrame, parts: int, *cols: str):
    """The shards as arrays, one at a time; None for one without rows."""
    for s in range(parts):
        t = dealt.filter(F.col("_s") == s).select(*cols).toArrow()
        yield np.stack([c.to_numpy() for c in t.columns], axis=1) if t.num_rows else None


def frequent_phrases(docs: DataFrame, least: int = 100, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, vocabulary, phrases): totals (lang, n) of all words, vocabulary (lang, word,
    number) of the words with n >= ``least``, and the phrases (key, n) of 1 to
    ``max_words`` words with n >= ``least``; key holds the words' numbers."""
    spark = docs.sparkSession
    ship(spark)
    share = spark.sparkContext.broadcast

    def drop(*shared):
        for t in shared:
            if t is not None:
                t.unpersist()

    name = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select("text", name.alias("lang"), F.xxhash64(name, F.lit("lang")).alias("lang_hash"))
    words = stored(texts.mapInArrow(_words, "lang_name string, lang long, w1 long, word string, n long")
                   .groupBy("lang_name", "lang", "w1", "word").agg(F.sum("n").alias("n")), "words")
    dealt, parts = _dealt(words.filter(F.col("n") >= least), "w1")
    place = F.row_number().over(Window.partitionBy("_s").orderBy(F.desc("n"), "lang", "w1", "word"))  # a shard is bounded
    vocabulary = stored(dealt.withColumn("number", (place.cast("long") - 1) * parts + F.col("_s") + 1), "vocabulary")
    found = vocabulary.select(F.array("number").alias("key"), "n")
    tries = [None if a is None else share((build(a[:, :2]), a[:, 2])) for a in _shards(vocabulary, parts, "lang", "w1", "number")]
    streams = stored(texts.mapInArrow(_encode(tries), "s binary"), "streams", compression="zstd") if any(tries) else None
    drop(*tries)
    tries, bits = [], int(vocabulary.agg(F.max("number")).first()[0] or 0).bit_length()  # tries of the phrases one word shorter
    for k in range(2, max_words + 1):
        if streams is None or k > 2 and not any(tries):
            break
        cols = WORDS[:k]
        bounded = streams.mapInArrow(_gather(tries, k, bits), _schema(k)).groupBy(*cols).agg(F.sum("n").alias("n"))
        candidates = stored(bounded.filter(F.col("n") >= least).drop("n"), "candidates")
        drop(*tries)
        tries, of = [], []
        for rows in _shards(*_dealt(candidates, BY), *cols):
            tries.append(None if rows is None else share(build(rows)))
            of.append(None if rows is None else share(rows))
        if not any(tries):
            break
        level = stored(streams.mapInArrow(_count(tries, of, k), _schema(k)).groupBy(*cols).agg(F.sum("n").alias("n")), "phrases").filter(F.col("n") >= least)
        drop(*tries, *of)
        tries = [a if a is None else share(build(a)) for a in _shards(*_dealt(level, BY), *cols)] if k < max_words else []
        found = found.unionByName(level.select(F.array(*cols).alias("key"), "n"))
    drop(*tries)
    return (words.groupBy(F.col("lang_name").alias("lang")).agg(F.sum("n").alias("n")),
            vocabulary.select(F.col("lang_name").alias("lang"), "word", "number"), found)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases.

    Words, pieces, counts and scores as the query's contract defines them; a
    phrase goes if a phrase one word longer that holds it occurs as often (a
    longer one that does so has one of these between). Null texts have no
    words, null languages are ``und``; words of texts that repeat count each
    time; an empty table or one without frequent phrases gives no rows; columns
    beside text and lang are ignored, whatever their names. Only the language
    and text are read, long texts are cut nowhere.
    """
    totals, vocabulary, found = frequent_phrases(docs, least, max_words)
    all_ = found.withColumnRenamed("n", "f")
    cand = all_.filter(F.size("key") > 1).withColumnRenamed("f", "a")
    longer = cand.filter(F.size("key") > 2)
    inner = longer.select(F.explode(F.array(F.expr("slice(key, 1, size(key) - 1)"), F.expr("slice(key, 2, size(key) - 1)"))).alias("key"),
                          F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    kept = cand.join(inner, "key", "left").filter("longer IS NULL OR longer < a").drop("longer")
    language = vocabulary.select("lang", F.col("number").alias("first")).join(totals, "lang")  # a number belongs to one language
    kept = kept.withColumn("first", F.col("key")[0]).join(language, "first").drop("first")
    cut = kept.select("*", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k")).select(
        "lang", "key", "a", "n", "k", F.expr("slice(key, 1, k)").alias("lkey"), F.expr("slice(key, k + 1, size(key))").alias("rkey"))
    cut = (cut.join(all_.select(F.col("key").alias("lkey"), F.col("f").alias("l")), "lkey")
           .join(all_.select(F.col("key").alias("rkey"), F.col("f").alias("r")), "rkey"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cut = cut.withColumn("score", F.call_function(
        "div", (wide("a") * wide("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")))
    best = cut.groupBy("lang", "key", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spelled = (best.select("*", F.posexplode("key").alias("i", "number")).join(vocabulary.select("number", "word"), "number")
               .groupBy("lang", "key", "a", "n", "b").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("s"))
               .select("lang", F.concat_ws(" ", "s.word").alias("phrase"), "a", "b.l", "b.r", "n", F.col("b.score").alias("score")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
