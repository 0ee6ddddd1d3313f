"""Removal of repeated byte strings with a logarithmic family of suffix indexes (operator 4).

A byte is removed if some string of ``MATCH`` bytes over it also starts
earlier: in a document of smaller id, or before it in the same document.

*Sparse suffix arrays.* A suffix is indexed only where it starts an anchor: a
``KMER``-byte string whose hash is the least of some ``MATCH``-byte window. Equal
windows have equal anchors, so no match is lost, and about 1 suffix in 35 is
kept. An entry holds the hash of its first KMER bytes, the hash of its
*context* (MATCH bytes on, MATCH - KMER back, clipped at the text's ends), the
document and the place; an index is sorted by them.

*Logarithmic family.* Documents come in batches of ascending id. A batch's
sorted entries are merge-scanned with those of all levels; its new contexts
become a run of level 0, and ``fanout`` runs of one level merge into the next.

*Merge scan.* Entries of one context are equal in every window over the
anchor, so all but the earliest lose them whole. Different contexts of one
anchor may share some windows: the earliest entry of each goes to a second
scan with its text, where the windows that belong to the anchor (it is their
leftmost least) are compared. The contexts of a frequent anchor are dealt to
several tasks, each taking a slice of the window hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.session import scratch_path

from . import text as T
from .bitmap import id_bitmap, marked_rows
from .tables import exists, remove, store

MATCH = 100
KMER = 32
BACK = MATCH - KMER
CHUNK = 1 << 18
ENTRY = "h long, c long, doc long, at long"
NO_ID = -(1 << 63)  # a null doc_id comes first
SLICE = 20_000      # contexts of one anchor compared in one task without slicing


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for every i (shorter at the end)."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.concatenate((op(x[:-step], x[step:]), x[-step:])) if len(x) > step else x
        have += step
    return x


def _sums(raw: np.ndarray, which: int = 0):
    up, down = T.powers(len(raw) + 1)
    c = np.zeros(len(raw) + 1, dtype=T.U64)
    np.cumsum(T.BYTE_VALUES[which][raw] * up[:len(raw)], out=c[1:])
    return c, down


def _span(sums, a, b):
    c, down = sums
    return T.mix((c[b] - c[a]) * down[a] + (b - a).astype(T.U64))


def ranks(off: np.ndarray, raw: np.ndarray, sums) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each place's KMER-byte string, and the least rank in each
    MATCH-byte window of a row (0 where none starts)."""
    n = len(raw)
    v = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    at = np.arange(max(0, n - KMER + 1))
    v[:len(at)] = (_span(sums, at, at + KMER) >> T.U64(33)).astype(np.uint32) + 1
    row_end = np.repeat(off[1:], np.diff(off))
    least = _slide(v, BACK + 1, np.minimum)
    least[np.arange(n) + MATCH > row_end] = 0
    return v, least


def anchors(off: np.ndarray, raw: np.ndarray, sums) -> np.ndarray:
    """Places whose KMER-byte string has the least hash of some MATCH-byte window of its row."""
    if len(raw) < MATCH:
        return np.zeros(0, dtype=np.int64)
    v, least = ranks(off, raw, sums)
    # the greatest of the window minima over a place, from windows that start up to BACK before it
    most = _slide(least[::-1], BACK + 1, np.maximum)[::-1]
    return np.flatnonzero((most == v) & (v < 0xFFFFFFFF))


def pack(place, tag, hi):
    """One ascending long: place, 24 bits of the text's hash, bytes on (up to MATCH)."""
    return (place.astype(np.int64) << 32) | (tag.astype(np.int64) << 8) | hi.astype(np.int64)


def unpack(at: np.ndarray):
    return at >> 32, (at >> 8) & 0xFFFFFF, at & 0xFF


def _firsts(keys: list[np.ndarray]) -> np.ndarray:
    """True where a sorted row differs from the one before in some key."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _batch(kind, h, c, doc, at):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(np.int32(kind), len(h)) if np.isscalar(kind) else kind, pa.int32()),
         pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(at)],
        ["kind", "h", "c", "doc", "at"])


SPAN, COMPARE, ENTRY_KIND, OLD = 1, 2, 3, 4


def _later_copies(kind, h, c, doc, at):
    """Sort by (h, c, doc, at) and split: the earliest of each (h, c) keeps ``kind``, the others are spans."""
    order = np.lexsort((at, doc, c, h))
    h, c, doc, at = h[order], c[order], doc[order], at[order]
    first = _firsts([h, c])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
    keep = first | ((doc == doc[lead]) & (at == at[lead]))  # the same place twice is one place
    keep &= _firsts([h, c, doc, at])
    drop = ~((doc == doc[lead]) & (at == at[lead]))
    h, c = np.where(drop, T.U64(0), h.view(T.U64)), np.where(drop, T.U64(0), c.view(T.U64))  # a span needs its place only
    return _batch(np.where(keep, kind, SPAN)[keep | drop].astype(np.int32), h[keep | drop], c[keep | drop], doc[keep | drop], at[keep | drop])


@T.giving_back
def _entries(batches):
    """Anchors of each text, one per context and Arrow batch; later copies are spans already."""
    for batch in batches:
        docs = batch.column("doc").to_numpy()
        tags = batch.column("tag").to_numpy()
        found = []
        for a, b, o, r in T.chunks(*T.buffers(batch.column("text")), CHUNK):
            sums = _sums(r)
            x = anchors(o, r, sums)
            if len(x):
                row = np.searchsorted(o, x, side="right") - 1
                lo, hi = np.minimum(BACK, x - o[row]), np.minimum(MATCH, o[row + 1] - x)
                c = T.mix(_span(sums, x - lo, x + hi) + lo.astype(T.U64))
                found.append((_span(sums, x, x + KMER), c, docs[a + row], pack(x - o[row], tags[a + row], hi)))
        if found:
            yield _later_copies(ENTRY_KIND, *(np.concatenate(f) for f in zip(*found)))


@T.giving_back
def _scan(batches):
    """Merge scan of sorted entries. State over Arrow batches: the open
    anchor, its open context's first entry, and whether its first context is still alone."""
    last_h = last_c = lead_doc = lead_at = None
    alone = None  # the first entry of the open anchor until a second context shows
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        if (kinds == SPAN).any():
            yield batch.filter(pa.array(kinds == SPAN))
            batch, kinds = batch.filter(pa.array(kinds != SPAN)), kinds[kinds != SPAN]
        if not batch.num_rows:
            continue
        h, c, doc, at = (batch.column(x).to_numpy() for x in ("h", "c", "doc", "at"))
        new = kinds == ENTRY_KIND
        n = len(h)
        hb, cb = _firsts([h]), _firsts([h, c])
        same_h = last_h is not None and h[0] == last_h
        same_c = same_h and c[0] == last_c
        hb[0], cb[0] = not same_h, not same_c
        lead = np.maximum.accumulate(np.where(cb, np.arange(n), -1))
        ld = np.where(lead >= 0, doc[np.maximum(lead, 0)], lead_doc if lead_doc is not None else 0)
        la = np.where(lead >= 0, at[np.maximum(lead, 0)], lead_at if lead_at is not None else 0)
        copy = new & ~cb & ((doc != ld) | (at != la))
        out = [(SPAN, copy), (ENTRY_KIND, cb & new)]
        # anchors with two contexts or more, of which one is new: the first entry of each
        group = np.cumsum(hb)
        many = np.bincount(group, weights=cb, minlength=group[-1] + 1)
        fresh = np.bincount(group, weights=cb & new, minlength=group[-1] + 1) > 0
        many[0] += 1 if same_h else 0                        # group 0 goes on from the batch before
        fresh[0] = True
        fresh[group[-1]] |= True                             # may go on in the next one
        compare = cb & ((many >= 2) & fresh)[group]
        out.append((COMPARE, compare))
        for kind, pick in out:
            if pick.any():
                none = np.zeros(int(pick.sum()), dtype=np.int64)
                yield _batch(kind, *((none, none) if kind == SPAN else (h[pick], c[pick])), doc[pick], at[pick])
        if alone is not None and same_h and cb[group == 0].any():
            yield _batch(COMPARE, *(np.array([v], dtype=np.int64) for v in alone))
            alone = None
        if not same_h or group[-1] > 0:
            i = int(np.flatnonzero(hb)[-1])
            alone = None if many[group[-1]] >= 2 else (h[i], c[i], doc[i], at[i])
        last_h, last_c, lead_doc, lead_at = h[-1], c[-1], ld[-1], la[-1]


class SuffixIndexes:
    """The family: ``levels`` holds the folders of each level's sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _read(self, paths) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*paths)

    def scan(self, entries: DataFrame) -> DataFrame:
        """(kind, h, c, doc, at) found by merging a batch's entries with every run;
        spans among ``entries`` pass through, spread evenly."""
        if self.runs():
            entries = entries.union(self._read(self.runs()).select(F.lit(OLD).alias("kind"), "*"))
        home = F.when(F.col("kind") == SPAN, F.xxhash64("doc", "at")).otherwise(F.col("h"))
        return entries.repartition(home).sortWithinPartitions("h", "c", "doc", "at").mapInArrow(_scan, "kind int, " + ENTRY)

    def add(self, path: str) -> None:
        """Add a sorted run to level 0 and merge full levels."""
        self._put(0, path)

    def _put(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = scratch_path(self.spark, "suffix_run")
            self._read(full).repartition("h").sortWithinPartitions("h", "c", "doc", "at").write.parquet(merged)
            remove(self.spark, *full)
            self._put(level + 1, merged)


CONTEXT = "h long, slice int, slices int, doc long, tag int, place long, body binary"
SPANS = "doc long, tag int, start long, end long"


@T.giving_back
def _contexts(batches):
    """For each listed anchor the stretch of text whose windows belong to it."""
    for batch in batches:
        docs, tags, todo = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), batch.column("todo")
        for a, b, o, r in T.chunks(*T.buffers(batch.column("text")), CHUNK):
            sums = _sums(r)
            v, least = ranks(o, r, sums)
            flat = [todo[a + i].values.flatten() for i in range(b - a)]
            n = [len(f[0]) for f in flat]
            row = np.repeat(np.arange(b - a), n)
            x = np.concatenate([f[0].to_numpy() for f in flat]) + o[row]
            slices = np.concatenate([f[1].to_numpy() for f in flat])
            for k in range(0, len(x), 4096):
                yield from _some_contexts(x[k:k + 4096], row[k:k + 4096], slices[k:k + 4096], o, r, sums, v, least, docs[a:], tags[a:])


def _some_contexts(x, row, slices, o, r, sums, v, least, docs, tags):
    p = x[:, None] - np.arange(BACK, -1, -1)               # window starts over the anchor, left to right
    own = (p >= o[row][:, None]) & (least[np.maximum(p, 0)] == v[x][:, None])
    tie = (v[np.maximum(p, 0)] == v[x][:, None]) & (p >= o[row][:, None])
    tie[:, -1] = False
    last = np.where(tie.any(axis=1), BACK - tie[:, ::-1].argmax(axis=1), -1)
    own &= np.arange(BACK + 1) > last[:, None]             # an equal anchor to the left owns the windows over both
    keep = own.any(axis=1)
    first, final = own.argmax(axis=1), BACK - own[:, ::-1].argmax(axis=1)
    i = np.arange(len(x))
    a, b = p[i, first][keep], p[i, final][keep] + MATCH
    x, row, slices = x[keep], row[keep], slices[keep]
    body = [r[s:e].tobytes() for s, e in zip(a, b)]
    who = np.repeat(np.arange(len(x)), slices)
    number = np.arange(len(who)) - np.repeat(np.cumsum(slices) - slices, slices)
    yield pa.RecordBatch.from_arrays(
        [pa.array(_span(sums, x, x + KMER).view(np.int64)[who]), pa.array(number, pa.int32()), pa.array(slices[who], pa.int32()),
         pa.array(docs[row][who]), pa.array(tags[row][who], pa.int32()), pa.array((a - o[row])[who]),
         pa.array(body, pa.binary()).take(pa.array(who))],
        ["h", "slice", "slices", "doc", "tag", "place", "body"])


@T.giving_back
def _compare(batches):
    """Contexts sorted by (h, slice, doc, place): each window but the earliest of its string is a span.
    The open anchor's earliest windows are carried to the next Arrow batch (a slice of them: bounded)."""
    carry = None
    for big in batches:
        for k in range(0, big.num_rows, 4096):
            batch = big.slice(k, 4096)
            off, raw = T.buffers(batch.column("body"))
            h, piece, slices, doc, tag, place = (batch.column(c).to_numpy() for c in ("h", "slice", "slices", "doc", "tag", "place"))
            n = np.diff(off) - MATCH + 1
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = off[:-1][row] + at
            w1 = _span(_sums(raw), start, start + MATCH)
            mine = (w1 >> T.U64(8)) % slices[row].astype(T.U64) == piece[row].astype(T.U64)
            row, at, start, w1 = row[mine], at[mine], start[mine], w1[mine]
            x = [h[row], piece[row], w1, _span(_sums(raw, 1), start, start + MATCH), doc[row], place[row] + at, tag[row], row]
            if carry is not None:
                x = [np.concatenate((c, y)) for c, y in zip(carry, x)]
            order = np.lexsort((x[6], x[5], x[4], x[3], x[2], x[1], x[0]))
            x = [y[order] for y in x]
            first = _firsts(x[:4])
            lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
            later = (x[7] >= 0) & ((x[4] != x[4][lead]) | (x[5] != x[5][lead]) | (x[6] != x[6][lead]))
            if later.any():  # windows in a row of one context make one span
                r, s, d, t = x[7][later], x[5][later], x[4][later], x[6][later]
                o = np.lexsort((s, r))
                r, s, d, t = r[o], s[o], d[o], t[o]
                new = np.ones(len(r), dtype=bool)
                new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
                i = np.flatnonzero(new)
                e = np.append(i[1:], len(r)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(t[i], pa.int32()), pa.array(s[i]), pa.array(s[e] + MATCH)],
                                                 ["doc", "tag", "start", "end"])
            if len(h):
                tail = first & (x[0] == h[-1]) & (x[1] == piece[-1])
                carry = [y[tail] for y in x]
                carry[7] = np.full(int(tail.sum()), -1)


def _cut(with_text: bool):
    @T.giving_back
    def run(batches):
        for batch in batches:
            off, raw = T.buffers(batch.column("text"))
            spans = batch.column("spans") if "spans" in batch.schema.names else None
            n_removed, n_spans, sha, kept = [], [], [], []
            for i in range(batch.num_rows):
                body = raw[off[i]:off[i + 1]]
                if spans is not None and spans[i].is_valid and len(spans[i]):
                    start, end = (x.to_numpy() for x in spans[i].values.flatten())
                    edge = np.zeros(len(body) + 1, dtype=np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
                    body = body[~gone]
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                sha.append(hashlib.sha256(body.tobytes()).hexdigest())
                kept.append(body.tobytes() if with_text else None)
            out = [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(n_removed, pa.int64()),
                   pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())][:6 if with_text else 5]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:len(out)])
    return run


def _free(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs: it does so when the driver collects garbage."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, batches: int = 3, fanout: int = 2, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept if asked for), one row per row of ``docs (doc_id, text)``.

    ``kept`` is binary: a cut may split a character. Null and empty texts have 0
    bytes; texts under MATCH bytes lose nothing. A null doc_id comes before all
    others. Rows that repeat an id and its text are one document and get equal
    results; rows with one id and different texts are different documents
    whose order is that of their text hashes where places are equal. Other
    columns are ignored; an empty table gives an empty result. With three
    batches or more levels merge, and a later batch is scanned against a merged run.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        "tag", F.pmod(F.xxhash64("text"), F.lit(1 << 24)).cast("int"))
    family = SuffixIndexes(spark, fanout)
    edges = docs.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10000).alias("e")).first()["e"] if batches > 1 else []
    bounds = [None, *sorted(set(edges or [])), None]
    found: list[str] = []
    for low, high in zip(bounds[:-1], bounds[1:]):
        part = docs
        if low is not None:
            part = part.filter(F.col("doc") > low)
        if high is not None:
            part = part.filter(F.col("doc") <= high)
        scan = family.scan(part.select("doc", "tag", "text").mapInArrow(_entries, "kind int, " + ENTRY))
        if high is None:  # no batch follows: its run is not needed
            scan = scan.filter(F.col("kind") != ENTRY_KIND)
        path = scratch_path(spark, "suffix_scan")
        scan.write.partitionBy("kind").parquet(path)
        found.append(path)
        _free(spark)  # a merge needs the disk that the scan's shuffle took
        if high is not None and exists(spark, f"{path}/kind={ENTRY_KIND}"):
            family.add(f"{path}/kind={ENTRY_KIND}")
        _free(spark)
    rows = [spark.read.schema("h long, c long, doc long, at long, kind int").parquet(p) for p in found]
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.union(r)
    place = F.shiftright("at", 32)
    tag = F.shiftright("at", 8).bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("tag")
    compare, cpath = store(all_rows.filter(F.col("kind") == COMPARE).select("h", "doc", "at").distinct(), "suffix_compare")
    slices = compare.groupBy("h").agg(F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("slices"))
    todo, tpath = store(compare.join(slices, "h").groupBy("doc", tag).agg(
        F.collect_set(F.struct(place.alias("place"), "slices")).alias("todo")), "suffix_todo")
    some = marked_rows(docs.select("doc", "tag", "text"), id_bitmap(todo, "doc"), "doc")
    partial = some.join(todo, ["doc", "tag"]).mapInArrow(_contexts, CONTEXT).repartition("h", "slice").sortWithinPartitions(
        "h", "slice", "doc", "place", "tag").mapInArrow(_compare, SPANS)
    whole_spans = all_rows.filter(F.col("kind") == SPAN).select(
        "doc", tag, F.greatest(F.lit(0), place - BACK).alias("start"), (place + F.col("at").bitwiseAND(F.lit(0xFF))).alias("end"))
    spans, _ = store(partial.union(whole_spans).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")), "suffix_spans")
    remove(spark, cpath, tpath, *family.runs(), *found)
    _free(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    marks = id_bitmap(spans, "doc")
    touched = marked_rows(docs, marks, "doc").join(spans, ["doc", "tag"], "left").select("doc_id", "text", "spans")
    whole = marked_rows(docs, marks, "doc", False).select("doc_id", "text")
    return touched.mapInArrow(_cut(with_text), schema).union(whole.mapInArrow(_cut(with_text), schema))
