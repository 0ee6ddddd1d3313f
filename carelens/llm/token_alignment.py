"""Alignment of two tokenizers' tokens over the same bytes (operator 13).

Both tokenizers encode a text; the ends of their tokens are two sorted lists
of byte offsets. All documents of a batch are merged in lockstep: one numpy
state vector holds a pair of pointers per document (a long document is cut into
lanes of LANE bytes, each with its own pair), every step compares the two ends
under all pointers at once, emits a link and a cut where they are equal,
advances the pointer that is behind, and drops the lanes that are done.

Two tokens that end together hold the same last bytes, so one is a suffix of
the other. That bounds the pairs that can ever be linked by the two
vocabularies (a few hundred thousand): the corpus-wide counts are one vector
over those pairs, which is small enough to broadcast whatever the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.session import scratch_path

from . import text as T
from .byte_bpe import ByteBPE, encode, loaded, ship_file
from .tables import ship

LANE = 256
SLICE = 1 << 16
TABLE_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, slots binary"
TOKEN_SCHEMA = TABLE_SCHEMA + ", a_ids binary, b_ids binary, link_a binary, link_b binary"


class PieceModel:
    """A sentencepiece BPE model whose pieces never hold a space behind another character."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        table = []
        for i in range(self.sp.get_piece_size()):
            p = self.sp.id_to_piece(i)
            if "▁" in p.lstrip("▁"):
                raise ValueError(f"{path}: piece {p!r} goes over a space")
            table.append(bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode())
        self.table = table
        self.length = np.array([len(w) for w in table], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    bytes_of = ByteBPE.bytes_of

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text; a long one in slices that end before a space behind
        another character, whose place the prefix of the next slice takes."""
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) - 1 and not (text[end] == " " and text[end - 1] not in " ▁"):
                end += 1
            end = end if end < len(text) - 1 else len(text)
            out.append(np.array(self.sp.encode(text[at:end], num_threads=1), dtype=np.uint32))
            at = end if end == len(text) else end + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def linkable_pairs(a_table: list[bytes], b_table: list[bytes]) -> np.ndarray:
    """Sorted codes (A id * size of B + B id) of all pairs of which one token is a suffix of the other."""
    of_a, of_b = {}, {}
    for table, of in ((a_table, of_a), (b_table, of_b)):
        for i, w in enumerate(table):
            of.setdefault(w, []).append(i)
    n, codes = len(b_table), set()
    for w, ids in of_a.items():
        for k in range(len(w)):
            codes.update(i * n + j for j in of_b.get(w[k:], ()) for i in ids)
    for w, ids in of_b.items():
        for k in range(1, len(w)):
            codes.update(i * n + j for i in of_a.get(w[k:], ()) for j in ids)
    return np.array(sorted(codes), dtype=np.int64)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``end_a`` and ``end_b`` (sorted) whose values are equal, for all lanes (lo, hi] at once."""
    pa_, sa = np.searchsorted(end_a, lo, side="right"), np.searchsorted(end_a, hi, side="right")
    pb, sb = np.searchsorted(end_b, lo, side="right"), np.searchsorted(end_b, hi, side="right")
    link_a, link_b = [], []
    while True:
        alive = (pa_ < sa) & (pb < sb)
        if not alive.all():
            pa_, sa, pb, sb = pa_[alive], sa[alive], pb[alive], sb[alive]
        if not len(pa_):
            break
        x, y = end_a[pa_], end_b[pb]
        same = x == y
        link_a.append(pa_[same])
        link_b.append(pb[same])
        pa_ = pa_ + (x <= y)
        pb = pb + (y <= x)
    if not link_a:
        z = np.zeros(0, dtype=np.int64)
        return z, z
    a, b = np.concatenate(link_a), np.concatenate(link_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _digits(n: int):
    words = [str(i).encode() for i in range(n)]
    length = np.array([len(w) for w in words], dtype=np.int64)
    return np.concatenate(([0], np.cumsum(length)))[:-1], length, np.frombuffer(b"".join(words), dtype=np.uint8)


class Aligner:
    def __init__(self, a: ByteBPE, b: PieceModel):
        self.a, self.b = a, b
        a_table = [a.flat[s:s + n].tobytes() for s, n in zip(a.start, a.length)]
        self.n_b = len(b.table)
        self.codes = linkable_pairs(a_table, b.table)
        self.digit_start, self.digit_len, self.digits = _digits(max(len(a_table), self.n_b))

    def tokens(self, texts: list[bytes]):
        """Ids of both tokenizers per text; none where the joined bytes are not space + text."""
        out = []
        for t in texts:
            if t:
                x, y, whole = encode(self.a, b" " + t), self.b.ids(t.decode("utf-8", "replace")), b" " + t
                if self.a.bytes_of(x) == whole and self.b.bytes_of(y) == whole:
                    out.append((x, y))
                    continue
            out.append((np.zeros(0, np.uint32), np.zeros(0, np.uint32)))
        return out

    def group_text(self, ids_a, ids_b, row_a, row_b, link_a, link_b, n_rows: int):
        """Bytes of ``a1,a2|b1;a3|b2`` of all rows, and the offset of each row."""
        group_a = np.searchsorted(link_a, np.arange(len(ids_a)))  # a link closes a group
        group_b = np.searchsorted(link_b, np.arange(len(ids_b)))
        at_a = np.arange(len(ids_a)) + np.concatenate(([0], link_b + 1))[group_a]
        at_b = np.arange(len(ids_b)) + link_a[group_b] + 1
        total = len(ids_a) + len(ids_b)
        ids, row, after = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[at_a], ids[at_b], row[at_a], row[at_b] = ids_a, ids_b, row_a, row_b
        after[at_a[link_a]] = ord("|")
        after[at_b[link_b]] = ord(";")
        n = self.digit_len[ids] + 1  # the digits and the mark behind them
        upto = np.concatenate(([0], np.cumsum(n)))
        body = np.zeros(int(upto[-1]), dtype=np.uint8)
        mark = upto[1:] - 1
        body[mark] = after
        free = np.ones(len(body), dtype=bool)
        free[mark] = False
        body[free] = self.digits[np.arange(len(body) - total) + np.repeat(self.digit_start[ids] - (upto[:-1] - np.arange(total)), n - 1)]
        return body, upto[np.searchsorted(row, np.arange(n_rows + 1))]

    def align(self, texts: list[bytes]) -> dict:
        """Per text: the ids, the linked positions and pair slots, and the groups' digest."""
        pairs = self.tokens(texts)
        n_a, n_b = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
        ids_a = np.concatenate([x for x, _ in pairs]).astype(np.int64)
        ids_b = np.concatenate([y for _, y in pairs]).astype(np.int64)
        size = np.array([len(t) + 1 if len(x) else 0 for t, (x, _) in zip(texts, pairs)], dtype=np.int64)
        base = np.cumsum(size) - size  # every text in its own stretch of one line of bytes
        row_a, row_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        lanes = -(-size // LANE)
        lo = np.repeat(base - (np.cumsum(lanes) - lanes) * LANE, lanes) + np.arange(int(lanes.sum())) * LANE
        hi = np.minimum(lo + LANE, np.repeat(base + size, lanes))
        link_a, link_b = lockstep(np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b]), lo, hi)
        code = ids_a[link_a] * self.n_b + ids_b[link_b]
        slot = np.searchsorted(self.codes, code)
        if len(code) and not (self.codes[np.minimum(slot, len(self.codes) - 1)] == code).all():
            raise AssertionError("a link between tokens of which none ends in the other")
        body, at = self.group_text(ids_a, ids_b, row_a, row_b, link_a, link_b, len(texts))
        n_links = np.bincount(row_a[link_a], minlength=len(texts))
        sha = [hashlib.sha256(body[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:])]
        return {"n_a": n_a, "n_b": n_b, "n_links": n_links, "slots": slot.astype("<u4"), "sha": sha, "pairs": pairs,
                "link_a": (link_a - np.repeat(np.cumsum(n_a) - n_a, n_links)).astype("<u4"),
                "link_b": (link_b - np.repeat(np.cumsum(n_b) - n_b, n_links)).astype("<u4")}


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners.clear()
        _aligners[a, b] = Aligner(loaded(a, plain=True), PieceModel(SparkFiles.get(b)))
    return _aligners[a, b]


def _split(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
    ends = np.cumsum(n)
    return [flat[e - k:e].tobytes() for e, k in zip(ends, n)]


def _align(a: str, b: str, with_tokens: bool):
    def run(batches):
        al = _aligner(a, b)
        for batch in batches:
            off, raw = T.buffers(batch.column("text"))
            names = batch.column("doc_id")
            for i, j, o, r in T.chunks(off, raw):
                x = al.align([r[p:q].tobytes() for p, q in zip(o[:-1], o[1:])])
                links = pa.array(x["n_links"].astype(np.int64))
                cols = [names.slice(i, j - i), pa.array(x["n_a"].astype(np.int64)), pa.array(x["n_b"].astype(np.int64)), links, links,
                        pa.array(x["sha"], pa.string()), pa.array(_split(x["slots"], x["n_links"]), pa.binary())]
                labels = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots"]
                if with_tokens:
                    cols += [pa.array([p[k].astype("<u4").tobytes() for p in x["pairs"]], pa.binary()) for k in (0, 1)]
                    cols += [pa.array(_split(x[c], x["n_links"]), pa.binary()) for c in ("link_a", "link_b")]
                    labels += ["a_ids", "b_ids", "link_a", "link_b"]
                yield pa.RecordBatch.from_arrays(cols, labels)
            pa.default_memory_pool().release_unused()
    return run


def align(docs: DataFrame, byte_bpe: str, piece_model: str, with_tokens: bool = False) -> DataFrame:
    """Tokens and links of every row of ``docs (doc_id, text)``: n_a, n_b, n_groups,
    n_links, groups_sha256 and ``slots`` (pair numbers of the links, 32-bit); with
    ``with_tokens`` also a_ids, b_ids and link_a, link_b (positions of linked
    tokens in them), as little-endian 32-bit integers in binaries.

    A null or empty text, and one that either tokenizer does not give back byte
    for byte (such as one that holds U+2581), has no tokens: zeros and ''.
    Repeated rows each give a row, other columns are ignored whatever their
    names, an empty table gives no rows, long texts are tokenized in slices.
    """
    spark = docs.sparkSession
    ship(spark)
    a, b = ship_file(spark, byte_bpe), ship_file(spark, piece_model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _align(a, b, with_tokens), TOKEN_SCHEMA if with_tokens else TABLE_SCHEMA)


def _bincount(batches):
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        _, raw = T.buffers(batch.column("slots"))
        n = np.bincount(raw.view("<u4"), minlength=len(total))
        n[:len(total)] += total
        total = n
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot].astype(np.int64))], ["slot", "n"])


def pair_counts(table: DataFrame) -> DataFrame:
    """(slot, n): how many links of the whole table hold the pair; each task sends one count per pair."""
    return table.select("slots").mapInArrow(_bincount, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _rate(shared):
    def run(batches):
        count, best = shared.value
        for batch in batches:
            off, raw = T.buffers(batch.column("slots"))
            s, at = raw.view("<u4"), off // 4
            upto_n, upto_best = np.concatenate(([0], np.cumsum(count[s]))), np.concatenate(([0], np.cumsum(best[s])))
            cols = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.diff(upto_best[at]).astype(np.int64)), pa.array(np.diff(upto_n[at]).astype(np.int64)), batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def alignment_table(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair is the most frequent one of its B id in the whole table, ties included),
    count_sum (the pairs' counts summed over the links) and groups_sha256.

    The texts are tokenized once; the result is written to the shared folder and
    read for the counts and again for the rows. Rows as in :func:`align`.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "links")
    align(docs, byte_bpe, piece_model).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(TABLE_SCHEMA).parquet(path)
    al = Aligner(ByteBPE(byte_bpe, plain=True), PieceModel(piece_model))
    found = pair_counts(table).toArrow()  # at most one row per linkable pair
    count = np.zeros(len(al.codes), dtype=np.int64)
    count[found["slot"].to_numpy()] = found["n"].to_numpy()
    most = np.zeros(al.n_b, dtype=np.int64)
    np.maximum.at(most, al.codes % al.n_b, count)
    best = (count > 0) & (count == most[al.codes % al.n_b])
    shared = spark.sparkContext.broadcast((count, best))
    return table.mapInArrow(_rate(shared), "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                            "n_best long, count_sum long, groups_sha256 string")
