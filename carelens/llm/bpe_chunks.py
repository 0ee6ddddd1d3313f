"""BPE encoding with content-defined chunk reuse, and decoding (operator 11).

A rolling hash over 16 bytes cuts every text into chunks at places that depend
on the bytes around them alone, so a passage that many documents share gives
the same chunks in all of them. A chunk that occurs twice or more in the table
is encoded once; texts that consist of such chunks for half of their bytes or
more (``MIN_SHARE``: below that, moving a text costs more than encoding it)
take the ids by a join, and where two pieces meet, the text around the joint is encoded again until the splits agree
with the chunk's own (``byte_bpe.Joiner``), so the ids are exactly those of the
whole text. All other texts are encoded where they are read.

Which texts those are is told by a bitmap of the repeated chunks (``bitmap``).
It has a fixed size and only ever lets too much through: the more it lets
through, the more texts go by way of the chunk table, with the same ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap
from . import text as T
from .byte_bpe import Joiner, encode as encode_text, loaded, ship_file
from .tables import ship, store

WINDOW = 16
CUT_BITS = 8   # a chunk has about 256 bytes
LEAST = 64     # a place close behind another one is no cut
MIN_SHARE = 0.5
TEXT, CHUNK, SPECIAL = 0, 1, 2
IDS_SCHEMA = "doc_id long, ids binary"
TEXT_SCHEMA = IDS_SCHEMA + ", decoded string"
PIECE_SCHEMA = "part int, row long, doc_id long, pos int, kind int, key binary, body binary"
_GEAR = T.random_u64("gear", 256).astype(np.uint32)


def cuts(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Start of every chunk: row starts and content-defined places (character
    starts, at least LEAST bytes behind any other place the hash marks)."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    g, m = _GEAR[raw], 1
    while m < WINDOW:  # g[i] = sum over the last WINDOW bytes of value << distance
        h = g.copy()
        h[m:] += g[:-m] << np.uint32(m)
        g, m = h, 2 * m
    mark = np.flatnonzero(g >> np.uint32(WINDOW - CUT_BITS) & np.uint32((1 << CUT_BITS) - 1) == 0)
    mark = mark[np.diff(mark, prepend=-LEAST) >= LEAST]
    mark = mark[(raw[mark] & 0xC0) != 0x80]
    row = np.searchsorted(off, mark, side="right") - 1
    mark = mark[mark - off[row] >= WINDOW]
    return np.unique(np.concatenate((off[:-1][np.diff(off) > 0], mark)))


def chunk_table(off: np.ndarray, raw: np.ndarray):
    """Start, end, row and 64-bit hash of every chunk."""
    start = cuts(off, raw)
    end = np.append(start[1:], len(raw))
    return start, end, np.searchsorted(off, start, side="right") - 1, T.span_hashes(raw, start, end, lower=False)


def _hashes(batches):
    for batch in batches:
        off, raw = T.buffers(batch.column("text"))
        for _, _, o, r in T.chunks(off, raw):
            h, n = np.unique(chunk_table(o, r)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Hash and count of the chunks that occur twice or more."""
    return (docs.select("text").mapInArrow(_hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            .filter("n > 1"))


def _in_bitmap(h: np.ndarray, seen) -> np.ndarray:
    bit = h % np.uint64(bitmap.BITS)
    return (seen[(bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7))).astype(np.uint8)) & 1 > 0


def repeated_bitmap(docs: DataFrame):
    """Broadcast bitmap of the repeated chunks' hashes (``bitmap.BITS`` bits)."""
    words = (repeated_chunks(docs).select(F.expr(f"h & {bitmap.BITS - 1}L").alias("b"))
             .groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 31))")).alias("v")).toArrow())
    full = np.zeros(bitmap.BITS // 32, dtype="<u4")
    full[words["w"].to_numpy()] = words["v"].to_numpy().astype("<u4")
    bits = np.packbits(np.unpackbits(full.view(np.uint8), bitorder="little"))
    return docs.sparkSession.sparkContext.broadcast(bits)


def _marked(o, r, seen):
    start, end, row, h = chunk_table(o, r)
    hit = _in_bitmap(h, seen)
    share = np.bincount(row[hit], weights=(end - start)[hit], minlength=len(o) - 1)
    return start, end, row, hit, (share > 0) & (share >= MIN_SHARE * np.diff(o))


def _text(bpe, ids: np.ndarray) -> str:
    return bpe.bytes_of(ids).decode("utf-8", "replace")


def _rows(bpe, doc_ids: pa.Array, ids: list[np.ndarray], decoded: bool) -> pa.RecordBatch:
    cols = [doc_ids, pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
    if decoded:
        cols.append(pa.array([_text(bpe, x) for x in ids], pa.string()))
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][:len(cols)])


def _alone(seen, name: str, decoded: bool):
    """Ids of the texts that hold too few chunks of the bitmap to take them from elsewhere."""
    def run(batches):
        bpe = loaded(name)
        for batch in batches:
            off, raw = T.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b, o, r in T.chunks(off, raw):
                shared = _marked(o, r, seen.value)[4]
                rows = np.flatnonzero(~shared)
                yield _rows(bpe, ids.slice(a, b - a).take(pa.array(rows)), [encode_text(bpe, r[o[i]:o[i + 1]].tobytes()) for i in rows], decoded)
            pa.default_memory_pool().release_unused()
    return run


def _pieces(seen, name: str):
    """The other texts as pieces: chunks in the bitmap, and the text between them."""
    def run(batches):
        bpe, part, n_rows = loaded(name), TaskContext.get().partitionId(), 0
        for batch in batches:
            off, raw = T.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b, o, r in T.chunks(off, raw):
                start, end, row, hit, shared = _marked(o, r, seen.value)
                keep = np.flatnonzero(shared[row])
                out = []
                last, pos = -1, 0
                joins = False  # whether the last piece is text that the next chunk without reuse may extend
                for i in keep:
                    if row[i] != last:
                        last, pos, joins = row[i], 0, False
                    body = r[start[i]:end[i]].tobytes()
                    for j, p in enumerate(bpe.split_special.split(body) if bpe.split_special else [body]):
                        kind = SPECIAL if j % 2 else CHUNK if hit[i] else TEXT
                        if not p:
                            continue
                        if kind == TEXT and joins:
                            out[-1][3].append(p)
                            continue
                        out.append((last, pos, kind, [p]))
                        joins, pos = kind == TEXT, pos + 1
                names = ids.slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(out), pa.int32()), pa.array([n_rows + int(x[0]) for x in out], pa.int64()),
                    pa.array([names[x[0]] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                    pa.array([x[2] for x in out], pa.int32()),
                    pa.array([hashlib.blake2b(x[3][0], digest_size=16).digest() if x[2] == CHUNK else None for x in out], pa.binary()),
                    pa.array([b"".join(x[3]) for x in out], pa.binary())],
                    ["part", "row", "doc_id", "pos", "kind", "key", "body"])
                n_rows += b - a
    return run


def _encode_chunks(name: str):
    def run(batches):
        bpe = loaded(name)
        for batch in batches:
            ids = [bpe.ids(x.decode("utf-8", "replace")).astype(bpe.narrow).tobytes() for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])
    return run


def _assemble(name: str, decoded: bool):
    """Rows sorted by part, row, pos: the pieces of one text follow each other."""
    def run(batches):
        bpe, now, one, doc = loaded(name), None, None, None
        for batch in batches:
            done = []
            for part, row, doc_id, kind, body in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "doc_id", "kind", "body"))):
                if (part, row) != now:
                    if one is not None:
                        done.append((doc, one.ids()))
                    now, one, doc = (part, row), Joiner(bpe), doc_id
                if kind == CHUNK:
                    one.chunk(np.frombuffer(body, dtype=bpe.narrow).astype(np.uint32))
                elif kind == TEXT:
                    one.text(body)
                else:
                    one.special(bpe.special[body])
            yield _rows(bpe, pa.array([x[0] for x in done], pa.int64()), [x[1] for x in done], decoded)
            pa.default_memory_pool().release_unused()
        if one is not None:
            yield _rows(bpe, pa.array([doc], pa.int64()), [one.ids()], decoded)
    return run


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers in one binary) of every row of ``docs (doc_id, text)``;
    with ``decoded`` also the text that the ids decode to, found where they are made.

    A null or empty text has no ids (an empty binary, not null). Rows that
    repeat, also with one doc_id, each give a row; other columns are ignored,
    whatever their names; an empty table gives no rows. Long texts are encoded
    in slices cut where the tokenizer surely splits. Text that is not valid
    UTF-8 is read with U+FFFD in place of what cannot be decoded.
    """
    spark = docs.sparkSession
    ship(spark)
    name = ship_file(spark, tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = TEXT_SCHEMA if decoded else IDS_SCHEMA
    seen = repeated_bitmap(docs)
    alone = docs.mapInArrow(_alone(seen, name, decoded), schema)
    # written, so that the numbers of rows stay when they are read twice
    pieces, _ = store(docs.mapInArrow(_pieces(seen, name), PIECE_SCHEMA), "pieces")
    chunks = pieces.filter(F.col("kind") == CHUNK)
    once = chunks.groupBy("key").agg(F.first("body").alias("body")).mapInArrow(_encode_chunks(name), "key binary, ids binary")
    place = ["part", "row", "doc_id", "pos", "kind"]
    placed = chunks.select(*place, "key").join(once, "key").select(*place, F.col("ids").alias("body"))
    rest = pieces.filter(F.col("kind") != CHUNK).select(*place, "body")
    joined = (placed.unionByName(rest).repartition("part", "row").sortWithinPartitions("part", "row", "pos")
              .mapInArrow(_assemble(name, decoded), schema))
    return alone.unionByName(joined)


def _decode(name: str, columns: list[str]):
    def run(batches):
        bpe = loaded(name)
        for batch in batches:
            text = [None if x is None else _text(bpe, np.frombuffer(x, dtype="<u4"))
                    for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(text, pa.string())], [*columns, "decoded"])
    return run


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids`` (added tokens kept as
    their strings); bytes that are no UTF-8 become U+FFFD. Null ids give null."""
    spark: SparkSession = encoded.sparkSession
    ship(spark)
    name = ship_file(spark, tokenizer)
    columns = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in columns) + ", decoded string"
    return encoded.select(*columns).mapInArrow(_decode(name, columns), schema)
