"""Token ids of whole texts in randomly addressable binary segments (operator 9).

Rows are range-partitioned and sorted by doc_id; each task encodes its texts
and writes *segments*: rows of a Parquet folder holding the documents' ids and
offsets and their token ids as directly addressable codes (``dac``). A segment
is closed at ``SEGMENT_TOKENS`` ids, whole documents only. Task and segment
number order the segments as the documents are ordered.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelens.session import scratch_path

from . import dac
from . import text as T

SEGMENT_TOKENS = 1 << 20
CACHE_WORDS = 1_000_000
MARK = "\x01"  # stands between words that are encoded together
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_ODD, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _ODD, dtype=np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
SEGMENT_SCHEMA = ("part int, seg int, n_docs int, n_tokens long, doc_ids array<long>, "
                  "doc_starts array<long>, ids binary")


def cuts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are letters (ASCII, and \u00c0 to \u00ff in UTF-8), and before which bytes ``SPLITS``
    always cuts: between letters and ASCII signs, and at ASCII digits, but not behind an
    apostrophe. Nothing is known of other bytes: no cut beside them."""
    kind = _KIND[raw]
    c3 = np.flatnonzero(raw[:-1] == 0xC3)
    c3 = c3[(raw[c3 + 1] != 0x97) & (raw[c3 + 1] != 0xB7)]  # the signs for times and division
    kind[c3] = kind[c3 + 1] = _LETTER
    cut = np.zeros(len(raw), dtype=bool)
    a, b = kind[:-1], kind[1:]
    cut[1:] = (a != _ODD) & (b != _ODD) & ((a != b) | (a == _DIGIT)) & (raw[:-1] != ord("'"))
    return kind == _LETTER, cut


class Memory:
    """Ids by two 64-bit hashes: a hash table of places (4 bytes a slot), two hashes, a
    start and a size per entry (28 bytes) and the ids; no Python objects."""

    def __init__(self):
        self.n, self.n_ids = 0, 0
        self.slot = np.full(1 << 12, -1, dtype=np.int32)
        self.first, self.second = np.zeros(0, dtype=T.U64), np.zeros(0, dtype=T.U64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _hold(self, name: str, n: int, new: np.ndarray):
        old = getattr(self, name)
        if n + len(new) > len(old):
            old = np.resize(old, max(1024, 2 * (n + len(new)))) if len(old) else np.zeros(max(1024, 2 * len(new)), old.dtype)
            setattr(self, name, old)
        old[n:n + len(new)] = new

    def _at(self, first: np.ndarray) -> np.ndarray:
        return (first & T.U64(len(self.slot) - 1)).view(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Place of each entry, -1 where it is not there."""
        out, open_, at = np.full(len(first), -1, dtype=np.int64), np.arange(len(first)), self._at(first)
        while len(open_) and self.n:
            place = self.slot[at]
            same = (place >= 0) & (self.first[place] == first[open_])
            out[open_[same]] = place[same]
            on = (place >= 0) & ~same
            open_, at = open_[on], (at[on] + 1) & (len(self.slot) - 1)
        return np.where((out >= 0) & (self.second[out] == second), out, -1) if self.n else out

    def add(self, first: np.ndarray, second: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Entries whose first hashes are new and different."""
        for name, new in (("first", first), ("second", second), ("size", size),
                          ("start", self.n_ids + np.cumsum(size, dtype=np.int64) - size)):
            self._hold(name, self.n, new)
        self._hold("flat", self.n_ids, flat)
        todo = np.arange(self.n, self.n + len(first), dtype=np.int32)
        self.n, self.n_ids = self.n + len(first), self.n_ids + len(flat)
        if 2 * self.n > len(self.slot):
            self.slot = np.full(1 << int(4 * self.n).bit_length(), -1, dtype=np.int32)
            todo = np.arange(self.n, dtype=np.int32)
        at = self._at(self.first[todo])
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            on = self.slot[at] != todo  # taken, or another entry of this round came to the same slot
            todo, at = todo[on], (at[on] + 1) & (len(self.slot) - 1)


class WordEncoder:
    """Encodes texts with a tokenizer whose splits never cross ASCII white space
    (its pre-tokenizer drops white space), remembering the ids of the *units* seen.

    A unit is a word or, if the tokenizer splits as ``SPLITS`` says, a part of one:
    words are cut where that pre-tokenizer cuts them whatever stands around (``cuts``).
    Units of letters alone are one pre-token each and already in NFC; they are encoded
    many at a time without the normalizer's and the pre-tokenizer's patterns. The memory
    is emptied at ``CACHE_WORDS`` units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        mark = self._ids([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.plain = None
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == SPLITS and all("<" in t["content"] for t in said["added_tokens"]):
            self.plain = Tokenizer.from_file(path)  # the same model; words of letters need no more than this
            self.plain.normalizer = normalizers.Lowercase()
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = said["model"]["end_of_word_suffix"]
            self.last = np.array([(self.tok.id_to_token(i) or "").endswith(suffix) for i in range(self.tok.get_vocab_size())])
        self.memory = Memory()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and ids per word, from one call for all with a mark between them;
        word by word if some word holds the mark or the marks do not come out one each."""
        if self.mark is not None and not any(MARK in w for w in words):
            ids = np.array(self._ids([f" {MARK} ".join(words)])[0], dtype=np.uint32)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(words) - 1:
                return np.delete(ids, at), np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1
        each = self._ids(words)
        return np.array([x for i in each for x in i], dtype=np.uint32), np.array([len(i) for i in each])

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_together``, for words of letters alone: each ends with the one id that ends a word."""
        ids = np.array(self.plain.encode_batch_fast([b" ".join(words).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype=np.uint32)
        at = np.flatnonzero(self.last[ids])
        if len(at) == len(words) and at[-1] == len(ids) - 1:
            return ids, np.diff(at, prepend=-1)
        return self._together([w.decode("utf-8", "replace") for w in words])

    def _encoded(self, units: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units and ids per unit; those of letters alone come first."""
        n = int(plain.sum())
        parts = [self._letters(units[i:min(i + 256, n)]) for i in range(0, n, 256)]
        rest = [u.decode("utf-8", "replace") for u in units[n:]]
        parts += [self._together(rest[i:i + 256]) for i in range(0, len(rest), 256)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int32)

    def _units(self, off: np.ndarray, raw: np.ndarray):
        """Start, end and row of each unit, whether it is of letters alone, and the bytes with these in lower case."""
        begin, end, row = T.words(off, raw)
        if self.plain is None or not len(begin):
            return begin, end, row, np.zeros(len(begin), dtype=bool), raw
        letter, cut = cuts(raw)
        angle = np.flatnonzero(raw == ord("<"))
        if len(angle):  # may be a special token: such words stay whole
            at = np.unique(np.searchsorted(begin, angle, side="right") - 1)
            edge = np.zeros(len(raw) + 1, dtype=np.int8)
            edge[begin[at]] += 1
            edge[end[at]] -= 1
            cut &= np.cumsum(edge[:-1], dtype=np.int8) == 0
        head = np.zeros(len(raw), dtype=bool)
        head[begin] = True
        start = np.flatnonzero(cut | head)
        word = np.cumsum(head[start]) - 1
        stop = np.minimum(np.append(start[1:], len(raw)), end[word])
        plain = np.ones(len(start), dtype=bool)
        other = np.flatnonzero(~(letter | T.SPACE[raw]))
        plain[np.searchsorted(start, other, side="right") - 1] = False
        upper = np.flatnonzero((raw >= 65) & (raw <= 90))
        low = raw.copy()
        low[upper[plain[np.searchsorted(start, upper, side="right") - 1]]] += 32
        return start, stop, row[word], plain, low

    def encode(self, off: np.ndarray, raw: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row's followed by ``end_id``; ids per row."""
        if self.memory.n > CACHE_WORDS:
            self.memory = Memory()
        begin, end, unit_row, plain, raw = self._units(off, raw)
        count = np.bincount(unit_row, minlength=len(off) - 1)
        first, second = (T.span_hashes(raw, begin, end, lower=False, which=i) for i in (0, 1))
        memory, code = self.memory, self.memory.find(first, second)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            at = missing[np.unique(first[missing], return_index=True)[1]]
            at = at[np.argsort(~plain[at], kind="stable")]
            body = raw.tobytes()
            flat, size = self._encoded([body[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())], plain[at])
            memory.add(first[at], second[at], flat, size)
            code[missing] = memory.find(first[missing], second[missing])
            if (code < 0).any():  # two units share one hash: without the memory
                memory = Memory()
                each = [self._ids([body[a:b].decode("utf-8", "replace")])[0] for a, b in zip(begin.tolist(), end.tolist())]
                memory.size, memory.flat = np.array([len(x) for x in each], np.int32), np.array([x for e in each for x in e], np.uint32)
                memory.start, code = np.cumsum(memory.size, dtype=np.int64) - memory.size, np.arange(len(each))
                self.memory = Memory()
        size = memory.size[code].astype(np.int64) if len(code) else np.zeros(0, np.int64)
        row_end = np.cumsum(count)
        upto = np.concatenate(([0], np.cumsum(size)))
        n_row = upto[row_end] - upto[row_end - count] + 1
        total = int(n_row.sum())
        out = np.full(total, end_id, dtype=np.uint32)
        place = np.arange(int(upto[-1]))
        if len(code):  # one end id for each row before
            out[np.repeat(unit_row, size) + place] = memory.flat[np.repeat(memory.start[code] - upto[:-1], size) + place]
        return out, n_row


def _encoder(path: str) -> WordEncoder:
    held = T.held_by("token output")
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def _writer(path: str, end_id: int, segment_tokens: int):
    @T.giving_back
    def run(batches):
        enc, part, seg = _encoder(path), TaskContext.get().partitionId(), 0
        ids, sizes, doc_ids, held = [], [], [], 0

        def close():
            size = np.concatenate(sizes)
            starts = np.concatenate(([0], np.cumsum(size)))[:-1]
            body = dac.encode(np.concatenate(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(size)], pa.int32()),
                 pa.array([int(size.sum())], pa.int64()),
                 pa.array([[x for d in doc_ids for x in d]], pa.list_(pa.int64())),
                 pa.array([starts], pa.list_(pa.int64())), pa.array([body], pa.binary())],
                ["part", "seg", "n_docs", "n_tokens", "doc_ids", "doc_starts", "ids"])

        for batch in batches:
            off, raw = T.buffers(batch.column("text"))
            names = batch.column("doc_id")
            for a, b, o, r in T.chunks(off, raw, min(T.CHUNK_BYTES, segment_tokens)):
                x, n = enc.encode(o, r, end_id)
                ids.append(x)
                sizes.append(n)
                doc_ids.append(names.slice(a, b - a).to_pylist())
                held += len(x)
                if held >= segment_tokens:
                    yield close()
                    ids, sizes, doc_ids, held, seg = [], [], [], 0, seg + 1
        if ids:
            yield close()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1,
                 segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the segments of ``docs (doc_id, text)`` to ``path``, in ascending
    doc_id order (null ids first; rows of one id stay together, by text).
    A null text is encoded as empty: the end id alone. Other columns are
    ignored; an empty table writes no segment."""
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
     .sortWithinPartitions("doc_id", "text")
     .mapInArrow(_writer(tokenizer, end_id, segment_tokens), SEGMENT_SCHEMA).write.parquet(path))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


@T.giving_back
def _reader(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in ("part", "seg", "doc_ids", "doc_starts", "ids")}
            ids = dac.Reader(row["ids"].as_py()).all().astype("<u4")
            starts = row["doc_starts"].values.to_numpy()
            ends = np.append(starts[1:], len(ids))
            body = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(body[4 * a:4 * b]) for a, b in zip(starts, ends)]
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["seg"].as_py()] * n, pa.int32()),
                 row["doc_ids"].values, pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32, and its place: part, seg, at (first id within the
    segment). Only one row per write task is ordered in one task."""
    segs = read_segments(spark, path).select("part", "seg", "n_tokens")
    tasks = segs.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("seg")
    starts = segs.withColumn("upto", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(tasks, "part").select(
        "part", "seg", (F.col("before") + F.col("upto")).alias("seg_start"))
    docs = read_segments(spark, path).select("part", "seg", "doc_ids", "doc_starts", "ids").mapInArrow(
        _reader, "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seg"]).select(
        "doc_id", (F.col("seg_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seg", "at")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode, write to a fresh shared folder, read the files back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
