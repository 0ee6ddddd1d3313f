"""A byte-level BPE tokenizer from its JSON file, exact on pieces of a text.

The file's vocabulary, merges and pre-tokenizer are read as they are; texts are
encoded by tiktoken over the same vocabulary, which gives the ids that the
tokenizers library gives and is several times as fast. A file of another kind
(other splits, a normalizer, merges out of id order, added tokens that strip
white space) is refused with an error.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from .text import held_by

# Fixed value: the split rule that byte-level tokenizers of this kind use.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: a split starts at such a space whatever stands before or after it
SURE = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: a split that ends so many bytes (three characters) before the end of a text stays as it is, whatever follows
MARGIN = 12
SLICE = 1 << 16


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a local file to all executors; tasks open it as ``SparkFiles.get(name)``."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary: printable
    Latin-1 characters for themselves, the other bytes from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encodes text exactly as the tokenizers library does with the file at ``path``
    (no special tokens added). With ``plain`` the strings of added tokens in a text are text."""

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec.get("added_tokens") or []
        if (model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or any(model.get(k) for k in ("dropout", "unk_token", "end_of_word_suffix", "ignore_merges"))
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        chars = byte_of_char()
        words = {t["content"] for t in added}
        ranks = {bytes(chars[c] for c in w): i for w, i in model["vocab"].items() if w not in words}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: merges do not follow the ids")
        self.path, self.plain, self.pre = path, plain, None
        self.special = {t["content"].encode(): t["id"] for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names and not plain else None
        self.tik = tiktoken.Encoding("byte_bpe", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})
        size = max([*ranks.values(), *self.special.values()]) + 1
        table = [b""] * size
        for w, i in [*ranks.items(), *self.special.items()]:
            table[i] = w
        self.length = np.array([len(w) for w in table], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.narrow = "<u2" if size <= 1 << 16 else "<u4"  # the type of an id that is on its way

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text in which added tokens are not looked for."""
        return self.tik.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32) if text else np.zeros(0, np.uint32)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, joined."""
        n = self.length[ids]
        upto = np.cumsum(n)
        where = np.arange(int(upto[-1]) if len(n) else 0) + np.repeat(self.start[ids] - (upto - n), n)
        return self.flat[where].tobytes()

    def splits(self, text: bytes) -> np.ndarray:
        """Byte length of each split of the text, from the library's own pre-tokenizer."""
        if self.pre is None:
            from tokenizers import Tokenizer
            self.pre = Tokenizer.from_file(self.path).pre_tokenizer
        return np.array([len(w) for w, _ in self.pre.pre_tokenize_str(text.decode("utf-8", "replace"))], dtype=np.int64)

    def sure_end(self, text: bytes) -> int:
        """The last place found in ``text`` (which starts with a split) that starts a split whatever follows the text."""
        for a in (max(0, len(text) - 256), 0):
            found = [m.start() for m in SURE.finditer(text, a)]
            if found:
                return found[-1]
        ends = np.cumsum(self.splits(text))
        ends = ends[ends <= len(text) - MARGIN]
        return int(ends[-1]) if len(ends) else 0

    def prefix_ids(self, text: bytes, end: int) -> np.ndarray:
        """Ids of ``text[:end]`` where a split of ``text`` ends at ``end``."""
        if end == len(text) or SURE.match(text, end):
            return self.ids(text[:end].decode("utf-8", "replace"))
        out, at = [], 0
        for n in self.splits(text):  # split by split: the end of a text must not look like the end of a run of blanks
            if at >= end:
                break
            out.append(self.ids(text[at:at + n].decode("utf-8", "replace")))
            at += int(n)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def meet(self, left: bytes, right: bytes) -> int | None:
        """First place in ``right`` where a split starts both in ``right`` alone and in
        ``left + right`` (whatever follows): from there on the ids of ``right`` hold. None if they never agree."""
        if not left:
            return 0
        found = SURE.search(right)
        if found:
            return found.start()
        own = np.concatenate(([0], np.cumsum(self.splits(right))[:-1]))
        both = np.cumsum(self.splits(left + right)) - len(left)
        same = np.intersect1d(own, both[(both >= 0) & (both <= len(right) - MARGIN)])
        return int(same[0]) if len(same) else None


class Joiner:
    """Ids of one text that comes in pieces: plain text, or chunks with the ids they have alone.

    ``tail`` holds the bytes after the last place where a split surely starts.
    A chunk's ids hold from the first split start that it shares with the text
    before it to its last split that no later text can change; what lies
    between is encoded again, over further pieces if need be.
    """

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.out, self.tail = bpe, [], b""

    def _settle(self, end: int):
        self.out.append(self.bpe.prefix_ids(self.tail, end))
        self.tail = self.tail[end:]

    def text(self, body: bytes):
        for a in range(0, len(body), SLICE):
            self.tail += body[a:a + SLICE]
            if len(self.tail) >= SLICE:
                end = self.bpe.sure_end(self.tail)
                if end:
                    self._settle(end)

    def chunk(self, ids: np.ndarray):
        body = self.bpe.bytes_of(ids)
        at = self.bpe.meet(self.tail, body)
        if at is None:
            return self.text(body)
        self.tail += body
        self._settle(len(self.tail) - len(body) + at)
        end = self.bpe.sure_end(body)
        if end > at:
            ends = np.concatenate(([0], np.cumsum(self.bpe.length[ids])))
            i, j = np.searchsorted(ends, (at, end))
            if ends[i] == at and ends[j] == end:
                self.out.append(ids[i:j])
                self.tail = body[end:]

    def special(self, token: int):
        self._settle(len(self.tail))
        self.out.append(np.array([token], dtype=np.uint32))

    def ids(self) -> np.ndarray:
        self._settle(len(self.tail))
        return np.concatenate(self.out) if self.out else np.zeros(0, np.uint32)


def encode(bpe: ByteBPE, body: bytes) -> np.ndarray:
    """Ids of a whole text, in slices of bounded size."""
    parts = bpe.split_special.split(body) if bpe.split_special else [body]
    if len(parts) == 1 and len(body) < SLICE:
        return bpe.ids(body.decode("utf-8", "replace"))
    one = Joiner(bpe)
    for i, p in enumerate(parts):
        if i % 2:
            one.special(bpe.special[p])
        else:
            one.text(p)
    return one.ids()


def loaded(name: str, plain: bool = False) -> ByteBPE:
    """The tokenizer of a shipped file, once per Python worker."""
    held = held_by("byte BPE")
    if (name, plain) not in held:
        held.clear()
        held[name, plain] = ByteBPE(SparkFiles.get(name), plain)
    return held[name, plain]
