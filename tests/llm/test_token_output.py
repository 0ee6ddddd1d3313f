import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from carelens.llm import dac, token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=3000))
def test_dac_round_trip_and_random_access(ids):
    r = dac.Reader(dac.encode(np.array(ids, dtype=np.uint32)))
    assert len(r) == len(ids) and r.all().tolist() == ids
    for i in random.Random(1).sample(range(len(ids)), min(40, len(ids))):
        assert r.get(i) == ids[i]
    with pytest.raises(IndexError):
        r.get(len(ids))


def test_widths_are_the_best_of_all_cuts():
    ids = np.array([1] * 500 + [300] * 100 + [40_000] * 30)
    size = lambda w: len(dac.encode(ids, w))
    best = dac.choose_widths(ids)
    assert sum(best) == 16 and size(best) <= min(size(w) for w in ((16,), (8, 8), (1, 15), (2, 7, 7), (1, 8, 7)))


def rows(prose):
    return [(3, prose(1, 200)), (1, "It's   a Test\tof ''words'' 123 x y"), (2, None), (7, ""), (5, "é ́x ÀÉ"),
            (9, "<|endoftext|> a<|startoftext|>b"), (11, "x" * 5000), (12, " \n\t "), (13, "ΣΑΣ ας 日本語 😀😀"), (13, "ΣΑΣ ας 日本語 😀😀"),
            (None, "null id"), (4, prose(2, 3000))]


def test_equals_the_library(spark, make_docs, prose):
    tok = Tokenizer.from_file(PATH)
    data = rows(prose)
    got = token_output.token_table(make_docs(data).repartition(3), PATH).collect()
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for d, t in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)


def test_segments_are_random_access_and_cut_between_documents(spark, make_docs, prose, tmp_path):
    data = [(i, prose(i, 50 + i)) for i in range(40)]
    path = str(tmp_path / "tokens")
    token_output.write_tokens(make_docs(data), path, PATH, segment_tokens=500)
    tok = Tokenizer.from_file(PATH)
    segments = token_output.read_segments(spark, path).collect()
    assert len(segments) > 5
    for s in segments:
        r = dac.Reader(bytes(s["ids"]))
        for d, a in zip(s["doc_ids"], s["doc_starts"]):
            ids = [*tok.encode(dict(data)[d], add_special_tokens=False).ids, 1]
            assert [r.get(a + j) for j in (0, len(ids) // 2, len(ids) - 1)] == [ids[0], ids[len(ids) // 2], 1]


def test_empty_table(make_docs):
    assert token_output.token_table(make_docs([]), PATH).collect() == []


def encoded(enc, texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
    ids, n = enc.encode(off, np.frombuffer(b"".join(raw), dtype=np.uint8), 1)
    ends = np.cumsum(n)
    return [ids[b - k:b].tolist() for b, k in zip(ends, n)]


ENCODER, TOKENIZER = token_output.WordEncoder(PATH), Tokenizer.from_file(PATH)
PARTS = ["'", "'s", "'RE", "’", "a", "T", "don", "ß", "É", "é", "́", "̈", "×", "÷", "«", "µ", "7", "12", ".", "!", "<", "<|endoftext|>", "<|ENDOFTEXT|>",
         "|>", " ", "\n", "\x01", "\x00", "\x85", " ", ";", "K", "Σ", "İ", "日本", "😀", "_", "</w>", "&&&", "-"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=4))
def test_words_in_parts_equal_the_library(texts):
    assert encoded(ENCODER, texts) == [[*TOKENIZER.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_words_that_share_parts_are_encoded_once(monkeypatch):
    enc, given_ = token_output.WordEncoder(PATH), []

    class Heard:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **options):
            given_.extend(texts)
            return self.tok.encode_batch_fast(texts, **options)

    for name in [k for k, v in vars(enc).items() if isinstance(v, Tokenizer)]:
        monkeypatch.setattr(enc, name, Heard(getattr(enc, name)))
    texts = ["reading, Reading! (reading) 1990 1909", "READING. reading-reading 9019 \"Reading\""]
    assert encoded(enc, texts) == [[*TOKENIZER.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert sum(t.lower().count("reading") for t in given_) == 1
    assert sum(t.count("9") for t in given_) == 1


def test_memory_grows_and_is_emptied(monkeypatch, prose):
    monkeypatch.setattr(token_output, "CACHE_WORDS", 300)
    enc = token_output.WordEncoder(PATH)
    for i in range(5):
        texts = [" ".join(f"{prose(9 * i + j, 40)} {''.join(random.Random(i * 99 + j + k).choices('abcdefgh', k=6))}" for k in range(200)) for j in range(3)]
        assert encoded(enc, texts) == [[*TOKENIZER.encode(t, add_special_tokens=False).ids, 1] for t in texts]
