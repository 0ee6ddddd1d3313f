"""Operator 11: ids and decoded text against the tokenizers library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from carelens.llm import bpe_chunks, byte_bpe
from carelens.llm import text as T
from carelens.llm.entry import op11_bpe_chunk_reuse

PATH = public_tokenizers.path("byte_bpe_50k.json")
MIXED = ["the ", "don't", "'re", "'", "r", "e", " ", "  ", "\n", "\n\n", "\t", "漢字", "ñandú", "42", "é", "!?", "\x85", " ", "a", "ll",
         "😀", "<|endoftext|>", "<|", "endoftext", "x" * 70, "é", "؀", "½", "\x1c"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(PATH)


def mixed(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(MIXED) for _ in range(n))


def by_library(lib, rows):
    out = []
    for doc_id, text, *_ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, tuple(ids), lib.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=repr)


def by_operator(df):
    rows = bpe_chunks.decode(bpe_chunks.encode(df, PATH), PATH).collect()
    return sorted([(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in rows], key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_pieces_join_to_the_ids_of_the_whole(lib, bpe, seed):
    """Chunks cut anywhere, reused or not, give the library's ids."""
    r = random.Random(seed)
    text = mixed(seed, r.choice([5, 40, 400])).replace("<|endoftext|>", "")
    one, at = byte_bpe.Joiner(bpe), 0
    while at < len(text):
        n = r.choice([1, 2, 5, 30, 200])
        body = text[at:at + n].encode()
        one.chunk(bpe.ids(body.decode())) if r.random() < 0.7 else one.text(body)
        at += n
    assert one.ids().tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000 + "x", "漢字" * 60_000, "\n" * 70_000 + "b", "ab cd " * 40_000,
                                  "<|endoftext|>" * 9_000, "! " * 50_000 + "\n\n  '"])
def test_long_texts_in_slices(lib, bpe, text):
    assert byte_bpe.encode(bpe, text.encode()).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_every_character_splits_alike(lib, bpe):
    for c in [*range(0x250), *range(0x250, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} '{chr(c)}s"
            assert bpe.ids(s).tolist() == lib.encode(s, add_special_tokens=False).ids


def test_cuts_follow_the_content(prose):
    body = prose(1, 4000)
    raw = np.frombuffer((prose(2, 50) + body).encode(), np.uint8)
    other = np.frombuffer(body.encode(), np.uint8)
    h1 = set(bpe_chunks.chunk_table(np.array([0, len(raw)]), raw)[3].tolist())
    h2 = set(bpe_chunks.chunk_table(np.array([0, len(other)]), other)[3].tolist())
    assert len(h1 & h2) > 0.95 * len(h2)


def rows_of(prose):
    shared, header = prose(3, 500), prose(4, 120)
    rows = [(i, header + prose(100 + i, 40) + " " + shared) for i in range(60)]
    rows += [(100 + i, mixed(i, 120) + shared[:400 + i] + mixed(i + 50, 30)) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " "), (203, "x"), (None, shared), (1, header), (1, header), (204, shared * 40),
             (205, "<|endoftext|>" + shared + "<|endoftext|>" + shared), (206, "漢字" * 3000), (207, "漢字" * 3000), (208, "ab" * 30_000)]
    return rows


def test_equals_the_library(lib, make_docs, prose):
    rows = rows_of(prose)
    assert by_operator(make_docs(rows)) == by_library(lib, rows)
    both = bpe_chunks.encode(make_docs(rows), PATH, decoded=True).collect()
    assert sorted([(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in both], key=repr) == by_library(lib, rows)


def test_chunks_are_reused(make_docs, prose, spark):
    docs = make_docs(rows_of(prose)).select("doc_id", "text")
    assert bpe_chunks.repeated_chunks(docs).count() > 10
    seen = bpe_chunks.repeated_bitmap(docs)
    pieces = docs.mapInArrow(bpe_chunks._pieces(seen, byte_bpe.ship_file(spark, PATH)), bpe_chunks.PIECE_SCHEMA)
    chunks = pieces.filter(f"kind = {bpe_chunks.CHUNK}")
    assert chunks.select("key").distinct().count() < chunks.count() / 5


def test_empty_table(make_docs, spark):
    assert by_operator(make_docs([(1, "x")]).filter("false")) == []


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, sf001, lib):
    import hashlib
    got = {r.doc_id: r for r in op11_bpe_chunk_reuse(spark, sf001).collect()}
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
