"""Operator 13 against a plain two-pointer alignment over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from carelens.llm import byte_bpe, token_alignment as A
from carelens.llm.entry import op13_token_alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def token_bytes(tools):
    a, sp = tools
    chars = byte_bpe.byte_of_char()
    of_a = {i: bytes(chars[c] for c in w) for w, i in a.get_vocab().items()}

    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
    return of_a.__getitem__, of_b


def brute_force(tools, rows):
    a, sp = tools
    of_a, of_b = token_bytes(tools)
    out, counts = [], Counter()
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = sp.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, x)) != whole or b"".join(map(of_b, y)) != whole:
            out.append((doc_id, [], [], []))
            continue
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((of_a, x), (of_b, y))]
        at_b = {e: j for j, e in enumerate(ends[1])}
        links = [(i, at_b[e]) for i, e in enumerate(ends[0]) if e in at_b]
        counts.update((x[i], y[j]) for i, j in links)
        out.append((doc_id, x, y, links))
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    rows = []
    for doc_id, x, y, links in out:
        i0 = j0 = 0
        groups = []
        for i, j in links:
            groups.append(",".join(map(str, x[i0:i + 1])) + "|" + ",".join(map(str, y[j0:j + 1])))
            i0, j0 = i + 1, j + 1
        n = [counts[x[i], y[j]] for i, j in links]
        rows.append((doc_id, len(x), len(y), len(links), len(links), sum(k == best[y[j]] for k, (_, j) in zip(n, links)), sum(n),
                     hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    return sorted(rows, key=repr)


def test_equals_brute_force(tools, make_docs, prose):
    r = random.Random(5)
    odd = ["<s>", "</s>", "<|endoftext|>", "<0x41>", "漢字", "😀", "  ", "\n", "é", "x" * 40, "don't", "\x00", "\t", " "]
    rows = [(i, prose(i, r.choice([1, 5, 60, 400]))) for i in range(40)]
    rows += [(100 + i, "".join(r.choice(odd) + r.choice(["", " "]) for _ in range(30))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " "), (203, "a▁b"), (204, "<unk>"), (None, "the end"), (1, "the end"), (1, "the end"),
             (205, prose(9, 20_000)), (206, "x" * 70_000), (207, " " * 3000 + "y"), (208, "y ")]
    got = A.alignment_table(make_docs(rows), *PATHS).collect()
    assert sorted([tuple(x) for x in got], key=repr) == brute_force(tools, rows)


def test_slices_give_the_ids_of_the_whole(tools, prose):
    m = A.PieceModel(PATHS[1])
    for text in (prose(1, 30_000), "ab  cd   ▁ " * 20_000, "漢字 " * 40_000, " " * 80_000, "a" * 70_000 + " "):
        assert m.ids(text).tolist() == tools[1].encode(text)


def test_lockstep_on_random_ends():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(1, 3000, r.integers(0, 900))) for _ in range(2))
        edge = np.array([0, 700, 1500, 3000])
        x, y = A.lockstep(a, b, edge[:-1], edge[1:])
        assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()


def test_pairs_are_bounded_by_the_vocabularies():
    al = A.Aligner(byte_bpe.ByteBPE(PATHS[0], plain=True), A.PieceModel(PATHS[1]))
    assert len(al.codes) < sum(al.a.length) + sum(al.b.length)


def test_tokens_and_links_are_given(tools, make_docs, prose):
    row = A.align(make_docs([(1, prose(2, 50))]), *PATHS, with_tokens=True).first()
    a, b, i, j = (np.frombuffer(row[c], "<u4") for c in ("a_ids", "b_ids", "link_a", "link_b"))
    assert (len(a), len(b), len(i), len(j)) == (row.n_a, row.n_b, row.n_links, row.n_links)
    of_a, of_b = token_bytes(tools)
    ends = [np.cumsum([len(f(int(k))) for k in ids]) for f, ids in ((of_a, a), (of_b, b))]
    assert (ends[0][i] == ends[1][j]).all()


def test_empty_table(make_docs):
    assert A.alignment_table(make_docs([(1, "x")]).filter("false"), *PATHS).collect() == []


def test_query(spark, sf001, tools):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()
    got = sorted([tuple(x) for x in op13_token_alignment(spark, sf001).collect()], key=repr)
    assert got == brute_force(tools, [tuple(d) for d in docs])
