"""Operator 12 against a plain count of all phrases; the trie against a dictionary."""

import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from carelens.llm import collocations as C
from carelens.llm import text as T
from carelens.llm.entry import op12_phrase_collocations


def brute_force(rows, least=100, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= c[p[i:i + k]]}
        found = []
        for p, a in cand.items():
            if p not in dropped:
                score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shape", [(1, 2, 1), (50, 3, 5), (4000, 4, 60), (20_000, 2, 3000), (3000, 6, 9)])
def test_trie_equals_a_dictionary(shape):
    m, depth, v = shape
    r = np.random.default_rng(m)
    words = r.integers(-2**62, 2**62, v)
    rows = np.unique(words[r.integers(0, v, (m, depth))], axis=0)
    r.shuffle(rows)
    t = C.build(rows)
    inside = {tuple(x): i for i, x in enumerate(rows.tolist())}
    probe = np.concatenate((rows, words[r.integers(0, v, (3000, depth))], r.integers(-2**62, 2**62, (200, depth))))
    state, ok = np.zeros(len(probe), np.int64), np.ones(len(probe), bool)
    for d in range(depth):
        to, there = t.step(state, t.number(probe[:, d]))
        ok &= there
        state = np.where(ok, to, 0)
    assert [int(t.leaf[s]) if o else None for s, o in zip(state, ok)] == [inside.get(tuple(x)) for x in probe.tolist()]


@pytest.mark.parametrize("shape", ["few wide states", "many states of all sizes"])
def test_time_to_build_grows_with_the_phrases(shape):
    """Many words of few languages, and pairs of words most of which are rare: states were placed one
    by one, each against all before it (86 thousand words took 22 s)."""
    r = np.random.default_rng(1)
    if shape == "few wide states":
        rows = np.stack([r.choice(4, 200_000, p=[0.6, 0.16, 0.12, 0.12]), r.integers(-2**62, 2**62, 180_000)[r.integers(0, 180_000, 200_000)]], axis=1)
    else:
        rows = np.minimum(20_000, r.pareto(0.5, (800_000, 2)) * 3 + 1).astype(np.int64)
    rows = np.unique(rows, axis=0)
    began = time.process_time()
    t = C.build(rows)
    assert time.process_time() - began < 10
    assert len(t.base) < 12 * len(rows)
    state = np.zeros(len(rows), np.int64)
    for d in range(2):
        state, ok = t.step(state, t.number(rows[:, d]))
        assert ok.all()
    assert t.leaf[state].tolist() == list(range(len(rows)))


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_a_place_is_looked_up_in_one_trie(monkeypatch, parts):
    """Shards by the first two words together find what one trie of all phrases finds, each place once."""
    monkeypatch.setattr(C, "GATHER_BYTES", 256)
    monkeypatch.setattr(C, "STRETCH_BYTES", 1024)
    r = np.random.default_rng(parts)
    body = [np.append(r.integers(1, 9, n), 0) for n in r.integers(2, 40, 300)]
    batch = pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes() for x in body])], ["s"])
    places = Counter(tuple(x[i:i + 3].tolist()) for x in body for i in range(len(x) - 3))
    known = np.array(sorted(places)[::3])
    of = (known[:, 0] * C.SPREAD + known[:, 1]) % parts
    rows = [known[of == i] if (of == i).any() else None for i in range(parts)]
    shared = lambda values: [None if v is None else SimpleNamespace(value=v, _value=v) for v in values]
    seen = []
    reach = C.reach
    monkeypatch.setattr(C, "reach", lambda trie, s, depth, at=None: (seen.append(np.flatnonzero(s) if at is None else at), reach(trie, s, depth, at))[1])
    monkeypatch.setattr(C, "_held", lambda shared, alone: shared.value)
    got = Counter()
    for b in C._count(shared([None if x is None else C.build(x) for x in rows]), shared(rows), 3)([batch]):
        for *words, n in zip(*[c.to_pylist() for c in b.columns]):
            got[tuple(words)] += n
    assert got == Counter({tuple(x): places[tuple(x)] for x in known.tolist()})
    assert sum(map(len, seen)) <= sum(map(len, body))
    good = {(x[0], x[1], x[2]) for x in known.tolist()}
    want = Counter(tuple(x[i:i + 4].tolist()) for x in body for i in range(len(x) - 4)
                   if tuple(x[i:i + 3].tolist()) in good and tuple(x[i + 1:i + 4].tolist()) in good)
    got = Counter()
    for b in C._gather(shared([None if x is None else C.build(x) for x in rows]), 4)([batch]):
        for *words, n in zip(*[c.to_pylist() for c in b.columns]):
            got[tuple(words)] += n
    assert got == want and len(want) > 10


def corpus(prose):
    r = random.Random(2)
    rows = []
    for i in range(160):
        lang = r.choice(["en", "de", None, "und"])
        words = prose(i, 60).split(" ")
        for extra in (["New York city hall"], ["as well as"], ["über alles tut gut"], ["a b a b a b a"], ["one two three four five six seven"]):
            words.insert(r.randrange(len(words)), extra[0])
        rows.append((i, " ".join(words), lang))
    rows += [(900, None, "en"), (901, "", "en"), (902, " \t\n", "fr"), (1, "one two three", "en"), (1, "one two three", "en"),
             (903, "x" * 5000 + " one two " * 3000, "en"), (904, "tab\tsep as well,as well\x0bas well\x0cas\rwell", "de")]
    return rows


@pytest.mark.parametrize("least,top,shard", [(20, 2000, 1 << 19), (20, 7, 1 << 19), (20, 2000, 16)])
def test_equals_brute_force(make_docs, prose, monkeypatch, least, top, shard):
    """Also with tries of so few phrases that every level has many shards."""
    monkeypatch.setattr(C, "SHARD_PHRASES", shard)
    rows = corpus(prose)
    got = rows_of(C.collocations(make_docs(rows), least, top))
    assert got == brute_force([(x[2], x[1]) for x in rows], least, top)
    assert len(got) > 10


def test_streams_hold_the_runs_of_numbered_words():
    """Runs of two and more numbers inside one piece, each followed by 0."""
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 400):
        symbols, piece = r.integers(0, 4, n), np.sort(r.integers(0, n // 5 + 1, n))
        want, run = [], []
        for i in range(n + 1):
            if run and (i == n or not symbols[i] or piece[i] != piece[i - 1]):
                want += run + [0] if len(run) > 1 else []
                run = []
            if i < n and symbols[i]:
                run.append(int(symbols[i]))
        assert C.stream(symbols, piece).tolist() == want


def test_rows_end_between_runs(prose, monkeypatch):
    """Rows of few numbers and batches of few rows, one after the other, are the whole stream."""
    monkeypatch.setattr(C, "ROW_SYMBOLS", 3)
    monkeypatch.setattr(C, "EMIT_ROWS", 64)
    text = pa.array([prose(i, 60) for i in range(40)] + [None, "", "a b " * 500])
    batch = pa.RecordBatch.from_arrays([text, pa.array(["en"] * len(text)), pa.array([7] * len(text), pa.int64())], ["text", "lang", "lang_hash"])
    p = C.positions(*T.buffers(text))
    known = np.unique(p.hash)[::2]
    trie = C.build(np.stack([np.full(len(known), 7), known], axis=1))
    shared = SimpleNamespace(value=(trie, np.arange(1, len(known) + 1)))
    out = list(C._encode([shared])([batch]))
    got = [np.frombuffer(x, "<i8") for b in out for x in b.column("s").to_pylist()]
    symbols = np.where(np.isin(p.hash, known), np.searchsorted(known, p.hash) + 1, 0)
    assert np.concatenate(got).tolist() == C.stream(symbols, p.piece).tolist()
    assert len(out) > 1 and all(row[-1] == 0 for row in got)


@pytest.mark.parametrize("bound", [1, 40, 1 << 19])
def test_gathered_counts_are_summed_in_the_task(monkeypatch, bound):
    """Whatever is held before rows leave, their sums are the counts of all places; with room for all, a phrase leaves once."""
    monkeypatch.setattr(C, "SUM_ROWS", bound)
    monkeypatch.setattr(C, "GATHER_BYTES", 64)
    r = np.random.default_rng(3)
    rows = [np.append(r.integers(1, 6, n), 0) for n in r.integers(2, 9, 300)]
    batch = pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes() for x in rows])], ["s"])
    trie = SimpleNamespace(value=C.build(np.array([(a, b) for a in range(1, 6) for b in range(1, 6)])))
    got, times = Counter(), Counter()
    for b in C._gather([trie], 3)([batch, batch.slice(0, 0)]):
        for *words, n in zip(*[c.to_pylist() for c in b.columns]):
            got[tuple(words)] += n
            times[tuple(words)] += 1
    assert got == Counter(tuple(x[i:i + 3].tolist()) for x in rows for i in range(len(x) - 3))
    assert max(times.values()) == 1 or bound < 1000


@pytest.mark.parametrize("k,top,bits", [(2, 9, 4), (3, 1 << 20, 21), (5, 4000, 12), (5, 4000, 13), (2, 1 << 31, 32), (3, 9, None)])
def test_rows_are_summed_by_their_numbers(k, top, bits):
    """As one number where the row fits, else by a hash; equal keys are equal rows."""
    r = np.random.default_rng(k)
    rows = r.integers(1, top, (40, k))[r.integers(0, 40, 500)]
    key, cols, n = C._tally([rows[:, d].copy() for d in range(k)], bits)
    assert dict(zip(zip(*[c.tolist() for c in cols]), n.tolist())) == Counter(map(tuple, rows.tolist()))
    assert (key[1:] > key[:-1]).all() and (key.dtype == np.int64) == (bits is not None and k * bits < 64)


def test_exact_beyond_64_bits(spark):
    """a * n and l * r are multiplied as decimals."""
    row = spark.sql("SELECT cast(900000000000 AS decimal(18,0)) a, cast(99999999999999 AS decimal(18,0)) n, "
                    "cast(3000000000000 AS decimal(18,0)) l, cast(7000000000000 AS decimal(18,0)) r")
    score = row.selectExpr("((a * n) * cast(1000 AS decimal(4,0))) div (l * r)").first()[0]
    assert score == 1000 * 900000000000 * 99999999999999 // (3000000000000 * 7000000000000)


def test_empty_tables(make_docs):
    none = make_docs([(1, "x", "en")]).filter("false")
    assert C.collocations(none).collect() == []
    assert C.collocations(make_docs([(1, "a b", "en"), (2, None, None)])).collect() == []


def test_query(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("lang", "text").collect()
    assert rows_of(op12_phrase_collocations(spark, sf001)) == brute_force([tuple(d) for d in docs])
