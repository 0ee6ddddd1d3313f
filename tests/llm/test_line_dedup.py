import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from carelens.llm import entry
from carelens.llm import line_dedup as L


def key(line):
    s = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute(rows, min_docs):
    docs = defaultdict(set)
    for i, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            if key(line):
                docs[key(line)].add(i)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or len(docs[key(x)]) < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rows = [(i, f"Common Line\n unique {i}\n\n{'twice' if i < 3 else 'thrice'}") for i in range(12)]
    rows += [(20, "  common line\t\nÄpfel\näpfel\n"), (21, None), (22, ""), (23, "\n\n"), (24, " \r\n\x0b"), (25, "COMMON LINE"),
             (26, "common line\nx" * 50), (None, "common line\nz"), (25, "COMMON LINE"), (28, "a" * 100_000 + "\ncommon line")]
    return rows


@pytest.mark.parametrize("min_docs", [3, 10])
def test_equals_brute_force(make_docs, min_docs):
    rows = cases()
    got = L.drop_frequent_lines(make_docs(rows), min_docs=min_docs, batches=3).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, min_docs)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_oracle(spark, sf001):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf001}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op6_line_dedup"]).df()
    got = entry.op6_line_dedup(spark, sf001).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
    assert (want["n_dropped"] > 0).any()


def test_every_batch_of_the_query_is_joined_with_the_runs(spark, sf001, monkeypatch):
    joined, merged, stores = [], [], []
    marked, put = L.LineRuns.marked, L.LineRuns._put

    def seen_marked(self, keys):
        stores.append(self)
        out = marked(self, keys)
        joined.append((len(self.runs()), *out.agg({"first": "count"}).first(), out.filter("first").count()))
        return out

    def seen_put(self, level, path):
        merged.append(level)
        put(self, level, path)

    monkeypatch.setattr(L.LineRuns, "marked", seen_marked)
    monkeypatch.setattr(L.LineRuns, "_put", seen_put)
    entry.op6_line_dedup(spark, sf001)
    assert [n for n, _, _ in joined] == [0, 1, 1, 2]      # runs there were for each batch
    assert merged == [0, 0, 1, 0, 0, 1, 2]                # levels met by runs: three compactions
    assert joined[0][1] == joined[0][2] and all(new < n for _, n, new in joined[1:])
    runs = stores[-1]._read(stores[-1].runs())
    # a key enters once, whichever batches have it
    assert runs.filter("first").count() == runs.select(*L.KEY).distinct().count() == sum(new for _, _, new in joined)


def test_empty_table(make_docs):
    assert L.drop_frequent_lines(make_docs([])).collect() == []


def test_runs_compact_and_answer_like_one_table(spark):
    runs = L.LineRuns(spark, fanout=2)
    total = defaultdict(int)
    for b in range(7):
        rows = [(k, k * 7, 1 + b) for k in range(b, b + 5)]
        for k, h2, n in rows:
            total[(k, h2)] += n
        batch = spark.createDataFrame(rows, "h1 long, h2 long, n long")
        new = {r["h1"] for r in runs.unseen(batch).collect()}
        assert new == ({b + 4} if b else set(range(5)))
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    assert {(r["h1"], r["h2"]): r["n"] for r in runs.counts().collect()} == dict(total)
