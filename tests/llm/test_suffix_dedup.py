import hashlib

import pytest

from carelens.llm import suffix_dedup as S


def brute(rows):
    """Result per row by every MATCH-byte string."""
    seen, out = {}, []
    order = sorted({(r[0] if r[0] is not None else S.NO_ID, (r[1] or "")) for r in rows}, key=lambda x: x[0])
    for d, t in order:
        b = t.encode()
        for p in range(len(b) - S.MATCH + 1):
            seen.setdefault(b[p:p + S.MATCH], (d, p))
    for r in rows:
        b, d = (r[1] or "").encode(), r[0] if r[0] is not None else S.NO_ID
        gone = [False] * len(b)
        for p in range(len(b) - S.MATCH + 1):
            if seen[b[p:p + S.MATCH]] != (d, p):
                gone[p:p + S.MATCH] = [True] * S.MATCH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(prose):
    a, b, c = prose(1, 120), prose(2, 150), prose(3, 90)
    rows = [(1, a), (2, b), (3, a[:200] + b[100:420] + c), (4, "x" + a[7:]), (5, None), (6, ""), (7, "short"),
            (8, "aé" * 300), (9, "ab" * 40 + c + "ab" * 130), (10, c), (11, c), (12, a + "tail"), (13, a[:-3] + "tail"),
            (14, b[50:150]), (15, b[50:149]), (16, "Z" + b[50:151]), (17, "q" * 99), (18, "q" * 101), (None, a), (20, b + b)]
    return rows + [(30 + i, c[i:i + 130] + prose(50 + i, 30)) for i in range(25)]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_equals_brute_force(make_docs, prose, batches):
    rows = cases(prose)
    got = S.remove_repeats(make_docs(rows), batches=batches).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)


def test_repeated_rows_and_kept_bytes(make_docs, prose):
    rows = [(1, prose(1, 100)), (1, prose(1, 100)), (2, prose(1, 100)), (3, "öä" + prose(1, 50))]
    got = S.remove_repeats(make_docs(rows)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_empty(make_docs):
    assert S.remove_repeats(make_docs([])).collect() == []
    assert S.remove_repeats(make_docs([(1, None)])).collect()[0]["n_bytes"] == 0


def test_levels_merge_geometrically(spark, make_docs, prose):
    family = S.SuffixIndexes(spark, fanout=2)
    for i in range(5):
        d = make_docs([(i, prose(i, 60))]).selectExpr("doc_id AS doc", "0L AS tag", "text")
        from carelens.session import scratch_path
        path = scratch_path(spark, "t")
        family.scan(d.mapInArrow(S._entries, "kind int, " + S.ENTRY)).filter(f"kind = {S.ENTRY_KIND}").select(
            "h", "c", "doc", "at").write.parquet(path)
        family.add(path)
    assert [len(x) for x in family.levels] == [1, 0, 1]


def test_levels_merge_in_the_query(spark, make_docs, prose, monkeypatch):
    """As the registered query calls it, a batch is scanned against a run that merged those of earlier batches."""
    scanned = []
    scan = S.SuffixIndexes.scan

    def noted(self, entries):
        scanned.append([len(level) for level in self.levels])
        return scan(self, entries)

    monkeypatch.setattr(S.SuffixIndexes, "scan", noted)
    rows = [(i, prose(i, 60)) for i in range(12)] + [(20, prose(0, 60)), (21, prose(11, 60))]
    got = S.remove_repeats(make_docs(rows), with_text=False).collect()
    assert scanned == [[], [1], [0, 1]]
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
