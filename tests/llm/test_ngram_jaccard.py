import random
import re
from itertools import combinations

import pytest

from carelens.llm import ngram_jaccard as N
from carelens.llm.components import connected


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def shingle_set(t, k=5):
    w = words(t)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    sets = [shingle_set(r[1]) for r in rows]
    classes = {}
    for (d, *_), s in zip(rows, sets):
        if s:
            classes.setdefault(s, []).append(d)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    keys = list(classes)
    links, root = {s: 0 for s in keys}, {s: s for s in keys}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s
    for a, b in combinations(keys, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    groups = {}
    for s in keys:
        groups.setdefault(find(s), []).extend(classes[s])
    return sorted(((d, low(classes[s]), low(groups[find(s)]), len(classes[s]), links[s]) if s else (d, d, d, 1, 0)
                   for (d, *_), s in zip(rows, sets)), key=str)


def near(text, edits, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(w)


def cases(prose):
    rows = [(i, prose(i, 120)) for i in range(40)]
    rows += [(100 + i, near(rows[i % 8][1], i % 4, i)) for i in range(60)]
    rows += [(200, rows[3][1].upper()), (201, "  " + rows[3][1].replace(" ", "\t")), (202, None), (203, ""), (204, " \n"),
             (205, "one two"), (206, "One  two"), (207, "one two three"), (208, "a b c d e"), (None, rows[3][1]), (5, rows[5][1]),
             (209, "w " * 30_000)]
    return rows


def test_equals_brute_force(make_docs, prose):
    rows = cases(prose)
    got = sorted((tuple(r) for r in N.near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_large_group_is_cut_into_blocks(make_docs, prose):
    base = prose(7, 150)
    rows = [(i, near(base, 1 + i % 3, i)) for i in range(90)] + [(500 + i, prose(900 + i, 60)) for i in range(10)]
    whole = sorted((tuple(r) for r in N.near_duplicates(make_docs(rows)).collect()), key=str)
    cut = sorted((tuple(r) for r in N.near_duplicates(make_docs(rows), block=16).collect()), key=str)
    want = brute(rows)
    assert cut == whole
    assert [r[:4] for r in whole] == [r[:4] for r in want]
    assert sum(r[4] for r in whole) >= 0.99 * sum(r[4] for r in want)


def test_prefix_is_shortened_until_the_recall_is_reached(make_docs, prose):
    rows = [(i, near(prose(i // 2, 200), 3 * (i % 2), i)) for i in range(120)]
    want = sum(r[4] for r in brute(rows))
    got = sum(r["n_links"] for r in N.near_duplicates(make_docs(rows), trees=6, depth=10, target_recall=0.95).collect())
    assert got >= 0.9 * want > 0


def test_one_per_group(make_docs, prose):
    rows = cases(prose)
    docs = make_docs(rows)
    kept = N.one_per_group(docs)
    assert kept.columns == docs.columns
    want = {(r[0], r[2]) for r in brute(rows)}
    stay = {d for d, g in want if d == g and d is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(stay)


def test_empty_table(make_docs):
    assert N.near_duplicates(make_docs([])).collect() == []
    assert N.one_per_group(make_docs([])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(root)}
    got = {x["node"]: x["label"] for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
