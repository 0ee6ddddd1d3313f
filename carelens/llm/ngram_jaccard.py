"""Near duplicates: Jaccard join on word shingles with a MinHash LSH forest (operator 8).

1. Every whole text becomes its set of five-word shingles. Texts with equal
   sets are one *class* (exact copies); a class is represented once.
2. Each class has ``trees`` labels of ``depth`` MinHash values: one prefix trie
   per tree. Two classes are candidates if, in some tree, they share a prefix
   of length k. k starts at ``depth`` and is shortened by one until the recall
   estimated from the verified links reaches ``target_recall``: a link of
   similarity s is found with probability p(s) = 1 - (1 - s^k)^trees, so the
   links found stand for sum(1 / p(s)) links.
3. Trie nodes with several classes are chained to their least member; the
   connected classes form candidate groups, cut into blocks of bounded size.
   Every two blocks that share a trie node meet in one task, where each
   candidate pair is verified once on the exact sets. A task returns link
   counts and a spanning forest of its links, never the pairs themselves.

Result: one row per input row with its class, its links to other classes and
its near-duplicate group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import connected
from .bitmap import id_bitmap, marked_rows
from .tables import remove, store

TREES, DEPTH = 32, 7
BLOCK = 128
EMPTY = b""


def _unique_sets(g: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    cut = np.searchsorted(row, np.arange(n + 1))
    return [np.unique(g[cut[i]:cut[i + 1]]) for i in range(n)]


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else EMPTY


def _signer(trees: int, depth: int, k_words: int, id_type: pa.DataType):
    odd = T.random_u64("minhash", trees * depth) | T.U64(1)

    @T.giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.held_by("near duplicates")
        for batch in batches:
            off, raw = T.buffers(batch.column("text"))
            for a, b, o, r in T.chunks(off, raw):
                start, end, row = T.words(o, r)
                g, rows = T.shingles(T.span_hashes(r, start, end), row, b - a, k_words)
                keys = [_set_key(s) for s in _unique_sets(g, rows, b - a)]
                sig = np.zeros((trees * depth, b - a), dtype=np.uint32)
                if len(g):
                    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                    for j, m in enumerate(odd):
                        sig[j, rows[first]] = np.minimum.reduceat(g * m, first) >> T.U64(32)
                body = np.ascontiguousarray(sig.T)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).cast(id_type), pa.array(keys, pa.binary()),
                     pa.array([x.tobytes() if k else b"" for x, k in zip(body, keys)], pa.binary())],
                    ["doc_id", "key", "sig"])
    return run


def _prefixes(sig: bytes, trees: int, depth: int, k: int) -> np.ndarray:
    """The 64-bit trie node of depth ``k`` in each tree."""
    v = np.frombuffer(sig, dtype=np.uint32).reshape(-1, trees, depth)[:, :, :k].astype(T.U64)
    out = np.broadcast_to(T.random_u64("tree", trees), v.shape[:2]).copy()
    for j in range(k):
        out = T.mix(out + v[:, :, j] * T.U64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _noder(trees: int, depth: int, k: int):
    @T.giving_back
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                nodes = _prefixes(b"".join(part.column("sig").to_pylist()), trees, depth, k)
                keys = np.repeat(np.arange(part.num_rows), trees)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes.ravel()), part.column("key").take(pa.array(keys))], ["node", "key"])
    return run


def _verifier(trees: int, depth: int, k: int, k_words: int, threshold: float):
    """Counts and spanning links of one pair of blocks (or of one block with itself)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        n, side = len(pdf), pdf["blk"].to_numpy()
        keys = pdf["key"].tolist()
        nodes = _prefixes(b"".join(pdf["sig"]), trees, depth, k)
        off, raw = T.buffers(pa.array(pdf["text"], pa.large_string()))
        sets: list[np.ndarray] = []
        for a, b, o, r in T.chunks(off, raw):
            start, end, row = T.words(o, r)
            g, rows = T.shingles(T.span_hashes(r, start, end), row, b - a, k_words)
            sets += _unique_sets(g, rows, b - a)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        one = key[1] == key[2]
        # the shared part of all sets, by ids of the shingles found more than once
        flat = np.concatenate(sets) if n else np.zeros(0, dtype=T.U64)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate(([True], flat[1:] != flat[:-1]))
        run_id = np.cumsum(new) - 1
        many = np.bincount(run_id)[run_id] > 1
        owner, run_id = owner[many], run_id[many]
        by = np.argsort(owner, kind="stable")
        owner, run_id = owner[by], run_id[by]
        cut = np.searchsorted(owner, np.arange(n + 1))
        links, weight = np.zeros(n, dtype=np.int64), 0.0
        root = list(range(n))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        spanning = []
        seen = np.zeros(int(run_id.max()) + 1 if len(run_id) else 1, dtype=bool)
        for i in range(n):
            near = np.flatnonzero((nodes[i + 1:] == nodes[i]).any(axis=1)) + i + 1
            if not one:
                near = near[side[near] != side[i]]
            if not len(near):
                continue
            mine = run_id[cut[i]:cut[i + 1]]
            seen[mine] = True
            for j in near:
                both = int(seen[run_id[cut[j]:cut[j + 1]]].sum())
                whole = int(size[i] + size[j] - both)
                if both and both >= threshold * whole - 1e-9:
                    s = both / whole
                    weight += 1.0 / (1.0 - (1.0 - s ** k) ** trees)
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(int(j))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        spanning.append((keys[i], keys[int(j)]))
            seen[mine] = False
        has = np.flatnonzero(links)
        out = [(keys[i], None, int(links[i]), 0.0) for i in has]
        out += [(a, b, 0, 0.0) for a, b in spanning]
        if weight:
            out.append((None, None, 0, weight))
        return pd.DataFrame(out, columns=["a", "b", "links", "weight"])
    return run


def _candidate_blocks(classes: DataFrame, trees: int, depth: int, k: int, block: int, drop: list[str]):
    """(members, meetings): every candidate class with its block, and the blocks
    that share a trie node of depth k."""
    nodes, p = store(classes.select("key", "sig").mapInArrow(
        _noder(trees, depth, k), "node long, key binary").join(
        classes.select("key", "sig").mapInArrow(_noder(trees, depth, k), "node long, key binary")
        .groupBy("node").agg(F.count("*").alias("n"), F.min("key").alias("least")).filter("n > 1")
        .select("node", "least"), "node"), "trie_nodes")
    drop.append(p)
    groups, p = store(connected(nodes.select(F.col("key").alias("a"), F.col("least").alias("b"))), "groups")
    drop.append(p)
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"))
    members, p = store(groups.join(sizes, "label").select(
        F.col("node").alias("key"), "label", F.col("n").alias("group_size"),
        F.when(F.col("n") <= block, F.lit(0)).otherwise(
            F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))).cast("int").alias("blk")), "blocks")
    drop.append(p)
    own = members.select("label", F.col("blk").alias("x"), F.col("blk").alias("y")).distinct()
    parts = nodes.join(members.filter(F.col("group_size") > block).select("key", "label", "blk"), "key")
    met = parts.groupBy("node", "label").agg(F.array_sort(F.collect_set("blk")).alias("blks")).filter("size(blks) > 1")
    cross = met.select("label", F.explode("blks").alias("x"), "blks").select(
        "label", "x", F.explode("blks").alias("y")).filter("x < y").distinct()
    return members, own.union(cross)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k_words: int = 5, trees: int = TREES,
                    depth: int = DEPTH, target_recall: float = 0.99, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``.

    Columns: ``doc_id``; ``class_id`` (least doc_id with the same shingle set);
    ``group_id`` (least doc_id of all classes connected by links of Jaccard
    similarity >= ``threshold``); ``n_copies`` (rows of the class); ``n_links``
    (other classes linked to this class).

    Words are ASCII-white-space separated with A-Z lower-cased. A text of 1 to
    4 words is one shingle. Null, empty and blank texts share no shingle: each
    row is its own class and group, n_copies 1, n_links 0. Repeated rows are
    copies of each other. A null doc_id keeps its row; a class with only null
    ids has null class_id. Other columns of ``docs`` are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    drop: list[str] = []
    id_type = docs.schema["doc_id"].dataType
    arrow_id = pa.int64() if id_type.simpleString() == "bigint" else pa.int32() if id_type.simpleString() == "int" else pa.string()
    signed, p = store(docs.select("doc_id", "text").mapInArrow(
        _signer(trees, depth, k_words, arrow_id), f"doc_id {id_type.simpleString()}, key binary, sig binary"), "signatures")
    drop.append(p)
    full = signed.filter(F.length("key") > 0)
    counts = full.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    classes, p = store(full.groupBy("key").agg(F.first("sig").alias("sig")), "classes")
    drop.append(p)

    # what verification reads: the text of one copy of each candidate class
    verified = None
    for k in range(depth, 0, -1):
        tmp: list[str] = []
        members, meetings = _candidate_blocks(classes, trees, depth, k, block, tmp)
        ids = members.select("key").join(counts.select("key", "class_id"), "key")
        one = full.join(ids, (full["key"] == ids["key"]) & full["doc_id"].eqNullSafe(ids["class_id"])).select(full["key"], full["doc_id"])
        one, p = store(one.distinct(), "candidates")
        tmp.append(p)
        some = marked_rows(docs.select("doc_id", "text"), id_bitmap(one, "doc_id"), "doc_id")
        texts = some.join(one, some["doc_id"].eqNullSafe(one["doc_id"])).select("key", "text")
        # doc_id may repeat with other texts: keep the text whose set is the key
        texts = texts.mapInArrow(_keep_own(k_words), "key binary, text string").dropDuplicates(["key"])
        bodies = members.join(texts, "key").join(classes, "key")
        met = meetings.select("label", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("blk"))
        out, p = store(bodies.join(met, ["label", "blk"]).groupBy("label", "x", "y").applyInPandas(
            _verifier(trees, depth, k, k_words, threshold), "a binary, b binary, links long, weight double"), "links")
        found = out.agg(F.sum("links"), F.sum("weight")).first()
        verified = out
        remove(spark, *tmp)
        recall = 1.0 if not found[1] else (found[0] / 2) / found[1]
        floor = 1 - (1 - threshold ** k) ** trees
        if (recall >= target_recall and floor >= 0.9) or k == 1:
            break
        remove(spark, p)

    links = verified.filter("b is null and a is not null").groupBy("a").agg(F.sum("links").alias("n_links"))
    groups = connected(verified.filter("b is not null").select("a", "b"), "near_groups")
    classed = counts.join(groups, counts["key"] == groups["node"], "left").select(
        counts["key"], "class_id", "n_copies", F.coalesce("label", "key").alias("label"))
    least = classed.groupBy("label").agg(F.min("class_id").alias("group_id"))
    labelled = classed.join(least, "label").join(links, F.col("key") == links["a"], "left").select(
        F.col("key").alias("class_key"), "class_id", "group_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = full.join(labelled, full["key"] == labelled["class_key"]).select(
        "doc_id", "class_id", "group_id", "n_copies", "n_links")
    alone = signed.filter(F.length("key") == 0).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return rows.union(alone)


def _keep_own(k_words: int):
    @T.giving_back
    def run(batches):
        for batch in batches:
            off, raw = T.buffers(batch.column("text"))
            for a, b, o, r in T.chunks(off, raw):
                start, end, row = T.words(o, r)
                g, rows = T.shingles(T.span_hashes(r, start, end), row, b - a, k_words)
                part = batch.slice(a, b - a)
                keep = [_set_key(s) == k for s, k in zip(_unique_sets(g, rows, b - a), part.column("key").to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_())).select(["key", "text"])
    return run


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group the row with
    the least doc_id (of rows that repeat that id and text, one); texts without
    a word and rows without a doc_id all stay. All columns are kept."""
    near = near_duplicates(docs, **options)
    lone = F.col("doc_id").eqNullSafe(F.col("group_id"))
    stay = near.filter(lone).select(F.col("doc_id").alias("_stays")).distinct()
    words = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)) & F.col("doc_id").isNotNull()
    kept = docs.filter(words).join(stay, docs["doc_id"] == stay["_stays"], "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).union(docs.filter(~words))
