import numpy as np
import pyarrow as pa

from carelens.llm import bitmap, language_id, ngram_jaccard, suffix_dedup
from carelens.llm import text as T
from carelens.llm.tables import BATCH_BYTES, BATCH_LIMIT, ship


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    docs = spark.range(2000, numPartitions=1).selectExpr("id", "repeat(cast(id % 10 AS string), 10000) AS text")
    got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 2000
    assert max(r["bytes"] for r in got) < BATCH_BYTES + 20_000


def test_a_bound_of_the_session_stays(spark):
    before = spark.conf.get(BATCH_LIMIT)
    try:
        spark.conf.set(BATCH_LIMIT, "12345678")
        ship(spark)
        assert spark.conf.get(BATCH_LIMIT) == "12345678"
    finally:
        spark.conf.set(BATCH_LIMIT, before)


def test_power_tables_follow_the_longest_chunk():
    T.drop_powers()
    short = T.powers(1000)
    assert len(short[0]) <= 1 << 18
    up, down = T.powers((1 << 18) + 1)
    assert len(up) == len(down) == 1 << 19
    assert np.array_equal(up[:1 << 18], short[0]) and np.array_equal(down[:1 << 18], short[1])
    assert (up * down == 1).all() and (up[1:2] * up[2:3] == up[3:4]).all()
    assert T.powers(10)[0] is up  # the longer pair serves the shorter chunks


def test_a_task_gives_its_tables_back():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "doc": [1], "tag": [0], "text": ["some words of a text " * 40]})
    for run in (ngram_jaccard._signer(2, 2, 5, pa.int64()), suffix_dedup._entries):
        assert list(run([batch]))
        assert not T._tables


def test_a_task_that_is_stopped_gives_back_too():
    seen = []
    run = T.giving_back(lambda batches: (seen.append(T.powers(5)) or b for b in batches))
    it = run(iter([1, 2]))
    assert next(it) == 1 and T._tables
    it.close()
    assert not T._tables


def test_another_operators_tables_are_dropped():
    T.held_by("token output")["path"] = object()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"], "lang": ["en"], "picked": [True]})
    list(ngram_jaccard._signer(2, 2, 5, pa.int64())([batch]))
    assert not T.held_by("token output")
    T.held_by("token output")["path"] = object()
    list(language_id._gather([batch]))
    assert not T.held_by("token output")


def test_marked_rows_in_small_batches(spark):
    rows = spark.range(500).selectExpr("id", "repeat('x', 20000) AS text")
    got = bitmap.marked_rows(rows, bitmap.id_bitmap(spark.range(0, 500, 50), "id"), "id")
    assert {r["id"] for r in got.select("id").collect()} >= set(range(0, 500, 50))
