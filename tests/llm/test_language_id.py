import numpy as np
from pyspark.sql import functions as F

from carelens.llm import entry
from carelens.llm import language_id as L


def test_held_out_accuracy(spark, sf001):
    got = entry.op1_language_id(spark, sf001)
    truth = entry.table(spark, sf001, "documents").select("doc_id", "lang")
    r = got.join(truth, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred != 'und'").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.avg(F.col("rejected").cast("double"))).first()
    assert r[0] >= 0.97 and r[1] > 30 and r[2] <= 0.02


def test_prediction_equals_plain_cosine(spark, sf001):
    docs = entry.table(spark, sf001, "documents").limit(80)
    m = L.fit(docs)
    rows = {r["doc_id"]: r for r in L.classify(docs, m).collect()}
    for r in docs.collect():
        v = np.zeros(L.DIM)
        t = f" {L.normalise(r['text'] or '')} "
        for i in range(len(t) - 2):
            h, ok = L._trigrams(t[i:i + 3])
            v[h[ok]] += 1
        v = np.log1p(v) * m.idf
        cos = m.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        got = rows[r["doc_id"]]
        if got["lang_pred"] != L.UNKNOWN:
            assert abs(got["score"] - min(1, max(0, cos.max()))) < 1e-4
            assert cos[[m.langs[o] == got["lang_pred"] for o in m.owner]].max() >= cos.max() - 1e-5


def test_edges(spark, make_docs, prose):
    rows = [(i, prose(i, 80 + 20 * i), "aa") for i in range(9)] + [(9, "éàü çñ " * 30, "bb"), (10, None, "aa"), (11, "", "bb"), (12, "123 !? \n", None),
            (13, "x", None), (13, "x", None), (None, prose(2, 30), None), (14, "пример текста на другом языке " * 20, None), (15, "²³", None),
            (16, prose(3, 60_000), None)]
    docs = make_docs(rows)
    out = L.classify(docs, L.fit(docs))
    assert out.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score", "rejected"]
    got = {(r["doc_id"], r["lang_pred"]): r for r in out.collect()}
    assert {d for d, p in got if p == "und"} == {10, 11, 12, 15}
    assert all(got[d, "und"]["rejected"] and got[d, "und"]["score"] == 0 for d in (10, 11, 12, 15))
    assert got[14, [p for d, p in got if d == 14][0]]["rejected"]
    assert not got[0, "aa"]["rejected"] and (16, "aa") in got and got[9, "bb"]["score"] > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values()) and out.count() == len(rows)


def test_nothing_learned(make_docs, prose):
    m = L.fit(make_docs([]))
    assert L.classify(make_docs([]), m).collect() == []
    assert [r["lang_pred"] for r in L.classify(make_docs([(1, prose(1, 20))]), m).collect()] == ["und"]


def test_length_alone_rejects_nothing(spark):
    """Learned from varied texts the radius is tight: joined documents of one language stay however long, another script goes."""
    words = F.split("text", r"\s+")
    docs = entry.table(spark, "/root/testdata/sf0.1", "documents").filter("lang IN ('en', 'de') AND length(text) > 2000").filter(
        F.size(F.array_distinct(words)) > 0.3 * F.size(words)).select("doc_id", "text", "lang").cache()
    m = L.fit(docs)
    assert m.radius[-1] < 0.4
    for lang in ("en", "de"):
        body = "\n".join(r["text"] for r in docs.filter(F.col("lang") == lang).orderBy("doc_id").collect())
        number, _, rejected = m.predict([body[:n] for n in (5_000, 20_000, 100_000, 300_000, 1_000_000)])
        assert [m.langs[k] for k in number] == [lang] * 5 and not rejected.any()
    assert m.predict(["пример текста на другом языке " * 20_000])[2].all()
    docs.unpersist()
