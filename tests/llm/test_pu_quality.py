import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from carelens.llm import entry, features
from carelens.llm import pu_quality as P
from carelens.llm import text as T


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    got = entry.op3_quality_classifier(spark, d).join(entry.table(spark, d, "labels"), "doc_id").filter("held_out").toPandas()
    assert auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.95
    assert (got["predicted"] == got["quality"]).mean() > 0.93


def test_prior_of_a_known_mixture():
    r = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.85):
        p, n = r.beta(8, 2, 20_000), r.beta(2, 8, 20_000)
        u = np.where(r.random(20_000) < prior, p, n)
        h = lambda x: np.bincount(np.minimum((x * P.BINS).astype(int), P.BINS - 1), minlength=P.BINS)
        assert abs(P.estimate_prior(h(r.beta(8, 2, 20_000)), h(u)) - prior) < 0.06


def test_non_negative_risk_separates_without_negatives():
    r = np.random.default_rng(2)
    xp, u = r.normal(1.5, 1, (2000, 3)), r.random(4000) < 0.6
    xu = np.where(u[:, None], r.normal(1.5, 1, (4000, 3)), r.normal(-1.5, 1, (4000, 3)))
    w = P._nnpu(xp, xu, 0.6)
    assert ((np.c_[xu, np.ones(4000)] @ w > 0) == u).mean() > 0.97


def test_statistics_equal_plain_counts():
    texts = ["The cat\nTHE DOG!! $$$ the the", "", "é à 12 |"]
    x = features.document_stats(*T.buffers(pa.array(texts)))
    names = {n: features.CLASSES + i for i, n in enumerate(features.EXTRA)}
    assert x.shape == (3, features.WIDTH) and not x[1].any()
    assert np.isclose(x[0, names["log_words"]], np.log(8)) and np.isclose(x[0, names["repeats_previous"]], 1 / 7)
    assert np.isclose(x[0, names["distinct_words"]], 4 / 7) and np.isclose(x[0, names["capital_words"]], 2 / 7)
    assert np.isclose(x[0, names["lines_per_word"]], 1 / 7) and np.isclose(x[2, :features.CLASSES].sum(), 1)


def test_edges(spark, make_docs, prose):
    rows = [(i, prose(i, 60)) for i in range(30)] + [(40, None), (41, ""), (42, "$$$ " * 40), (None, prose(1, 9)), (3, prose(3, 60)),
                                                     (43, prose(9, 50_000))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(3, 1, 0), (None, 1, 0), (42, 0, None), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got, model = P.quality_scores(make_docs(rows), labels, F.lit(True))
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and 0 < model.prior < 1
    none, _ = P.quality_scores(make_docs(rows), labels.filter("quality > 1"), F.lit(True))
    assert {r["score"] for r in none.collect()} == {0.5}
    empty, _ = P.quality_scores(make_docs([]), labels, F.lit(True))
    assert empty.collect() == []


def test_labels_of_zero_and_held_out_labels_are_not_read(spark, make_docs, prose):
    docs = make_docs([(i, prose(i, 40 + i)) for i in range(40)])
    learn = F.col("doc_id") < 30
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    a, _ = P.quality_scores(docs, make([(i, 1) for i in range(10)] + [(12, 0), (35, 1)]), learn)
    b, _ = P.quality_scores(docs, make([(i, 1) for i in range(10)]), learn)
    assert {r["doc_id"]: r["score"] for r in a.collect()} == {r["doc_id"]: r["score"] for r in b.collect()}
