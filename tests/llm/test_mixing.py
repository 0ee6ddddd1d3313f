import numpy as np
from pyspark.sql import functions as F

from carelens.llm import entry, mixing


def test_rates_reach_the_targets(spark, sf001):
    d = "/root/testdata/sf0.01"
    rates, fit, model = mixing.document_rates(entry.table(spark, d, "documents"), entry.domain_labels(entry.table(spark, d, "labels")),
                                              entry.DOMAIN_TARGETS)
    assert model.names == ["good", "good_toxic", "poor", "poor_toxic"]
    total = rates.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{n}")).alias(n) for n in model.names],
                      F.sum("n_tokens").alias("all"), F.min("rate").alias("least")).first()
    for n in model.names:
        assert abs(total[n] / total["all"] - entry.DOMAIN_TARGETS[n]) < 0.02
    assert total["least"] >= 0


def test_posteriors_on_rows_outside_the_sample(spark):
    d = "/root/testdata/sf0.01"
    labels = entry.domain_labels(entry.table(spark, d, "labels"))
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    docs = entry.table(spark, d, "documents")
    m = mixing.fit_domains(docs, train)
    p = mixing.posterior_table(docs, m).join(test, "doc_id").toPandas()
    guess = [m.names[int(np.argmax(x))] for x in p["p"]]
    assert np.mean([g == t for g, t in zip(guess, p["domain"])]) > 0.9
    assert all(abs(sum(x) - 1) < 1e-9 for x in p["p"])


def test_equals_plain_projected_gradient(spark):
    r = np.random.default_rng(4)
    n, p = r.integers(1, 500, 60), r.dirichlet([0.3] * 3, 60)
    target = np.array([0.7, 0.3, 0.0])
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    fit = mixing.fit_rates(table, target, rounds=25, tolerance=0)
    s = n / n.sum()
    step = 1 / (np.linalg.eigvalsh((p * s[:, None]).T @ p).max() + fit.ridge)
    rate = np.ones(60)
    for _ in range(25):
        rate = np.maximum(0, rate - step * (p @ ((rate * s) @ p - target) + fit.ridge * (rate - 1)))
    assert np.allclose(fit.rates(p), rate, atol=1e-9)
    # at the constrained optimum the gradient is 0 where the rate is positive, and not negative elsewhere
    long = mixing.fit_rates(table, target, rounds=150, tolerance=0)
    x = long.rates(p)
    g = p @ ((x * s) @ p - target) + long.ridge * (x - 1)
    assert np.abs(g[x > 1e-6]).max() < 2e-3 and g.min() > -2e-3


def test_edges(spark, make_docs, prose):
    rows = [(i, prose(i, 60)) for i in range(40)] + [(50 + i, "$$$ &&& " * 30) for i in range(20)] + [
        (90, None), (91, ""), (None, prose(1, 40)), (3, prose(3, 60)), (92, prose(7, 50_000))]
    labels = spark.createDataFrame([(i, "good" if i < 40 else "poor") for i in [*range(0, 40, 2), *range(50, 70, 2)]] + [(None, "good"), (1, None)],
                                   "doc_id long, domain string")
    got, fit, m = mixing.document_rates(make_docs(rows), labels, {"good": 0.9, "poor": 0.1, "unseen": 0.5})
    got = got.collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (90, 91)} == {0}
    same = [r["rate"] for r in got if r["doc_id"] == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert [c for c in mixing.document_rates(make_docs(rows), labels.limit(0), {})[0].collect() if c["rate"] != 1.0] == []
    assert mixing.document_rates(make_docs([]), labels, {"good": 1.0})[0].collect() == []


def test_emitted_copies_follow_the_rates(spark, make_docs, prose):
    rows = [(i, prose(i, 60)) for i in range(300)] + [(500 + i, "$$$ &&& " * (20 + i)) for i in range(100)] + [(None, None)]
    labels = spark.createDataFrame([(r[0], "good" if i < 300 else "poor") for i, r in enumerate(rows[:-1])], "doc_id long, domain string")
    docs = make_docs(rows)
    rates, fit, m = mixing.document_rates(docs, labels, {"good": 0.97, "poor": 0.03})
    out = mixing.emit(docs, m, fit)
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in rates.collect():
        assert int(r["rate"]) <= n.get(r["doc_id"], 0) <= int(r["rate"]) + 1
    poor = [n.get(500 + i, 0) for i in range(100)]
    want = sum(r["rate"] for r in rates.collect() if r["doc_id"] is not None and r["doc_id"] >= 500)
    assert abs(sum(poor) - want) < 25
    assert all(n.get(i, 0) >= 1 for i in range(300))


def test_converges(spark):
    """Each domain is within 5 % of the converged optimum, found by very many plain steps."""
    r = np.random.default_rng(8)
    n, p = r.integers(1, 900, 400), r.dirichlet([0.8, 0.1, 0.3, 0.1], 400)
    target = np.array([0.95, 0.03, 0.02, 0.0])
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    fit = mixing.fit_rates(table, target, plain=0)
    s = n / n.sum()
    rate = np.ones(len(n))
    for _ in range(30_000):
        rate = np.maximum(0, rate - fit.step * (p @ ((rate * s) @ p - target) + fit.ridge * (rate - 1)))
    best, got = (rate * s) @ p, (fit.rates(p) * s) @ p
    assert np.allclose(fit.achieved, got)
    assert (np.abs(got - best) <= 0.05 * best).all() and len(fit.history) < 120


def test_a_column_of_any_name_is_kept(spark, make_docs, prose):
    rows = [(i, prose(i, 60)) for i in range(40)]
    labels = spark.createDataFrame([(i, "good") for i in range(40)], "doc_id long, domain string")
    docs = make_docs(rows).withColumn("_u", F.lit("mine"))
    model = mixing.fit_domains(docs, labels)
    fit = mixing.fit_rates(mixing.posterior_table(docs, model), [1.0])
    out = mixing.emit(docs, model, fit)
    assert out.columns == docs.columns and {r["_u"] for r in out.collect()} == {"mine"}
