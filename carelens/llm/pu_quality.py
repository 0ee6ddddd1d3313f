"""Quality score from trusted positives and unlabelled text (operator 3).

Positive-unlabelled learning: a logistic model on text statistics minimises
the non-negative unbiased risk

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

over trusted positives (p) and unlabelled rows (u). The class prior pi is
estimated, not given: with a first model's scores, the share of unlabelled
rows above a threshold over that of positives bounds pi from above; the least
such ratio over thresholds that enough rows pass (with a margin for its error)
is the estimate. Its score histograms cover all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from . import text as T
from .tables import stored

BINS = 1000


def stats_table(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``x``: the statistics of the whole text (null: empty) as float32 bytes."""
    names = list(keep)

    def run(batches):
        for batch in batches:
            off, raw = T.buffers(batch.column("text"))
            for a, b, o, r in T.chunks(off, raw):
                x = features.document_stats(o, r)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in names), pa.array([v.tobytes() for v in x], pa.binary())],
                    [*names, "x"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*names, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", x binary")


def matrix(body: list[bytes], width: int = features.WIDTH) -> np.ndarray:
    return np.frombuffer(b"".join(body), dtype=np.float32).reshape(-1, width)


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float
    prior: float = 0.5

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8.0, 8.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.design(x) @ self.w + self.b, -40, 40)))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)


def _adam(grad, size: int, rounds: int, rate: float) -> np.ndarray:
    p, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = grad(p)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return p


def _nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights and bias that minimise the non-negative risk with sigmoid loss."""
    xp, xu = np.c_[xp, np.ones(len(xp))], np.c_[xu, np.ones(len(xu))]

    def grad(p):
        zp, zu = np.clip(xp @ p, -40, 40), np.clip(xu @ p, -40, 40)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        dp, du = (sp * (1 - sp)) @ xp / len(xp), (su * (1 - su)) @ xu / len(xu)
        negative = su.mean() - prior * sp.mean()      # l(-g) = sigmoid(g)
        reg = decay * np.r_[p[:-1], 0.0]
        if negative < 0:                              # the unbiased estimate went below 0: step back from it
            return -(du - prior * dp) + reg
        return -prior * dp + du - prior * dp + reg
    return _adam(grad, xp.shape[1], rounds, rate)


def _positive_vs_unlabelled(xp: np.ndarray, xu: np.ndarray, rounds: int = 300) -> np.ndarray:
    x = np.r_[np.c_[xp, np.ones(len(xp))], np.c_[xu, np.ones(len(xu))]]
    y = np.r_[np.ones(len(xp)), np.zeros(len(xu))]
    weight = np.r_[np.full(len(xp), 0.5 / len(xp)), np.full(len(xu), 0.5 / len(xu))]
    return _adam(lambda p: ((1 / (1 + np.exp(-np.clip(x @ p, -40, 40))) - y) * weight) @ x + 1e-3 * p, x.shape[1], rounds, 0.05)


def estimate_prior(hist_p: np.ndarray, hist_u: np.ndarray, delta: float = 0.1) -> float:
    """Least upper bound of the prior over score thresholds, from counts by score bin."""
    p, u = np.cumsum(hist_p[::-1]), np.cumsum(hist_u[::-1])
    if not p[-1] or not u[-1]:
        return 0.5
    fp, fu = p / p[-1], u / u[-1]
    err = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(u[-1]) + 1 / np.sqrt(p[-1]))
    ok = fp > 0.05
    best = int(np.argmin(np.where(ok, (fu + err) / np.maximum(fp, 1e-9), np.inf)))
    return float(np.clip(fu[best] / fp[best], 0.01, 0.99))


def _histograms(rows: DataFrame, model: Linear) -> tuple[np.ndarray, np.ndarray]:
    """Score histograms of positives and of all rows; a task returns its counts only."""

    def run(batches):
        h = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                b = np.minimum((model.score(matrix(batch.column("x").to_pylist())) * BINS).astype(int), BINS - 1)
                pos = batch.column("positive").to_numpy(zero_copy_only=False)
                h += np.stack([np.bincount(b[pos], minlength=BINS), np.bincount(b, minlength=BINS)])
        k = np.flatnonzero(h.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h[0, k]), pa.array(h[1, k])], ["bin", "p", "u"])

    got = rows.select("x", "positive").mapInArrow(run, "bin int, p long, u long").groupBy("bin").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    out = np.zeros((2, BINS))
    out[:, got["bin"].to_numpy()] = [got["p"].to_numpy(), got["u"].to_numpy()]
    return out[0], out[1]


def fit(rows: DataFrame, sample_rows: int = 20_000) -> Linear:
    """Learn from ``rows (x, positive, seed)``: ``positive`` marks trusted rows,
    every row is part of the unlabelled text, ``seed`` is any id to draw by.
    At most about ``sample_rows`` positives and as many unlabelled rows are
    fitted on the driver; the prior's histograms cover all rows. Without a
    positive every score is 0.5."""
    n = rows.agg(F.count("*").alias("u"), F.count_if("positive").alias("p")).first()
    if not n["p"]:
        return Linear(np.zeros(features.WIDTH), np.ones(features.WIDTH), np.zeros(features.WIDTH), 0.0)
    u = F.pmod(F.xxhash64("seed"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.withColumn("_p", F.col("positive") & (u < min(1.0, sample_rows / n["p"]))).withColumn(
        "_u", u >= 1.0 - min(1.0, sample_rows / n["u"])).filter("_p or _u").select("x", "_p", "_u", "seed").orderBy(
        F.xxhash64("seed")).toArrow()
    x = matrix(got["x"].to_pylist()).astype(np.float64)
    in_p, in_u = got["_p"].to_numpy(), got["_u"].to_numpy()
    if not in_p.any() or not in_u.any():
        in_p, in_u = in_p | ~in_p.any(), in_u | ~in_u.any()
    mean, scale = _scaled(x[in_u])
    model = Linear(mean, scale, np.zeros(x.shape[1]), 0.0)
    xp, xu = model.design(x[in_p]), model.design(x[in_u])
    first = _positive_vs_unlabelled(xp, xu)
    model.w, model.b = first[:-1], float(first[-1])
    model.prior = estimate_prior(*_histograms(rows, model))
    last = _nnpu(xp, xu, model.prior)
    model.w, model.b = last[:-1], float(last[-1])
    return model


def score_table(rows: DataFrame, model: Linear, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every row of a ``stats_table``."""
    names = list(keep)

    def run(batches):
        for batch in batches:
            s = model.score(matrix(batch.column("x").to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s, pa.float64())], [*names, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*names, "x").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double")


def quality_scores(docs: DataFrame, labels: DataFrame, learn, sample_rows: int = 20_000) -> tuple[DataFrame, Linear]:
    """Scores of every row of ``docs (doc_id, text)``, and the model.

    Trusted positives: rows of ``docs`` for which ``learn`` (a Column on
    doc_id) holds and some row of ``labels (doc_id, quality)`` has quality 1;
    labels of 0 are never read. Unlabelled text: all rows for which ``learn``
    holds. A null text counts as empty and gets a score like any other; a null
    doc_id is never a learning row; repeated label rows count once; other
    columns are ignored; empty tables give an empty result or scores of 0.5.
    """
    stats = stored(stats_table(docs.select("doc_id", "text"), ["doc_id"]), "text_stats")
    trusted = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("positive", F.lit(True))
    rows = stats.filter("doc_id is not null").filter(learn).join(trusted, "doc_id", "left").select(
        "x", F.coalesce("positive", F.lit(False)).alias("positive"), F.col("doc_id").alias("seed"))
    model = fit(stored(rows, "pu_rows"), sample_rows)
    return score_table(stats, model, ["doc_id"]), model
