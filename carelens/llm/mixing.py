"""Soft-membership mixing to target weights (operator 10).

1. A softmax classifier, fitted on a bounded sample of a labelled table, gives
   each document posteriors p over the domains (it reads the whole text:
   statistics, and presence of the words that tell the domains apart).
2. Document rates r >= 0 are fitted so that the expected tokens of each domain,
   sum_i r_i n_i p_ik, come to its target: projected-gradient least squares on

       1/2 |T(r) - t|^2 + ridge/2 * sum_i s_i (r_i - 1)^2

   with T and t as shares of the target total and s_i the document's share of
   all tokens. The ridge keeps rates near 1 and makes them unique. The gradient
   for a document needs only the K residuals, so an iteration is one
   aggregate of K numbers over the posterior table; the rates themselves are
   replayed from the residual history and are never shuffled or collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from . import text as T
from .pu_quality import _adam
from .tables import stored

WORD_BITS = 18


def _word_buckets(h: np.ndarray) -> np.ndarray:
    return (h >> T.U64(64 - WORD_BITS)).view(np.int64)


def _rows(batch, size=T.CHUNK_BYTES):
    """For each chunk: first row, last row, words (row, bucket), statistics, word counts."""
    off, raw = T.buffers(batch.column("text"))
    for a, b, o, r in T.chunks(off, raw, size):
        start, end, row = T.words(o, r)
        h = T.span_hashes(r, start, end)
        yield a, b, row, _word_buckets(h), features.document_stats(o, r, (start, end, row, h)), np.bincount(row, minlength=b - a)


@dataclass
class Domains:
    names: list[str]
    words: np.ndarray          # chosen word buckets, ascending
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray              # (domains, inputs + 1)

    def inputs(self, row, bucket, stats) -> np.ndarray:
        dense = np.clip((stats - self.mean) / self.scale, -8, 8)
        has = np.zeros((len(stats), len(self.words)))
        if len(self.words) and len(bucket):
            at = np.minimum(np.searchsorted(self.words, bucket), len(self.words) - 1)
            hit = self.words[at] == bucket
            has[row[hit], at[hit]] = 1.0
        return np.c_[dense, 2.0 * has, np.ones(len(stats))]

    def posteriors(self, row, bucket, stats) -> np.ndarray:
        z = self.inputs(row, bucket, stats) @ self.w.T
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 300, rate: float = 0.03, decay: float = 1e-4) -> np.ndarray:
    one = np.eye(k)[y]

    def grad(p):
        w = p.reshape(k, -1)
        z = x @ w.T
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        return ((z - one).T @ x / len(x) + decay * w).ravel()
    return _adam(grad, k * x.shape[1], rounds, rate).reshape(k, -1)


@T.giving_back
def _sampler(batches):
    T.held_by("mixing")
    for batch in batches:
        names = batch.column("domain")
        for a, b, row, bucket, stats, _ in _rows(batch):
            pair = np.unique(row * (1 << WORD_BITS) + bucket)
            cut = np.searchsorted(pair, np.arange(b - a + 1) * (1 << WORD_BITS))
            words = (pair & ((1 << WORD_BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [names.slice(a, b - a), pa.array([s.tobytes() for s in stats], pa.binary()),
                 pa.array([words[cut[i]:cut[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                ["domain", "x", "words"])


def fit_domains(docs: DataFrame, labelled: DataFrame, sample_rows: int = 8_000, n_words: int = 256) -> Domains:
    """Classifier from ``labelled (doc_id, domain)``, joined to ``docs (doc_id, text)``.

    A sample of about ``sample_rows`` labelled rows (all if fewer), drawn by a
    hash of doc_id, is fitted on the driver; of a sampled text its statistics
    and the set of its hashed words are read. Null ids and domains teach
    nothing; an id with several labels counts with each.
    """
    labelled = labelled.select("doc_id", "domain").filter("doc_id is not null and domain is not null").distinct()
    n = labelled.count()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = labelled.filter(u < min(1.0, sample_rows / max(n, 1)))  # about sample_rows rows: safe to broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", "text").mapInArrow(
        _sampler, "domain string, x binary, words binary").orderBy("domain", "x", "words").toArrow()
    names = sorted(set(got["domain"].to_pylist()))
    if not names:
        return Domains([], np.zeros(0, np.int64), np.zeros(features.WIDTH), np.ones(features.WIDTH), np.zeros((0, 1)))
    y = np.searchsorted(names, got["domain"].to_pylist())
    stats = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), -1).astype(np.float64)
    sets = [np.frombuffer(b, "<u4").astype(np.int64) for b in got["words"].to_pylist()]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = np.concatenate(sets)
    size = 1 << WORD_BITS
    score = np.zeros(size)
    total = np.bincount(bucket, minlength=size)
    for k in range(len(names)):  # one-against-rest chi-square with Yates' correction
        m, in_k = len(y), int((y == k).sum())
        a = np.bincount(bucket[y[row] == k], minlength=size)
        b, c = total - a, in_k - a
        d = m - in_k - b
        low = np.maximum(0.0, np.abs(a * d - b * c) - m / 2) ** 2 * m
        score = np.maximum(score, low / np.maximum(1.0, total * (m - total) * in_k * (m - in_k) * 1.0))
    words = np.sort(np.argsort(-score, kind="stable")[:n_words])
    words = words[score[words] > 10.0]
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    model = Domains(names, words, mean, scale, np.zeros((len(names), 1)))
    model.w = _softmax_fit(model.inputs(row, bucket, stats), y, len(names))
    return model


def posterior_table(docs: DataFrame, model: Domains) -> DataFrame:
    """(doc_id, n_tokens, p): words of the whole text and domain posteriors, in the order of ``model.names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @T.giving_back
    def run(batches):
        m = shared.value
        for batch in batches:
            for a, b, row, bucket, stats, words in _rows(batch):
                p = m.posteriors(row, bucket, stats) if m.names else np.zeros((b - a, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(words.astype(np.int64)),
                     pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, p array<double>")


@dataclass
class Fit:
    """History of the projected gradient (residual and momentum of each round): the rates are a function of it."""
    target: np.ndarray
    total: float
    budget: float
    ridge: float
    step: float
    history: list = field(default_factory=list)
    achieved: np.ndarray | None = None
    gradient: float = 0.0

    def walk(self, p: np.ndarray):
        """Rates of documents with posteriors ``p`` after the last round, those before it, the
        point the last step was taken from, and the point the next one is taken from.
        Steps are taken per token share, so a document's length does not matter."""
        old = x = y = at = np.ones(len(p))
        scale = self.total / self.budget if self.budget else 0.0
        for residual, momentum in self.history:
            at, old = y, x
            x = np.maximum(0.0, y - self.step * (scale * (p @ residual) + self.ridge * (y - 1.0)))
            y = x + momentum * (x - old) if momentum else x
        return x, old, at, y

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.walk(p)[0]


def _posteriors(batch) -> np.ndarray:
    col = batch.column("p")
    return col.flatten().to_numpy().reshape(batch.num_rows, -1)


def fit_rates(table: DataFrame, target: np.ndarray, budget: float | None = None, ridge: float = 1e-3,
              rounds: int = 200, tolerance: float = 1e-4, plain: int = 25) -> Fit:
    """Projected gradient on ``table (n_tokens, p)``, one small aggregate per round.

    ``target``: shares of the domains (scaled to sum 1); ``budget``: expected
    tokens of the mix (default: all tokens). After ``plain`` rounds the steps
    have momentum, which starts again when a step goes against it. Stops when
    the projected gradient (root mean square over the tokens) is below
    ``tolerance``, or after ``rounds`` rounds.
    """
    target = np.asarray(target, dtype=np.float64)
    target = target / target.sum() if target.sum() else target
    k = len(target)
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    fit = Fit(target, total, float(budget or total), ridge, 0.0)
    if not total or not k:
        return fit
    scale = total / fit.budget

    def sums(moments: bool) -> np.ndarray:
        """Expected shares at the next point and at the rates, size and turn of the last step; the moments of p."""
        @T.giving_back
        def run(batches):
            out = np.zeros(2 * k + 2 + k * k)
            for batch in batches:
                if batch.num_rows:
                    p, n = _posteriors(batch), batch.column("n_tokens").to_numpy() / total
                    x, old, at, y = fit.walk(p)
                    out[:k] += (y * n * scale) @ p
                    out[k:2 * k] += (x * n * scale) @ p
                    out[2 * k] += ((x - at) ** 2) @ n
                    out[2 * k + 1] += ((at - x) * (x - old)) @ n
                    if moments:
                        out[2 * k + 2:] += ((p * n[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["i", "v"])
        rows = table.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        got = np.zeros(2 * k + 2 + k * k)
        for x in rows:
            got[x["i"]] = x["v"]
        return got

    now = sums(True)
    # preconditioned by the shares s_i, the quadratic's curvature is that of the K x K posterior moments
    fit.step = 1.0 / (scale * scale * float(np.linalg.eigvalsh(now[2 * k + 2:].reshape(k, k)).max()) + ridge)
    t = 1.0
    for i in range(rounds):
        if i < plain or now[2 * k + 1] > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2 if i >= plain else 1.0
        fit.history.append((now[:k] - target, (t - 1) / after))
        t = after
        now = sums(False)
        fit.gradient = float(np.sqrt(now[2 * k])) / fit.step
        if fit.gradient < tolerance:
            break
    fit.achieved = now[k:2 * k]
    return fit


def add_rates(table: DataFrame, fit: Fit, names: list[str]) -> DataFrame:
    """``table`` with ``rate`` and one posterior column ``p_<domain>`` per domain."""
    fields = [c for c in table.columns if c != "p"]
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}

    @T.giving_back
    def run(batches):
        for batch in batches:
            p = _posteriors(batch) if batch.num_rows and names else np.zeros((batch.num_rows, len(names)))
            rate = fit.rates(p) if names else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in fields), pa.array(rate), *(pa.array(p[:, j]) for j in range(len(names)))],
                [*fields, "rate", *(f"p_{x}" for x in names)])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in fields), "rate double", *(f"`p_{x}` double" for x in names)])
    return table.mapInArrow(run, schema)


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None,
                   **options) -> tuple[DataFrame, Fit, Domains]:
    """(doc_id, n_tokens, rate, p_<domain> ...), one row per row of ``docs (doc_id, text)``.

    ``targets`` names domains of ``labelled``; a domain without a target has
    target 0, a target without a labelled row is left out. Null and empty
    texts have 0 tokens and the rate of their posteriors; repeated rows get
    equal rates; with no labelled row every rate is 1. Other columns are
    ignored; an empty table gives an empty result.
    """
    model = fit_domains(docs, labelled, **options)
    table = stored(posterior_table(docs, model), "posteriors")
    fit = fit_rates(table, np.array([targets.get(x, 0.0) for x in model.names]), budget, plain=0)
    return add_rates(table, fit, model.names), fit, model


def emit(docs: DataFrame, model: Domains, fit: Fit) -> DataFrame:
    """The rows of ``docs`` as often as their rates say, all columns kept: the whole
    part of the rate always, once more with the probability of the rest, decided
    by a hash of the text and doc_id. Rates are found where the row is (no join)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, fit))
    names = docs.columns
    drawn = "u_" + "_".join(names)  # a name that no column of docs has

    @T.giving_back
    def run(batches):
        m, f = shared.value
        for batch in batches:
            for a, b, row, bucket, stats, _ in _rows(batch):
                rate = f.rates(m.posteriors(row, bucket, stats)) if m.names else np.ones(b - a)
                part = batch.slice(a, b - a)
                u = part.column(drawn).to_numpy() / (1 << 30)
                n = np.floor(rate + u).astype(np.int64)
                yield part.select(names).take(pa.array(np.repeat(np.arange(b - a), n)))

    return docs.withColumn(drawn, F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30))).mapInArrow(run, docs.schema)
