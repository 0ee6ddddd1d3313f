"""Language identification by nearest clustered centroid (operator 1).

A text becomes counts of hashed letter trigrams (words padded by a space,
lower-cased, everything but letters is a gap). With idf from all learning rows
the vector is log(1 + tf) * idf, scaled to length 1. Each language has several
centroids: spherical k-means over a bounded sample of its learning rows. A
text gets the language of the centroid of largest cosine, and is rejected if
its distance (1 - cosine) exceeds what texts of its length show: the radius is
fitted on pieces of the sample's texts of doubling length. The distance of a
text grows with its length beyond the longest length fitted, so a longer text
is cut into equal pieces within that length, all of them are compared with the
centroids of its language, and it is rejected if their median is too far.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from . import text as T
from .tables import remove, store

DIM = 4096
GAP = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
PIECES = [2 ** i for i in range(3, 14)]  # letters and gaps of a piece, for the radius
_WEIGHT = T.random_u64("trigram", 3) | T.U64(1)


def _trigrams(s: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the trigrams of normalised text, and which count: not those with a gap in the middle."""
    cp = np.frombuffer(s.encode("utf-32-le", "replace"), dtype="<u4").astype(T.U64)
    if len(cp) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = T.mix(cp[:-2] * _WEIGHT[0] + cp[1:-1] * _WEIGHT[1] + cp[2:] * _WEIGHT[2]) >> T.U64(52)
    ok = cp[1:-1] != 32
    return h.view(np.int64), ok


def normalise(s: str) -> str:
    return GAP.sub(" ", s.lower())


def has_letter(s: str) -> bool:
    return any(map(str.isalpha, s))


def count_vectors(texts: list[str]) -> np.ndarray:
    """Trigram counts of each text, one row of DIM counts each."""
    norm = [f" {normalise(t)} " for t in texts]
    h, ok = _trigrams("".join(norm))
    if not len(h):
        return np.zeros((len(texts), DIM), dtype=np.float32)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in norm])[:len(h)]
    flat = (row * DIM + h)[ok]
    return np.bincount(flat, minlength=len(texts) * DIM).reshape(len(texts), DIM).astype(np.float32)


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(n > 0, n, 1)).astype(np.float32)


def _texts(col: pa.Array, size: int = 1 << 20):
    """(first row, texts) in groups of at most 256 rows and about ``size`` bytes."""
    off, _ = T.buffers(col)
    a, n = 0, len(col)
    while a < n:
        b = min(n, a + 256, max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1))
        yield a, [x or "" for x in col.slice(a, b - a).to_pylist()]
        a = b


@dataclass
class Model:
    langs: list[str]           # learned languages
    centroids: np.ndarray      # (languages * clusters, DIM), unit length
    owner: np.ndarray          # language of each centroid
    idf: np.ndarray
    radius: np.ndarray         # largest usual distance for each length of PIECES
    longest: int = 0           # longest length the radius was fitted on (0: none)

    def predict(self, texts: list[str]):
        """Language number (-1: no letter), cosine, rejected."""
        lang, score, rejected = self.assign(count_vectors(texts), np.array([has_letter(t) for t in texts], dtype=bool))
        if self.longest:
            for i in np.flatnonzero((lang >= 0) & (np.array([len(t) for t in texts]) > self.longest)):
                s = normalise(texts[i])
                if len(s) > self.longest:
                    rejected[i] = np.median(self._excess(s, lang[i])) > 0
        return lang, score, rejected

    def _excess(self, s: str, lang: int) -> np.ndarray:
        """By how much each piece of a long normalised text is farther from the language than its length allows."""
        n = -(-len(s) // self.longest)
        cut = [len(s) * k // n for k in range(n + 1)]
        near, out = self.centroids[self.owner == lang].T, []
        for a in range(0, n, 256):
            counts = count_vectors([s[x:y] for x, y in zip(cut[a:a + 256], cut[a + 1:a + 257])])
            grams = counts.sum(axis=1)
            far = 1.0 - (unit(counts, self.idf) @ near).max(axis=1)
            out.append((far - self.reach(grams))[grams > 0])
        return np.concatenate(out)

    def reach(self, grams: np.ndarray) -> np.ndarray:
        return np.interp(np.log2(np.maximum(grams, 1)), [0, *np.log2(PIECES)], [1.0, *self.radius])

    def assign(self, counts: np.ndarray, lettered: np.ndarray):
        grams = counts.sum(axis=1)
        if not self.langs:
            return np.full(len(counts), -1), np.zeros(len(counts)), np.ones(len(counts), dtype=bool)
        cos = unit(counts, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(counts)), best], 0.0, 1.0).astype(np.float64)
        lang = np.where(lettered, self.owner[best], -1)
        return lang, np.where(lettered, score, 0.0), ~lettered | (1.0 - score > self.reach(grams))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts; empty clusters go."""
    at = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[at[0]]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        a = (x @ c.T).argmax(axis=1)
        c = np.stack([x[a == j].sum(axis=0) for j in np.unique(a)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _sparse(v: np.ndarray) -> bytes:
    at = np.flatnonzero(v)
    return at.astype("<u2").tobytes() + v[at].astype("<f4").tobytes()


def _dense(body: list[bytes]) -> np.ndarray:
    out = np.zeros((len(body), DIM), dtype=np.float32)
    for row, b in zip(out, body):
        n = len(b) // 6
        row[np.frombuffer(b, "<u2", n)] = np.frombuffer(b, "<f4", n, offset=2 * n)
    return out


@T.giving_back
def _gather(batches):
    """Document frequencies of a task; of sampled rows the counts of the whole
    text (size 0) and of a piece from the middle of each length in PIECES."""
    T.held_by("language")
    df, n = np.zeros(DIM, dtype=np.int64), 0
    for batch in batches:
        picked = batch.column("picked").to_numpy(zero_copy_only=False)
        langs = batch.column("lang").to_pylist()
        for a, texts in _texts(batch.column("text")):
            counts = count_vectors(texts)
            has = counts.sum(axis=1) > 0
            df += (counts > 0).sum(axis=0)
            n += int(has.sum())
            for i in np.flatnonzero(picked[a:a + len(texts)] & has):
                s = normalise(texts[i])
                sizes = [z for z in PIECES if z <= len(s)]
                cut = count_vectors([s[(len(s) - z) // 2:][:z] for z in sizes])
                out = [(0, _sparse(counts[i])), *((z, _sparse(c)) for z, c in zip(sizes, cut))]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64()), pa.array([langs[a + i]] * len(out)),
                     pa.array([z for z, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())],
                    ["bucket", "n", "lang", "size", "vec"])
    hit = np.flatnonzero(df)
    m = len(hit) + 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(df[hit], n), pa.int64()),
         pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
        ["bucket", "n", "lang", "size", "vec"])


def fit(rows: DataFrame, clusters: int = 4, sample_per_lang: int = 200) -> Model:
    """Learn from ``rows (text, lang)``; null languages and texts without a
    letter teach nothing.

    Document frequencies come from every row. Centroids and radii are fitted
    on a bounded sample: about ``sample_per_lang`` rows per language, chosen by
    a hash of the text (equal texts together), of which the trigram counts of
    the whole text and of a few pieces reach the driver.
    """
    rows = rows.select("text", "lang").filter("text is not null and lang is not null")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return Model([], np.zeros((0, DIM)), np.zeros(0, int), np.zeros(DIM), np.zeros(len(PIECES)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_per_lang / per[k]))])
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got, path = store(rows.withColumn("picked", u < share[F.col("lang")]).mapInArrow(
        _gather, "bucket int, n long, lang string, size int, vec binary"), "language_fit")
    freq = got.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sample = got.filter("bucket is null").select("lang", "size", "vec").orderBy("lang", "size", "vec").toArrow()
    remove(rows.sparkSession, path)
    n_of = dict(zip(freq["bucket"].to_pylist(), freq["n"].to_pylist()))
    n = n_of.pop(-1, 0)
    df = np.zeros(DIM)
    df[list(n_of)] = list(n_of.values())
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    vec, size_of = sample["vec"].to_pylist(), sample["size"].to_numpy()
    lang_of = np.array(sample["lang"].to_pylist(), dtype=object)
    cents, owner, present = [], [], [x for x in langs if (lang_of == x).any()]
    for j, lang in enumerate(present):
        c = _kmeans(unit(_dense([vec[i] for i in np.flatnonzero((lang_of == lang) & (size_of == 0))]), idf), clusters)
        cents.append(c)
        owner += [j] * len(c)
    model = Model(present, np.concatenate(cents) if cents else np.zeros((0, DIM)), np.array(owner, dtype=int),
                  idf, np.ones(len(PIECES)))
    radius: list[float] = []
    for z in PIECES:  # the farthest piece of each length, with some room; below the first length it widens to 1
        pieces = [vec[i] for i in np.flatnonzero(size_of == z)]
        far = 1.0 - model.assign(_dense(pieces), np.ones(len(pieces), bool))[1] if len(pieces) >= 5 else None
        radius.append(min(0.95, float(far.max()) * 1.1 + 0.05) if far is not None else (radius[-1] if radius else 0.95))
        model.longest = z if far is not None else model.longest
    model.radius = np.array(radius)
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` added.

    Reads the whole ``text`` and nothing else. Null texts and texts without a
    letter get ``und``, score 0 and are rejected; so does every text if no
    language was learned. Ties go to the first centroid. Columns of ``docs``
    with the added names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    @T.giving_back
    def run(batches):
        T.held_by("language")
        m = shared.value
        tag = np.array([*m.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for a, texts in _texts(batch.column("text")):
                lang, score, rejected = m.predict(texts)
                part = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(tag[lang].tolist(), pa.string()),
                     pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    [*names, "lang_pred", "score", "rejected"])

    schema = Ty.StructType([*docs.schema.fields, Ty.StructField("lang_pred", Ty.StringType()),
                            Ty.StructField("score", Ty.DoubleType()), Ty.StructField("rejected", Ty.BooleanType())])
    return docs.mapInArrow(run, schema)
