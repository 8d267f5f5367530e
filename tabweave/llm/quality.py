"""Quality classification: random-indexing word vectors, pooled per document, and a two-layer network.

Words are runs of letters, digits or other marks; beside each word stand words for its shape (upper case, title case,
length of a run of marks) and for its being a repetition of a word just before. Every word (by a hashed bucket) has a
fixed sparse ternary index vector. Its word vector is the sum of the index vectors seen around it in the training
texts, plus its own. A document is the mean of its words' vectors with a few lengths; a network of two layers, fitted
in NumPy, scores it, and a temperature fitted on rows apart from those of the fit calibrates the probability.

The fit uses a bounded sample of labelled rows: about `sample` distinct ones and at most `sample_chars` characters, by a
hash of their content; texts are taken whole, and one that alone is longer than a quarter of that is left to scoring. Scores read whole texts in one pass without a shuffle.

Defined results: null counts as the empty text, whose features are zero; without any labelled row every score is 0.5;
repeated rows are scored each; a row with several labels counts as labelled with each, and repeated labels or labelled
rows count once; there are no ties; an empty table gives no rows; other columns are not read, and an id may have any type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm import arrays as A
from tabweave.llm.shared import bounded_batches, texts_of

BUCKETS = 1 << 15
DIM = 64
NONZERO = 6
REPEAT, UPPER, TITLE, LOWER, MARKS = range(5)
EXTRA = 16  # buckets of the shape words, after the hashed ones


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words with their shape words, and how many each text has."""
    cps = A.code_points("".join(texts))
    doc = A.offsets([len(t) for t in texts])
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    cls = A.classes()[cps]
    first = np.flatnonzero(A.run_starts(cls, doc))
    ends = np.append(first[1:], len(cps))
    kind = cls[first]
    solid = kind != A.SPACE
    first, ends, kind = first[solid], ends[solid], kind[solid]
    hashes = A.segment_hashes(cps, first, ends)
    owner = np.searchsorted(doc, first, side="right") - 1
    bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    # shape: by the case of the first two letters; runs of marks and digits by their length
    c0 = cps[first]
    c1 = cps[np.minimum(first + 1, len(cps) - 1)]
    upper = lambda c: ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))
    length = ends - first
    shape = np.where(upper(c0), np.where((length > 1) & upper(c1), UPPER, TITLE), LOWER)
    shape = np.where(kind == A.LETTER, shape, MARKS + np.minimum(length, 5) + np.where(kind == A.NUMBER, 5, 0))
    again = np.zeros(len(hashes), bool)
    for back in (1, 2, 4):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back]) & (kind[back:] == A.LETTER)
    shape = np.where(again, REPEAT, shape) + BUCKETS
    out = np.empty(2 * len(bucket), np.int64)
    out[0::2], out[1::2] = shape, bucket
    return out, 2 * np.bincount(owner, minlength=len(texts))


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors, one per bucket."""
    rng = np.random.default_rng(seed)
    n = BUCKETS + EXTRA
    out = np.zeros((n, DIM), np.float32)
    where = np.argsort(rng.random((n, DIM)), axis=1)[:, :NONZERO]
    out[np.arange(n)[:, None], where] = rng.choice(np.array([-1, 1], np.float32), (n, NONZERO))
    return out


def word_vectors(texts: list[str], window: int = 2) -> np.ndarray:
    """Unit word vectors by random indexing over the texts."""
    index = index_vectors()
    sums = np.zeros_like(index)
    seen = np.zeros(len(index))
    for lo, hi in A.chunks(texts):
        b, counts = word_buckets(texts[lo:hi])
        owner = np.repeat(np.arange(hi - lo), counts)
        seen += np.bincount(b, minlength=len(index))
        for step in (s for s in range(-window, window + 1) if s):
            x, y = (b[step:], b[:-step]) if step > 0 else (b[:step], b[-step:])
            same = owner[step:] == owner[:-step] if step > 0 else owner[:step] == owner[-step:]
            pairs, times = np.unique(x[same] * np.int64(len(index)) + y[same], return_counts=True)
            np.add.at(sums, pairs // len(index), index[pairs % len(index)] * times[:, None].astype(np.float32))
    # a frequent word's contexts say little more than the language's common words
    context = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    own = index / np.sqrt(np.float32(NONZERO))
    out = np.where(seen[:, None] > 0, 0.5 * context + own, own)
    return out.astype(np.float32)


def features(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text, then logs of its number of words and characters."""
    out = np.zeros((len(texts), DIM + EXTRA + 2), np.float32)
    for lo, hi in A.chunks(texts, 200_000):
        b, counts = word_buckets(texts[lo:hi])
        full = np.flatnonzero(counts)
        if len(full):
            at = A.offsets(counts)[:-1][full]
            out[lo + full, :DIM] = np.add.reduceat(vectors[b], at, axis=0) / counts[full, None]
            owner = np.repeat(np.arange(hi - lo), counts // 2)
            shape = b[0::2] - BUCKETS
            table = np.bincount(owner * EXTRA + shape, minlength=(hi - lo) * EXTRA).reshape(-1, EXTRA)
            out[lo + full, DIM : DIM + EXTRA] = (2 * table / np.maximum(counts, 1)[:, None])[full]
        out[lo:hi, -2] = np.log1p(counts)
        out[lo:hi, -1] = np.log1p([len(t) for t in texts[lo:hi]])
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.logits(features(texts, self.vectors).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(texts: list[str], labels: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> QualityModel:
    """Fits on four fifths of the rows, the temperature on the last fifth."""
    y = np.asarray(labels, float)
    vectors = word_vectors(texts)
    x = features(texts, vectors).astype(np.float64)
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(x))
    cut = len(x) - len(x) // 5
    fit_rows, rest = part[:cut], part[cut:]
    centre, scale = x[fit_rows].mean(0) if cut else np.zeros(d), (x[fit_rows].std(0) if cut else np.zeros(d)) + 1e-3
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z = (x - centre) / scale
    for epoch in range(epochs if cut and 0 < y.mean() < 1 else 0):
        order = rng.permutation(fit_rows)
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for s in range(0, len(order), 64):
            a, b = z[order[s : s + 64]], y[order[s : s + 64]]
            pre = a @ p[0] + p[1]
            h = np.maximum(pre, 0)
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - b) / len(b)
            back = np.outer(err, p[2]) * (pre > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(0), h.T @ err + 1e-4 * p[2], np.array([err.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    if not (cut and 0 < y.mean() < 1):
        level = 0.0 if not len(y) else (3.0 if y.mean() >= 1 else -3.0)
        p = [np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), np.array([level])]
    model = QualityModel(vectors, centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(rest) >= 20:
        raw, own = model.logits(x[rest]), y[rest]
        loss = lambda T: np.mean(np.logaddexp(0, raw / T) - own * raw / T)
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, sample_chars: int = 64_000_000) -> QualityModel:
    """Fits on labelled rows; at most twice `sample` rows and `sample_chars` characters reach the driver."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna().distinct()
    total = known.count()
    rate = min(1.0, sample / max(total, 1))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(5), F.col("id").cast("string")), F.lit(1_000_000)) < rate * 1_000_000)
    # the sample's size is bounded by its rate, so its ids may be broadcast
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
    plain = plain.withColumn("mark", F.xxhash64(F.lit(9), F.col("id").cast("string"), "t")).withColumn("n", F.length("t")).filter(F.col("n") <= sample_chars // 4)
    sizes = plain.select("mark", "y", "n").distinct().orderBy("mark", "y").limit(2 * sample).collect()
    fits = np.searchsorted(np.cumsum([r["n"] for r in sizes]), sample_chars, side="right") if sizes else 0
    if not fits:
        return fit([], np.zeros(0))
    rows = plain.filter(F.col("mark") <= sizes[fits - 1]["mark"]).dropDuplicates(["mark", "y"]).select("mark", "t", "y").toArrow().sort_by([("mark", "ascending"), ("y", "ascending")])
    return fit(rows.column("t").to_pylist(), rows.column("y").to_numpy())


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and score, the calibrated probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, fixed by BUCKETS and DIM
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = shared.value
        for batch in batches:
            A.release()
            out = own.score(texts_of(batch, text_col))
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "score": pa.array(out, pa.float64())})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs that the model does not reject; all columns, one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        A.release()
        return pd.Series(shared.value.score([t or "" for t in texts]))

    return docs.filter(scored(F.col(text_col)) >= threshold)
