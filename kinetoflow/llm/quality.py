"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated scores.

1. Random indexing over all documents: each word (hashed to one of ``BUCKETS``) has a sparse random index vector; a
   word's context vector is the sum of the index vectors of the words around it. Tasks sum their own documents'
   contexts to at most ``BUCKETS`` rows, which one aggregation adds up, so what is shuffled and kept is bounded.
2. A document is the mean of its words' context and index vectors, with a few ratios of the same words (``STATS``).
3. A two-layer network is fitted on a sample of at most ``MAX_TRAIN`` labelled documents, chosen by a hash of their id
   among those not held out; a fifth of the sample fits the temperature of the probabilities.
4. Every whole text is scored with the fitted model (about 4 MB, broadcast).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Hash buckets for words; the last one is for the gap between documents.
BUCKETS = 1 << 14
DIM = 32
WINDOW = 2
#: Labelled documents at most that the network is fitted on.
MAX_TRAIN = 12_000
HIDDEN = 32
THRESHOLD = 0.7
STATS = ("log_words", "capitals", "repeats", "trigram_repeats", "index_norm", "symbols")
TOKEN = re.compile(r"\w+|[^\w\s]+")
CAPS, SYMBOL = 1 << 20, 1 << 21
_MEMO = 400_000


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary index vector of each bucket, four entries not zero; zeros for the gap."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.int32)
    for k in range(4):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice([-1, 1], BUCKETS)
    out[-1] = 0
    return out


class Words(dict):
    """Word -> bucket with marks for capitals and symbols; forgets all when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO:
            self.clear()
        code = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        if len(word) > 1 and word.isupper():
            code |= CAPS
        if not (word[0].isalnum() or word[0] == "_"):
            code |= SYMBOL
        self[word] = code
        return code


def _codes(texts: list[str | None], memo: Words) -> tuple[np.ndarray, np.ndarray]:
    """Marked buckets of all texts' words, each text followed by a gap, and where each text starts."""
    flat: list[int] = []
    starts = []
    gap = BUCKETS - 1
    for t in texts:
        starts.append(len(flat))
        if t:
            flat.extend([memo[w] for w in TOKEN.findall(t)])
        flat.append(gap)
    return np.array(flat, np.int32), np.array(starts, np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, memo = index_vectors(), Words()
    total, seen = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, bool)
    for batch in batches:
        codes, _ = _codes(batch.column(0).to_pylist(), memo)
        for at in range(0, len(codes), 1 << 18):  # a text of any length takes bounded memory
            low, high = max(0, at - WINDOW), min(len(codes), at + (1 << 18))
            b = codes[low : high + WINDOW] & (CAPS - 1)
            vec = index[b]
            near = np.zeros_like(vec)
            for k in range(1, WINDOW + 1):
                near[k:] += vec[:-k]
                near[:-k] += vec[k:]
            own, near = b[at - low : high - low], near[at - low : high - low]
            order = np.argsort(own, kind="stable")
            kinds, first = np.unique(own[order], return_index=True)
            if len(kinds):
                total[kinds] += np.add.reduceat(near[order], first, axis=0)
                seen[kinds] = True
    seen[-1] = False
    rows = np.nonzero(seen)[0]
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(total[rows, k]) for k in range(DIM))], names=["bucket", *(f"c{k}" for k in range(DIM))])


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vector of each bucket over all documents, of length one (zero for buckets without words)."""
    small_batches(docs.sparkSession)
    parts = docs.select(text_col).mapInArrow(_contexts, "bucket int, " + ", ".join(f"c{k} long" for k in range(DIM)))
    sums = parts.groupBy("bucket").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(DIM)]).toPandas()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIM), np.float32)
    out[sums["bucket"].to_numpy(np.int64)] = sums[[f"c{k}" for k in range(DIM)]].to_numpy(np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], vectors: np.ndarray, index: np.ndarray, memo: Words) -> np.ndarray:
    """One row of features for each text; zeros for texts without words."""
    codes, starts = _codes(texts, memo)
    ends = np.append(starts[1:], len(codes))
    out = np.zeros((len(texts), 2 * DIM + len(STATS)), np.float32)
    for i, (s, e) in enumerate(zip(starts.tolist(), (ends - 1).tolist())):
        n = e - s
        if not n:
            continue
        marked = codes[s:e]
        b = marked & (CAPS - 1)
        count = np.bincount(b, minlength=1) if n > 4 * BUCKETS else None
        if count is not None:
            kinds = np.nonzero(count)[0]
            weight = count[kinds].astype(np.float32)
        else:
            kinds, weight = b, None
        both = (np.add.reduce(vectors[kinds], 0), np.add.reduce(index[kinds], 0, dtype=np.float32)) if weight is None else (weight @ vectors[kinds], weight @ index[kinds].astype(np.float32))
        out[i, :DIM], out[i, DIM : 2 * DIM] = both[0] / n, both[1] / n
        triple = b[2:].astype(np.int64) * (BUCKETS * BUCKETS) + b[1:-1].astype(np.int64) * BUCKETS + b[:-2]
        again = 1 - len(np.unique(triple)) / len(triple) if n > 2 else 0
        same = ((b[1:] == b[:-1]).sum() + (b[2:] == b[:-2]).sum()) / n if n > 1 else 0
        out[i, 2 * DIM :] = np.log1p(n), (marked & CAPS > 0).mean(), same, again, np.linalg.norm(out[i, DIM : 2 * DIM]), (marked & SYMBOL > 0).mean()
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    #: Score of every text if one class or none was seen.
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 11, epochs: int = 60) -> Model:
    """Fit network and temperature; every fifth row is kept for the temperature."""
    if not len(y) or y.min() == y.max():
        return Model(vectors, np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0, (float(y.sum()) + 1) / (len(y) + 2))
    x = x.astype(np.float64)
    held = np.arange(len(y)) % 5 == 4
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    params = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    xt, yt = z[~held], y[~held].astype(float)
    step = 0
    for epoch in range(epochs):
        rate = 4e-3 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(yt))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            h = np.tanh(xt[rows] @ params[0] + params[1])
            err = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - yt[rows]) / len(rows)
            back = np.outer(err, params[2]) * (1 - h * h)
            grads = [xt[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ err + 1e-4 * params[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if held.any():
        out = model.logits(x[held])
        model.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: _loss(out / t, y[held].astype(float))))
    return model


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; false for null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Word vectors over all of ``docs``; network and temperature from labelled rows that are not held out."""
    vectors = context_vectors(docs, text_col)
    index = index_vectors()
    sample = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64("id"), "id", "y").limit(max_train)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, index))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            x = pooled(batch.column(2).to_pylist(), *shared.value, memo)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample has a row limit, so it is small enough to broadcast
    rows = texts.join(F.broadcast(sample), "id").select("id", "y", "text").mapInArrow(features, texts.select("id").schema[0].simpleString().replace(":", " ") + ", y int, x binary").toPandas()
    rows = rows.assign(order=pd.util.hash_array(rows["id"].astype(str).to_numpy(object))).sort_values(["order", "y", "x"]).drop_duplicates(["id", "y", "x"])
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]]) if len(rows) else np.zeros((0, 2 * DIM + len(STATS)), np.float32)
    return fit(x, rows["y"].to_numpy(), vectors)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add the probability that a text is good. Null and empty texts are scored too, as texts without words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vars(model), index_vectors()))  # plain values: executors need no package

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts, index = shared.value
        fitted = Model(**parts)
        memo = Words()
        for texts in batches:
            yield pd.Series(fitted.scores(pooled(texts.tolist(), fitted.vectors, index, memo)))

    return docs.withColumn(name, scores(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, text, held_out, score, predicted) of every row: trains on ``labels`` and scores all of ``docs``.

    Labels other than 0 and 1, and null ids, teach nothing. Repeated rows count once in training and keep a row each in
    the result. Without labelled documents each score is 0.5, with one class only its smoothed share. An empty table
    gives no rows.
    """
    own = docs.select(F.col(id_col), F.col(text_col))
    model = train(own, labels, id_col, text_col)
    scored = score(own, model, text_col)
    return scored.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
