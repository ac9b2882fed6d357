"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated output.

Every word has a sparse random index vector drawn from its hash; the vector of a word bucket is the sum of the index
vectors met around it in the whole corpus. A document is the mean and the spread of its words' vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.llm.sampling import labelled_sample
from rhopool.llm.words import mix, per_text, span_hashes, text_blocks, word_table

BUCKETS, DIMS = 1 << 13, 32   # the vectors are 1 MiB at any corpus size
NONZERO = 2
TRAIN_ROWS = 20_000           # labelled texts read for fitting, at most about
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = ord("A"), ord("0")
_CLASS[[*range(97, 123), *range(128, 256)]] = ord("a")


def streams(data: np.ndarray, offsets: np.ndarray):
    """Hashes of each word and of its shape (runs of equal character classes), and each text's offsets among them."""
    starts, ends, doc = word_table(data, offsets)
    kinds = _CLASS[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[starts] = True
    count = np.concatenate([[0], np.cumsum(turn)])
    inside = kinds[turn]
    words = span_hashes(data, starts, ends, lower=True)
    return words, span_hashes(inside, count[starts], count[ends]), per_text(doc, len(offsets) - 1), doc


def _bucket(h):
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def _indexed(total, target, context):
    """Adds the index vectors of ``context`` hashes to the rows of ``target`` buckets."""
    h = mix(context)
    for k in range(NONZERO):
        place = ((h >> np.uint64(8 * k)) & np.uint64(DIMS - 1)).astype(np.int64)
        sign = ((h >> np.uint64(40 + k)) & np.uint64(1)).astype(np.float64) * 2 - 1
        total += np.bincount(target * DIMS + place, sign, BUCKETS * DIMS)


def _context_sums(batches):
    """One row for each bucket met in this task: the sum of index vectors around it."""
    total = np.zeros(BUCKETS * DIMS)
    for _, data, offsets in text_blocks(batches):
        words, shapes, _, doc = streams(data, offsets)
        same = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
        w, s = _bucket(words), _bucket(shapes)
        for here, there in ((same, same + 1), (same + 1, same)):
            _indexed(total, w[here], words[there])
            _indexed(total, w[here], shapes[there])
            _indexed(total, s[here], shapes[there])
    total = total.reshape(BUCKETS, DIMS)
    met = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(total[met, d]) for d in range(DIMS))], ["bucket", *(f"v{d}" for d in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets from the neighbours in every text."""
    names = [f"v{d}" for d in range(DIMS)]
    sums = docs.select("text").mapInArrow(_context_sums, "bucket bigint, " + ", ".join(f"{n} double" for n in names))
    got = sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((BUCKETS, DIMS), np.float32)
    out[got.column("bucket").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], axis=1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: mean and spread of word and of shape vectors, the means' lengths, how alike a word's vector is
    to the next one's and to the one after (mean), log words. Empty texts have zeros."""
    words, shapes, at, doc = streams(data, offsets)
    n = np.maximum(np.diff(at), 1)[:, None].astype(np.float64)
    filled = np.flatnonzero(np.diff(at))
    parts = []
    for h in (words, shapes):
        mean = np.zeros((len(at) - 1, DIMS))
        square = np.zeros((len(at) - 1, DIMS))
        if len(h):
            v = vectors[_bucket(h)]
            mean[filled] = np.add.reduceat(v, at[filled], axis=0)
            square[filled] = np.add.reduceat(v * v, at[filled], axis=0)
            for lag in (1, 2):
                alike = np.zeros(len(h))
                alike[lag:] = np.where(doc[lag:] == doc[:-lag], np.einsum("ij,ij->i", v[lag:], v[:-lag]), 0)
                near = np.zeros(len(at) - 1)
                near[filled] = np.add.reduceat(alike, at[filled])
                parts.append(near[:, None] / n)
        else:
            parts.append(np.zeros((len(at) - 1, 2)))
        mean, square = mean / n, square / n
        parts += [mean, np.sqrt(np.maximum(square - mean ** 2, 0)), np.linalg.norm(mean, axis=1, keepdims=True)]
    return np.concatenate([*parts, np.log1p(np.diff(at))[:, None]], axis=1)


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on four fifths of the rows; the temperature that suits the last fifth best."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x, y = x[order], y[order].astype(np.float64)
    cut = max(1, len(x) * 4 // 5)
    mean, scale = x[:cut].mean(axis=0), x[:cut].std(axis=0)
    net = Network(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    z = (x[:cut] - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(cut)
        for a in range(0, cut, 256):
            rows = mixed[a:a + 256]
            w1, b1, w2, b2 = params
            hidden = np.maximum(z[rows] @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -30, 30)))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, w2) * (hidden > 0)
            grads = [z[rows].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ g + DECAY * w2, np.array([g.sum()])]
            step += 1
            for k, d in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                params[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if cut < len(x):
        logit = net.logit(x[cut:])
        grid = np.geomspace(0.25, 8, 61)
        net.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -np.where(y[cut:] > 0, 1, -1) * logit / t).mean()))
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """A broadcast (vectors, network): vectors from all of ``docs(doc_id, text)``, the network from about ``rows`` labelled
    texts at most (``labels(doc_id, quality)``). With no labels every score is 0.5; with one kind it is that kind's share."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    chosen = labelled_sample(labels, "quality", rows)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches):
        for part, data, offsets in text_blocks(batches):
            f = pooled(shared.value, data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))], ["label", "f"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(features, "label int, f array<double>").toArrow()
    y = (got.column("label").to_numpy() > 0).astype(int)
    width = pooled(vectors, np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    if len(y) and y.min() < y.max():
        net = train_network(got.column("f").combine_chunks().flatten().to_numpy().reshape(len(y), width), y)
    else:
        share = (y.sum() + 1) / (len(y) + 2)
        net = Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    return spark.sparkContext.broadcast((vectors, net))


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` with ``quality_score``, the probability of label 1, from the whole ``text``; a null text is empty."""
    kept = docs.drop("quality_score")

    def run(batches):
        vectors, net = model.value
        for rows, data, offsets in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(net.probability(pooled(vectors, data, offsets)))], [*rows.schema.names, "quality_score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("quality_score", T.DoubleType())]))
