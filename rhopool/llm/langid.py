"""Language identification by a convolutional network over bytes.

A text is cut into windows of fixed length. Filters of several widths slide over each window; the weights of a filter
for the byte at one of its places are a row of a table, so a convolution is a sum of table rows. The largest response
of each filter in the window goes to a softmax layer. The windows of a text vote by their mean logits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.llm.sampling import STEPS
from rhopool.llm.words import LOWER, text_blocks

WINDOW = 192                 # bytes of a window; neighbours share WIDTHS[-1] - 1 of them, so each place of a filter is seen once
WIDTHS, FILTERS = (2, 3, 4), 16
TRAIN_ROWS = 6_000           # labelled texts read for fitting, at most about, shared evenly by the languages
TRAIN_WINDOWS = 4            # windows of each, spread over the whole text
EPOCHS, BATCH, RATE = 3, 64, 0.01
LEAST_STEPS = 300            # few windows are passed through more often
AT_ONCE = 256                # windows scored together
NONE = "und"                 # null texts and texts without a letter

#: What the filters see of a byte: small letters, one digit, one gap; 0 is past the end of the text.
SEEN = LOWER.copy()
SEEN[[*range(48, 58)]] = 48
SEEN[[0, *range(9, 14)]] = 32

_SLOTS = [(w, k) for w in WIDTHS for k in range(w)]
STRIDE = WINDOW - WIDTHS[-1] + 1


def windows(data: np.ndarray, offsets: np.ndarray):
    """(text number, bytes) of every window; a text's last one is filled up with 0. An empty text has none."""
    sizes = np.diff(offsets)
    count = np.where(sizes > 0, 1 + np.maximum(sizes - WINDOW + STRIDE - 1, 0) // STRIDE, 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    begin = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, begin


def cut(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The seen bytes from each of ``begin`` on, a row of WINDOW each; what lies at ``stop`` or beyond is 0."""
    place = begin[:, None] + np.arange(WINDOW)
    inside = place < stop[:, None]
    return np.where(inside, SEEN[data[np.minimum(place, len(data) - 1)]], 0).astype(np.uint8)


@dataclass
class Network:
    """``table``: for each byte the weights of every place of every filter; ``dense`` and ``bias`` of the softmax layer."""

    langs: list
    table: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest response of each filter in every window, and where it is."""
        rows = self.table[x]                                   # windows, bytes, slots * FILTERS
        best, where, slot = [], [], 0
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            out = rows[:, :n, slot * FILTERS:(slot + 1) * FILTERS].copy()
            for k in range(1, w):
                out += rows[:, k:k + n, (slot + k) * FILTERS:(slot + k + 1) * FILTERS]
            slot += w
            if places:
                where.append(out.argmax(axis=1))
            best.append(out.max(axis=1))
        return (np.concatenate(best, axis=1), where) if places else np.concatenate(best, axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.pooled(x)) @ self.dense + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list, seed: int = 13) -> Network:
    """Adam on the cross-entropy of windows; only the place of a filter's largest response gets its gradient."""
    rng = np.random.default_rng(seed)
    width = FILTERS * len(_SLOTS)
    table = rng.normal(0, 0.3, (256, width)).astype(np.float32)
    net = Network(langs, table, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [net.table, net.dense, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    each = -(-len(x) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each)) if len(x) else 0
    step, steps = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            some = order[a:a + BATCH]
            part = x[some]
            best, where = net.pooled(part, places=True)
            hidden = np.tanh(best)
            g = softmax(hidden @ net.dense + net.bias)
            g[np.arange(len(some)), y[some]] -= 1
            g /= len(some)
            back = (g @ net.dense.T) * (1 - hidden ** 2)
            d_table, slot = np.zeros(256 * width), 0
            for i, w in enumerate(WIDTHS):
                own = back[:, i * FILTERS:(i + 1) * FILTERS].ravel()
                for k in range(w):
                    seen = np.take_along_axis(part, where[i] + k, axis=1).astype(np.int64)
                    cell = seen * width + (slot + k) * FILTERS + np.arange(FILTERS)
                    d_table += np.bincount(cell.ravel(), own, 256 * width)
                slot += w
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for p, d, m, v in zip(params, (d_table.reshape(256, width), hidden.T @ g + 1e-4 * net.dense, g.sum(axis=0)), first, second):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def _training_windows(batches):
    """TRAIN_WINDOWS of each text at most, at even distances over the whole text."""
    for rows, data, offsets in text_blocks(batches):
        doc, begin = windows(data, offsets)
        count = np.bincount(doc, minlength=len(offsets) - 1)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        n = count[doc]
        chosen = (number * TRAIN_WINDOWS // n) != ((number - 1) * TRAIN_WINDOWS // n)
        doc, begin = doc[chosen], begin[chosen]
        x = cut(data, begin, offsets[doc + 1]) if len(doc) else np.zeros((0, WINDOW), np.uint8)
        yield pa.RecordBatch.from_arrays([rows.column("lang").take(pa.array(doc)), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "bytes"])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS):
    """A broadcast network from ``docs(doc_id, text, lang)`` (None if no text has a language and a letter).

    About ``rows`` texts at most are read, each language with the same number if it has as many; the choice goes by a
    hash of the id. The number of languages is taken to be small (they are model outputs).
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = spark.createDataFrame([(lang, min(STEPS, STEPS * rows // (len(langs) * n))) for lang, n in counts.items()], "lang string, keep bigint")
    # One row for each language: small at any input size.
    sample = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < F.col("keep"))
    got = sample.select("text", "lang").mapInArrow(_training_windows, "lang string, bytes binary").toArrow()
    if not len(got):
        return spark.sparkContext.broadcast(train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), langs))
    x = np.stack([np.frombuffer(b.as_buffer(), np.uint8) for b in got.column("bytes")])
    number = {lang: k for k, lang in enumerate(langs)}
    y = np.array([number[lang] for lang in got.column("lang").to_pylist()])
    # Tasks end in any order; the same rows must give the same network.
    order = np.lexsort((*x.T[::-1], y))
    return spark.sparkContext.broadcast(train(x[order], y[order], langs))


def predict(docs: DataFrame, model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1) from all windows of the whole ``text``.

    A null text and one without a letter is 'und' with score 1; so is every text with score 0 if there is no model.
    Repeated rows are each answered; columns of these names are replaced.
    """
    kept = docs.drop("lang_pred", "lang_score", "_lettered")
    if model is None:
        return kept.withColumns({"lang_pred": F.lit(NONE), "lang_score": F.when(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), 0.0).otherwise(1.0)})
    marked = kept.withColumn("_lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = kept.columns

    def run(batches):
        net = model.value
        for rows, data, offsets in text_blocks(batches):
            doc, begin = windows(data, offsets)
            votes = np.zeros((len(offsets) - 1, len(net.langs)))
            for a in range(0, len(doc), AT_ONCE):
                d = doc[a:a + AT_ONCE]
                np.add.at(votes, d, net.logits(cut(data, begin[a:a + AT_ONCE], offsets[d + 1])))
            p = softmax(votes / np.maximum(np.bincount(doc, minlength=len(votes)), 1)[:, None])
            lettered = np.array(rows.column("_lettered").to_pylist(), bool)
            said = [net.langs[k] if yes else NONE for k, yes in zip(p.argmax(axis=1).tolist(), lettered.tolist())]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(said, pa.string()), pa.array(np.where(lettered, p.max(axis=1), 1.0))], [*names, "lang_pred", "lang_score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return marked.mapInArrow(run, schema)
