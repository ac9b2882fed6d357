"""Quality rules: document statistics, two fixed rules, and gradient-boosted trees with monotonic constraints.

Trees are full binary trees in numpy arrays, so that a block of documents descends all of them level by level.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.llm.sampling import labelled_sample
from rhopool.llm.words import text_blocks

MIN_WORDS, MAX_REPEATED = 50, 50   # words; percent of words in repeated windows
TRAIN_ROWS = 20_000                # labelled texts read for fitting, at most about
TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 80, 4, 48, 0.15, 20, 1.0
KEEP = 0.4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and the direction in which they may move the score: 1 up, -1 down, 0 free.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols": -1, "duplicate_lines": -1, "repeated_words": -1, "upper": 0, "digits": 0, "marks": 0,
            "distinct_words": 0, "common_word": -1, "line_words": 0, "ended_lines": 0, "pipes": -1, "beyond_ascii": 0}

_SYMBOLS = b"#*$%&|<>"
_NO_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_UPPER, _DIGITS, _MARKS = (bytes(set(range(256)) - set(x)) for x in (bytes(range(65, 91)), b"0123456789", b".,;:!?\"'()-"))
_CONTINUED = bytes(range(0x80, 0xC0))


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of FEATURES of one UTF-8 text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUED))
    symbols = len(text.translate(None, _NO_SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    duplicate = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        times = Counter(windows)
        if len(times) < len(windows):
            again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            covered[:-2] |= again
            covered[1:-1] |= again
            covered[2:] |= again
            repeated = int(covered.sum())
    kinds = Counter(words)
    per = max(n, 1)
    bytes_in = max(len(joined), 1)
    features = [np.log1p(n), chars / per, symbols / max(chars, 1), duplicate / max(len(lines), 1), repeated / per, len(joined.translate(None, _UPPER)) / bytes_in,
                len(joined.translate(None, _DIGITS)) / bytes_in, len(joined.translate(None, _MARKS)) / bytes_in, len(kinds) / per,
                max(kinds.values(), default=0) / per, n / max(len(lines), 1), sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / max(len(lines), 1),
                kinds.get(b"|", 0) / per, len(joined.translate(None, bytes(range(128)))) / bytes_in]
    return [n, chars, symbols, duplicate, repeated], features


def block_statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    rows = [statistics(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS)), np.array([r[1] for r in rows]).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """Full trees of equal depth: node k has children 2k + 1 and 2k + 2; a row goes right where its feature exceeds the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _best_split(binned, rows, g, h, low, high, direction):
    """(gain, feature, bin) of the best split of ``rows`` whose leaves keep the order that the feature asks for."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        gl, hl = np.cumsum(np.bincount(b, g[rows], BINS))[:-1], np.cumsum(np.bincount(b, h[rows], BINS))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
        gr, hr = total_g - gl, total_h - hl
        left, right = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-gr / (hr + RIDGE), low, high)
        gain = -(gl * left + 0.5 * (hl + RIDGE) * left ** 2 + gr * right + 0.5 * (hr + RIDGE) * right ** 2)
        whole = np.clip(-total_g / (total_h + RIDGE), low, high)
        gain += total_g * whole + 0.5 * (total_h + RIDGE) * whole ** 2
        gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
        if direction[f]:
            gain[direction[f] * (right - left) < 0] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    return best


def boost(x: np.ndarray, y: np.ndarray, direction=tuple(FEATURES.values())) -> Trees:
    """Logistic boosting. Below a split on a constrained feature both sides keep to their half of the value range, which
    makes every tree, and so their sum, monotonic in it."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    margin = np.full(len(y), bias)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        todo = [(0, np.arange(len(y)), -np.inf, np.inf)]
        while todo:
            node, rows, low, high = todo.pop()
            if node >= inner:
                value = RATE * np.clip(-g[rows].sum() / (h[rows].sum() + RIDGE), low, high) if len(rows) else 0.0
                leaf[t, node - inner] = value
                margin[rows] += value
                continue
            _, f, k = _best_split(binned, rows, g, h, low, high, direction) if len(rows) >= 2 * LEAF else (0, None, None)
            if f is None:
                todo.append((2 * node + 1, rows, low, high))
                todo.append((2 * node + 2, rows[:0], low, high))
                continue
            feature[t, node], cut[t, node] = f, edges[f][k]
            side = binned[rows, f] <= k
            left, right = rows[side], rows[~side]
            bounds = [(low, high), (low, high)]
            if direction[f]:
                ends = [np.clip(-g[r].sum() / (h[r].sum() + RIDGE), low, high) for r in (left, right)]
                middle = sum(ends) / 2
                bounds = [(low, middle), (middle, high)] if direction[f] > 0 else [(middle, high), (low, middle)]
            todo.append((2 * node + 1, left, *bounds[0]))
            todo.append((2 * node + 2, right, *bounds[1]))
    return Trees(feature, cut, leaf, bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from about ``rows`` labelled texts at most (``labels(doc_id, quality)``); None where labels can't teach any."""
    chosen = labelled_sample(labels, "quality", rows)

    def features(batches):
        for part, data, offsets in text_blocks(batches):
            f = block_statistics(data, offsets)[1]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))], ["label", "f"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(features, "label int, f array<double>").toArrow()
    y = (got.column("label").to_numpy() > 0).astype(int)
    if not len(y) or y.min() == y.max():
        return None
    return boost(got.column("f").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES)), y)


def apply_rules(docs: DataFrame, trees: Trees | None, keep: float = KEEP) -> DataFrame:
    """``docs`` with the counts, base_failed, rule_score and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. rule_score is the trees'
    probability of label 1 (null without trees, and then only base_failed decides). A null text is an empty text.
    """
    names = [*COUNTS, "base_failed", "rule_score", "kept"]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("base_failed", T.BooleanType()),
                           T.StructField("rule_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        for rows, data, offsets in text_blocks(batches):
            counts, features = block_statistics(data, offsets)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])
            score = model.probability(features) if model else np.ones(len(failed))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score, mask=np.full(len(score), model is None)),
                                              pa.array(~failed & (score >= keep))], schema.names)

    return kept.mapInArrow(run, schema)
