"""Toxicity by a lexicon read with typing errors, weighed in context.

Terms are learned from labelled texts and joined by seeds. They form a trie; a Levenshtein automaton of one edit
(longer terms) is intersected with it and made deterministic, so that all words of a block advance through one table.
Each hit is weighed by its surroundings: quotation and reporting words lower it, address and further hits raise it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.llm.sampling import labelled_sample
from rhopool.llm.store import store
from rhopool.llm.words import LOWER, per_text, span_hashes, text_blocks, word_table

SEEDS = ("idiot", "moron", "stupid", "pathetic", "scum", "loser", "worthless", "disgusting", "trash", "bastard")
REPORTING = ("said", "says", "wrote", "quote", "quoted", "quotes", "called", "calls", "term", "word", "phrase", "slur", "insult")
ADDRESS = ("you", "your", "you're", "youre", "u", "ur", "yourself")
TRAIN_ROWS = 20_000   # labelled texts read for fitting, at most about
LETTERS = 3_000       # of all learned terms together; what finds no room is counted in Model.left_out
MIN_TEXTS, MIN_LIFT = 5, 2.5  # toxic texts with a learned term, and its log ratio, at least: the same for any sample
WINDOW = 8            # words on each side
FUZZY_FROM = 5        # letters from which a whole-word term may differ by one edit
SEED_WEIGHT = 2.0
EDIT_WEIGHT, QUOTED, REPORTED, ADDRESSED, CROWDED = 0.6, 0.5, 0.7, 1.3, 1.2
PRIOR = np.array([-4.0, 3.0, 1.0, 1.0, 0.5, 0.0])  # bias and feature weights where labels can't teach them

_EDGE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Automaton:
    """Table of the deterministic product: next state by state and class of code point; per state the term it accepts and its edits."""

    step: np.ndarray
    classes: np.ndarray
    term: np.ndarray
    edits: np.ndarray

    @staticmethod
    def build(terms: list[tuple[str, bool]], fuzzy_from: int = FUZZY_FROM) -> Automaton:
        """``terms``: (word, open). An edit is one code point. An open term accepts every longer word that starts with it, and no edit."""
        children: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = {}
        reach = [0]
        for t, (word, is_open) in enumerate(terms):
            allowed = 1 if not is_open and len(word) >= fuzzy_from else 0
            node = 0
            reach[0] = max(reach[0], allowed)
            for b in map(ord, word):
                if b not in children[node]:
                    children.append({})
                    reach.append(0)
                    children[node][b] = len(children) - 1
                node = children[node][b]
                reach[node] = max(reach[node], allowed)
            ends.setdefault(node, []).append(t)
        letters = sorted({b for c in children for b in c})
        classes = np.zeros(0x200000, np.uint16)     # all that three bytes of continuation can spell
        classes[letters] = np.arange(1, len(letters) + 1)

        def close(states):
            """Adds deletions from the term, drops states that a cheaper one covers."""
            best: dict = {}
            todo = list(states)
            while todo:
                node, e = todo.pop()
                if e > (reach[node] if node >= 0 else 0) or best.get(node, 9) <= e:
                    continue
                best[node] = e
                if node >= 0:
                    todo += [(n, e + 1) for n in children[node].values()]
            return frozenset(best.items())

        def advance(state, b):
            out = []
            for node, e in state:
                if node < 0:          # inside an open term
                    out.append((node, e))
                    continue
                out += [(-1 - t, 0) for t in ends.get(node, ()) if terms[t][1] and e == 0]
                out.append((node, e + 1))
                for letter, n in children[node].items():
                    out.append((n, e + (letter != b)))
            return close(out)

        start = close([(0, 0)])
        number, order, table = {frozenset(): 0, start: 1}, [frozenset(), start], []
        for state in order:
            row = []
            for b in (-1, *letters):
                to = advance(state, b) if state else state
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            table.append(row)
        term, edits = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int8)
        for s, state in enumerate(order):
            found = [(0, -1 - n) for n, _ in state if n < 0]
            found += [(e, t) for n, e in state if n >= 0 for t in ends.get(n, ()) if not terms[t][1] and (e == 0 or len(terms[t][0]) >= fuzzy_from)]
            if found:
                edits[s], term[s] = min(found)
        return Automaton(np.array(table, np.int32), classes, term, edits)

    def run(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state after each span of lower-case code points, 0 where no term can follow any more."""
        state = np.ones(len(starts), np.int32)
        live, at = np.arange(len(starts)), starts.copy()
        while len(live):
            more = at < ends[live]
            live, at = live[more], at[more]
            state[live] = self.step[state[live], self.classes[points[at]]]
            going = state[live] > 0
            live, at = live[going], at[going] + 1
        return state


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case (A-Z) code points of UTF-8, and the number of those before each byte and the end; broken bytes give some code point."""
    lead = (data & 0xC0) != 0x80
    if len(data):
        lead[0] = True
    at = np.flatnonzero(lead)
    first = LOWER[data[at]].astype(np.uint32)
    more = np.select([first >= 0xF0, first >= 0xE0, first >= 0xC0], [3, 2, 1], 0)
    value = np.where(more > 0, first & (0x3F >> more), first)
    for k in (1, 2, 3):
        some = more >= k
        value[some] = (value[some] << 6) | (data[np.minimum(at[some] + k, len(data) - 1)] & 0x3F)
    return value & 0x1FFFFF, np.concatenate([[0], np.cumsum(lead)])


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray
    theta: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    left_out: int = 0


def cores(data, starts, ends):
    """Word spans without signs at either end; words of signs alone become empty."""
    starts, ends = starts.copy(), ends.copy()
    live = np.arange(len(starts))
    while len(live):
        live = live[ends[live] > starts[live]]
        live = live[_EDGE[data[ends[live] - 1]]]
        ends[live] -= 1
    live = np.arange(len(starts))
    while len(live):
        live = live[ends[live] > starts[live]]
        live = live[_EDGE[data[starts[live]]]]
        starts[live] += 1
    return starts, ends


def _hashes(words):
    data = np.frombuffer(b"".join(w.encode() for w in words), np.uint8)
    stop = np.cumsum([len(w.encode()) for w in words])
    return np.sort(span_hashes(data, np.append(0, stop[:-1]), stop))


_REPORTING, _ADDRESS = _hashes(REPORTING), _hashes(ADDRESS)


def features(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: 1, log summed weight, log largest weight, log distinct terms, log density, log inexact hits."""
    n = len(offsets) - 1
    out = np.zeros((n, 6))
    out[:, 0] = 1
    starts, ends, doc = word_table(data, offsets)
    if not len(starts):
        return out
    core_start, core_end = cores(data, starts, ends)
    points, number = code_points(data)
    state = model.automaton.run(points, number[core_start], number[core_end])
    term = model.automaton.term[state]
    hits = np.flatnonzero((term >= 0) & (core_end > core_start))
    if not len(hits):
        return out
    at = per_text(doc, n)
    edits = model.automaton.edits[state[hits]]
    weight = model.weights[term[hits]] * np.where(edits > 0, EDIT_WEIGHT, 1.0)
    lo, hi = np.maximum(hits - WINDOW, at[doc[hits]]), np.minimum(hits + WINDOW + 1, at[doc[hits] + 1])

    # Hashes of the words in any window, then their kinds counted within each window.
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, lo, 1)
    np.add.at(cover, hi, -1)
    near = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    h = _sparse_hashes(data, core_start[near], core_end[near])

    def within(flags):
        total = np.zeros(len(starts) + 1, np.int64)
        total[near + 1] = flags
        total = np.cumsum(total)
        return total[hi] - total[lo]

    is_hit = np.zeros(len(starts), bool)
    is_hit[hits] = True
    reported = within(np.isin(h, _REPORTING)) > 0
    addressed = within(np.isin(h, _ADDRESS)) > 0
    crowded = within(is_hit[near]) > 1
    weight = weight * np.where(_quoted(data, offsets, doc[hits], core_start[hits]), QUOTED, 1) * np.where(reported, REPORTED, 1)
    weight = weight * np.where(addressed, ADDRESSED, 1) * np.where(crowded, CROWDED, 1)
    d = doc[hits]
    total = np.bincount(d, weight, n)
    most = np.zeros(n)
    np.maximum.at(most, d, weight)
    distinct = np.bincount(np.unique(d.astype(np.int64) * len(model.weights) + term[hits]) // len(model.weights), minlength=n)
    words = np.maximum(np.diff(at), 1)
    out[:, 1], out[:, 2], out[:, 3] = np.log1p(total), np.log1p(most), np.log1p(distinct)
    out[:, 4], out[:, 5] = np.log1p(100 * total / words), np.log1p(np.bincount(d, edits > 0, n))
    return out


def _sparse_hashes(data, starts, ends):
    """Hashes of spans; an empty span has 0."""
    h = np.zeros(len(starts), np.uint64)
    some = ends > starts
    h[some] = span_hashes(data, starts[some], ends[some], lower=True)
    return h


def _quoted(data, offsets, doc, at):
    """Whether a place lies between quotation marks of its line: plain ones in pairs, or an opened one closed later.

    A mark without partner in its line quotes nothing.
    """
    fresh = np.zeros(len(data) + 1, np.int64)
    fresh[1:] += data == 0x0A
    fresh[offsets[1:-1]] += 1
    line = np.cumsum(fresh)[:-1]
    kind = np.zeros(len(data), np.int8)       # 1 plain, 2 opens, 3 closes
    kind[data == 0x22] = 1
    if len(data) > 2:
        e2 = (data[:-2] == 0xE2) & (data[1:-1] == 0x80)
        kind[:-2][e2 & (data[2:] == 0x9C)] = 2
        kind[:-2][e2 & (data[2:] == 0x9D)] = 3
        c2 = data[:-1] == 0xC2
        kind[:-1][c2 & (data[1:] == 0xAB)] = 2
        kind[:-1][c2 & (data[1:] == 0xBB)] = 3
    inside = np.zeros(len(data) + 1, np.int64)
    plain = np.flatnonzero(kind == 1)
    if len(plain) > 1:
        lines = line[plain]
        begin = np.searchsorted(lines, lines, "left")
        opens = (np.arange(len(plain)) - begin) % 2 == 0
        paired = np.flatnonzero(opens[:-1] & (lines[1:] == lines[:-1]))
        np.add.at(inside, plain[paired], 1)
        np.add.at(inside, plain[paired + 1], -1)
    marks = np.flatnonzero(kind > 1)
    if len(marks) > 1:
        # The last one opened before a closing mark belongs to it.
        paired = np.flatnonzero((kind[marks[:-1]] == 2) & (kind[marks[1:]] == 3) & (line[marks[:-1]] == line[marks[1:]]))
        np.add.at(inside, marks[paired], 1)
        np.add.at(inside, marks[paired + 1], -1)
    return np.cumsum(inside)[at] > 0


def _term_counts(batches):
    """Texts with each word, toxic and other, summed over a block."""
    for rows, data, offsets in text_blocks(batches):
        starts, ends, doc = word_table(data, offsets)
        starts, ends = cores(data, starts, ends)
        at, low, counts = per_text(doc, len(offsets) - 1), LOWER[data].tobytes(), {}
        for k, label in enumerate(rows.column("label").to_pylist()):
            for w in {low[a:b] for a, b in zip(starts[at[k]:at[k + 1]].tolist(), ends[at[k]:at[k + 1]].tolist())}:
                counts.setdefault(w, [0, 0])[label > 0] += 1
        counts.pop(b"", None)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
                                          pa.array([c[0] for c in counts.values()], pa.int64())], ["word", "toxic", "other"])


def learn_terms(sample: DataFrame, toxic: int, other: int, letters: int = LETTERS) -> tuple[list[tuple[str, bool, float]], int]:
    """(term, open, weight) of words, and stems of longer words, found far more often in toxic texts of (text, label); and how many found no room.

    A term needs MIN_TEXTS toxic texts and a log ratio of MIN_LIFT, whatever the size of the sample. Stems that a shorter
    stem as good stands for are left out first; the best of the others are taken as long as ``letters`` last. The
    counting and choosing is Spark's; no more terms than could have room reach the driver.
    """
    words = sample.select("text", "label").mapInArrow(_term_counts, "word string, toxic bigint, other bigint").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    stems = (words.where(F.length("word") > 4)
             .select(F.explode(F.expr("transform(sequence(4, least(10, length(word) - 1)), k -> substring(word, 1, k))")).alias("word"), "toxic", "other")
             .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).withColumn("open", F.lit(True)))
    lift = F.log(((F.col("toxic") + 0.5) / (F.col("other") + 0.5)) * F.lit((other + 1.0) / (toxic + 1.0)))
    found = (words.withColumn("open", F.lit(False)).where(F.length("word") >= 3).unionByName(stems).withColumn("weight", lift)
             .where((F.col("toxic") >= MIN_TEXTS) & (F.col("weight") >= MIN_LIFT)).withColumn("gain", F.col("toxic") * F.col("weight")))
    found = store(found, "terms")
    # A whole word stays beside its stem, which allows no edit.
    shorter = (found.where("open and length(word) > 4").select("word", "weight", "gain", F.explode(F.expr("transform(sequence(4, length(word) - 1), k -> substring(word, 1, k))")).alias("stem"))
               .join(found.where("open").select(F.col("word").alias("stem"), F.col("weight").alias("by"), F.col("gain").alias("of")), "stem")
               .where("by >= 0.7 * weight and of >= gain").select("word").distinct().withColumn("open", F.lit(True)))
    kept = store(found.join(shorter, ["word", "open"], "left_anti"), "terms")
    best = kept.where(F.length("word") <= letters).orderBy(F.desc("gain"), "word", "open").limit(max(1, letters // 3)).collect()
    out: list[tuple[str, bool, float]] = []
    for r in best:
        if len(r.word) <= letters:
            letters -= len(r.word)
            out.append((r.word, r.open, min(r.weight, 6.0)))
    return out, kept.count() - len(out)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic regression by Newton steps."""
    theta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * theta)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def _feature_rows(shared):
    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            f = features(shared.value, data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))], ["label", "f"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seeds=SEEDS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; about ``rows`` labelled texts are read at most.

    Without both kinds of label the seeds are the lexicon and the prior is the weighing.
    """
    spark = docs.sparkSession
    chosen = labelled_sample(labels, "toxic", rows)
    # At most about ``rows`` ids: small enough for every executor at any input size.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    of = {r.label > 0: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = of.get(True, 0), of.get(False, 0)
    learned, left_out = learn_terms(sample, toxic, other) if toxic and other else ([], 0)
    known = {t for t, o, _ in learned if not o}
    terms = [*learned, *((s, False, SEED_WEIGHT) for s in seeds if s not in known)]
    model = Model(Automaton.build([(t, o) for t, o, _ in terms]), np.array([w for *_, w in terms]), left_out=left_out)
    if toxic and other:
        shared = spark.sparkContext.broadcast(model)
        got = sample.mapInArrow(_feature_rows(shared), "label int, f array<double>").toArrow()
        x = np.array(got.column("f").to_pylist())
        model.theta = _logistic(x, got.column("label").to_numpy())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1, from the whole of ``text``; null and empty texts get the score of no hit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("toxicity")

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            z = np.clip(features(shared.value, data, offsets) @ shared.value.theta, -30, 30)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-z)))], [*rows.schema.names, "toxicity"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("toxicity", T.DoubleType())]))
