"""Personal data by bootstrapped contextual extraction.

Fixed forms (email, ip, card, phone) are the seeds. The words around a seed are its patterns. How often each pattern
occurs at all is counted over the whole corpus; patterns and instances then score each other over a graph held in
Spark: a pattern is as good as the instances in its place, an instance as good as its patterns. Other identifier-like
tokens in the place of good patterns are discovered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.llm.decontam import FILTER_BITS, seed_filter
from rhopool.llm.store import store
from rhopool.llm.words import chain, per_text, span_hashes, text_blocks, word_table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3          # of scoring
SUPPORT = 3         # distinct instances behind a pattern, at least
CONFIDENCE = 0.7    # of a pattern that discovers, and of what it discovers
SMOOTHING = 2.0
MIN_DIGITS = 4      # of a token that may be discovered, unless it has an @

# A match can only start where a run of its first class starts, or where the last match ended; so each is tried once.
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_FRESH, _EMAIL_AT = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL), re.compile(_EMAIL)
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DIGIT_RUNS = re.compile(r"(?<![0-9])[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGNAL = re.compile(r"[0-9@]")
_NUMERIC = "0123456789().-"
_EDGES = " \"'`()[]{}<>.,;:!?*#$%&|="

SPAN = "struct<kind:string,start:int,end:int>"
_FOUND = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("value", "long").add("patterns", T.ArrayType(T.LongType())).add("placed", "boolean"))
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64())), ("placed", pa.bool_())]))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text):
    at, n = 0, len(text)
    while at < n:
        m = _EMAIL_AT.match(text, at) if at else None
        m = m or _EMAIL_FRESH.search(text, at)
        if not m:
            return
        yield m.start(), m.end()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed forms, leftmost and non-overlapping within a kind, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _DIGIT_RUNS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def candidates(text: str, taken) -> list[tuple[int, int]]:
    """Spans of other tokens with an @ or enough digits that overlap none of the sorted spans ``taken``."""
    edges = np.array([[a, b] for a, _, b in taken]).reshape(-1, 2)
    out = []
    tokens: list[list[int]] = []
    joins = -1
    for m in _WORD.finditer(text):
        a, b = m.span()
        if not _SIGNAL.search(text, a, b):
            continue
        if a == joins + 1 and text[joins] == " " and not text[a:b].strip(_NUMERIC):
            tokens[-1][1] = b       # a number written in groups
        else:
            tokens.append([a, b])
        joins = b
    for a, b in tokens:
        token = text[a:b]
        core = token.strip(_EDGES)
        if "@" not in core and len(_NOT_DIGIT.sub("", core)) < MIN_DIGITS:
            continue
        a += len(token) - len(token.lstrip(_EDGES))
        b = a + len(core)
        if len(edges) and ((edges[:, 0] < b) & (edges[:, 1] > a)).any():
            continue
        out.append((a, b))
    return out


def contexts(words: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Pattern hashes at every word: its two words before; its neighbours. Text edges have a value of their own."""
    n = len(words)
    edge = np.uint64(0x1F83D9ABFB41BD6B)

    def shifted(k):
        out = np.full(n, edge)
        if k < 0:
            out[-k:] = np.where(doc[-k:] == doc[:k], words[:k], edge)
        elif k < n:
            out[:n - k] = np.where(doc[k:] == doc[:n - k], words[k:], edge)
        return out

    one, two, right = shifted(-1) if n > 1 else np.full(n, edge), shifted(-2) if n > 2 else np.full(n, edge), shifted(1)
    return np.stack([chain(np.full(n, np.uint64(2)), two, one), chain(np.full(n, np.uint64(3)), one, right)], axis=1)


def _scan(names):
    """Adds found: the base spans and candidates (null kind) of each text with value hash and patterns.

    The first span that starts in a word is placed there; so a place has one instance at most.
    """

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            n = len(offsets) - 1
            signs = (data >= 48) & (data <= 57) | (data == 64)
            marked = np.concatenate([[0], np.cumsum(signs)])
            some = np.flatnonzero(marked[offsets[1:]] > marked[offsets[:-1]])
            found: list[list] = [[] for _ in range(n)]
            if len(some):
                starts, ends, doc = word_table(data, offsets)
                words = span_hashes(data, starts, ends, lower=True)
                patterns = contexts(words, per_text(doc, n), doc).view(np.int64)
                raw = data.tobytes()
                for k in some.tolist():
                    text = raw[offsets[k]:offsets[k + 1]].decode("utf-8", "replace")
                    base = base_spans(text)
                    spans = [*((KINDS[kind], a, b) for a, kind, b in base), *((None, a, b) for a, b in candidates(text, base))]
                    if not spans:
                        continue
                    bytes_at = _byte_places(raw[offsets[k]:offsets[k + 1]]) + offsets[k]
                    filled = set()
                    for kind, a, b in spans:
                        w = np.searchsorted(starts, bytes_at[a], "right") - 1
                        value = span_hashes(data, np.array([bytes_at[a]]), np.array([bytes_at[b]]), lower=True).view(np.int64)[0]
                        found[k].append({"kind": kind, "start": a, "end": b, "value": int(value), "patterns": patterns[w].tolist() if w >= 0 else [], "placed": w not in filled})
                        filled.add(w)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, _FOUND_ARROW)], names)

    return run



def _byte_places(raw: bytes) -> np.ndarray:
    """The byte at which each code point starts, and the end."""
    data = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _occurrences(shared):
    """How often patterns that the filter lets through occur in a block, at any word."""

    def run(batches):
        bits = shared.value
        for _, data, offsets in text_blocks(batches):
            starts, ends, doc = word_table(data, offsets)
            p = contexts(span_hashes(data, starts, ends, lower=True), per_text(doc, len(offsets) - 1), doc).ravel()
            slot = (p & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
            p = p[(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) > 0]
            key, n = np.unique(p, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "n"])

    return run


def _discovered(scanned: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, kind, score) of the candidates that good patterns point at, and these patterns (pattern, kind)."""
    spark = docs.sparkSession
    mentions = scanned.select(F.explode("_pii_found").alias("f")).select("f.kind", "f.value", "f.placed", F.explode("f.patterns").alias("pattern"))
    edges = store(mentions.groupBy("kind", "value", "pattern").agg(F.count_if("placed").alias("places")), "edges")
    seeded = edges.where("kind is not null").groupBy("pattern").agg(F.countDistinct("value").alias("support")).where(F.col("support") >= SUPPORT).select("pattern")
    seeded = store(seeded, "patterns")
    shared = spark.sparkContext.broadcast(seed_filter(seeded.withColumnRenamed("pattern", "seed")))
    total = docs.select("text").mapInArrow(_occurrences(shared), "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    total = store(total.join(seeded, "pattern", "left_semi"), "totals")
    graph = store(edges.join(total, "pattern"), "graph")
    scores = graph.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    values = graph.where("kind is null").select("value", "pattern").distinct()
    placed = store(graph.groupBy("pattern", "value", "n").agg(F.sum("places").alias("places")), "placed")
    for _ in range(ROUNDS):
        # Places of instances over all places of the pattern, words that are no instance included; repeats count on both sides.
        scored = placed.join(scores, "value")
        confidence = scored.groupBy("pattern", "kind").agg((F.sum(F.col("score") * F.col("places")) / (F.first("n") + SMOOTHING)).alias("confidence"))
        confidence = store(confidence.withColumn("confidence", F.least("confidence", F.lit(0.999))), "confidence")
        new = (values.join(confidence, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")))
        known = scores.where("score = 1.0")
        scores = store(known.unionByName(new.join(known.select("value"), "value", "left_anti")), "scores")
    strong = confidence.where(F.col("confidence") >= CONFIDENCE)
    backed = values.join(strong, "pattern", "left_semi").select("value").distinct()
    best = F.max(F.struct("score", F.col("kind").alias("kind")))
    named = (scores.where((F.col("score") < 1.0) & (F.col("score") >= CONFIDENCE)).join(backed, "value", "left_semi")
            .groupBy("value").agg(best.alias("b")).select("value", "b.kind", "b.score"))
    return store(named, "named"), strong.select("pattern", "kind")


def extract(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (kind, start, end) by start, then kind as listed in KINDS.

    Places count code points, end exclusive. ``base`` holds the fixed forms; ``spans`` adds what contexts discover, at the
    places where a good pattern of that kind stands, not wherever the value occurs; it never drops or overlaps a base span. A null or empty text has none. Rows that repeat are each answered; columns of
    ``docs`` named base or spans are replaced. The texts are read twice: once for seeds and candidates, once to count
    how often the seeds' patterns occur at all.
    """
    kept = docs.drop("base", "spans", "_pii_found", "_pii_row").withColumn("_pii_row", F.monotonically_increasing_id())
    schema = T.StructType([*kept.schema.fields, T.StructField("_pii_found", _FOUND)])
    scanned = store(kept.mapInArrow(_scan(schema.names), schema), "scanned")
    kinds, strong = _discovered(scanned, docs)
    open_rows = F.exists("_pii_found", lambda f: f["kind"].isNull())
    named = (scanned.where(open_rows).select("_pii_row", F.explode("_pii_found").alias("f")).where("f.kind is null").select("_pii_row", "f.start", "f.end", "f.value", F.explode("f.patterns").alias("pattern"))
             .join(kinds, "value").join(strong, ["pattern", "kind"]).select("_pii_row", "kind", "start", "end").distinct().groupBy("_pii_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")))
    base = F.transform(F.filter("_pii_found", lambda f: f["kind"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    out = scanned.withColumn("base", base.cast(f"array<{SPAN}>"))
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(list(KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    joined = out.where(open_rows).join(named, "_pii_row", "left").withColumn(
        "spans", F.transform(F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))), rank)),
                             lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(f"array<{SPAN}>")).drop("more")
    return joined.unionByName(out.where(~open_rows).withColumn("spans", F.col("base"))).drop("_pii_found", "_pii_row")


def mask(extracted: DataFrame) -> DataFrame:
    """The rows of :func:`extract` with every span of ``text`` replaced by its kind in brackets; overlaps become one."""
    schema = extracted.schema

    def run(batches):
        for rows in batches:
            texts = rows.column("text").to_pylist()
            for k, (text, spans) in enumerate(zip(texts, rows.column("spans").to_pylist())):
                if not spans or text is None:
                    continue
                out, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        out += [text[at:s["start"]], f"[{s['kind']}]"]
                    at = max(at, s["end"])
                texts[k] = "".join(out) + text[at:]
            columns = [pa.array(texts, pa.string()) if n == "text" else rows.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return extracted.mapInArrow(run, schema)
