"""Bigram scoring from a log-frequency Bloom filter.

Spark counts the n-grams of all training texts. An n-gram of count c enters the filter at levels 1 to q(c), where q is
logarithmic; probing level after level until one is missing gives the quantised count back. The filter is cut into
blocks that are built where their n-grams meet; it grows with the n-grams, and every count enters. It stays cut by
ranges of hashes: the n-grams of the scored texts are sent to their range, probed there, and their levels sent back.
A caller who knows that it is small may have it broadcast; both ways probe the same bits and give the same scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.llm.packing import pack, unpack
from rhopool.llm.store import store
from rhopool.llm.words import chain, mix, per_text, span_hashes, text_blocks, word_table

END = np.uint64(0xE7D1_5A2C_93B4_6F01)  # the hash that stands for the end of a text, and for what precedes its first word
BASE = 1.5           # ratio of neighbouring levels
PROBES = 4           # bits of an entry
FILL = 0.3           # share of bits set, at most about
BLOCK_BITS = 16
IDENTITY = ~np.uint64(0xFFFF)  # the bits of its hash that an n-gram of the filter is known by: 48
SHARD_BITS = 1 << 23  # 1 MiB of the filter, at most about, are probed at once
STREAM = 1 << 21     # tokens, at least, whose distinct n-grams are sent to the shards together, but for the last of a task
SHARE = 64           # one bigram in so many is counted beforehand, to size the filter
PRIOR, POWER = 3.0, 0.75  # the unigram estimate weighs PRIOR * (context count + 1) ** POWER counts: new words follow frequent ones too
HEAD = 1 << 19       # words whose exact counts every task holds (8 MiB); the others are counted by a join
CHUNK = 1 << 22      # tokens gathered before their counts leave a task
RANGE_KEYS = 1 << 20  # bigram tokens for each range of hashes that is built at once, on average


def level(count):
    """The level of a count of at least 1."""
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


_top = 120
#: The mean of the counts that share a level.
VALUE = np.concatenate([[0.0], [np.mean([max(np.ceil(BASE ** q - 1e-9), 1), max(np.ceil(BASE ** (q + 1) - 1e-9) - 1, np.ceil(BASE ** q - 1e-9), 1)]) for q in range(_top)]])


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the words of all texts, an end after each text, and the offsets of the texts among them."""
    starts, ends, doc = word_table(data, offsets)
    at = per_text(doc, len(offsets) - 1)
    h = np.insert(span_hashes(data, starts, ends, lower=True), at[1:], END)
    return h, at + np.arange(len(at))


def pairs(h: np.ndarray) -> np.ndarray:
    """The bigram that ends at each token."""
    return chain(np.concatenate([[END], h[:-1]]), h)


def _rows(order, key, n):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), order, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["order", "key", "n"])


def _chunks(batches, *views):
    """Sorted distinct values and counts of each view of the tokens, for about CHUNK tokens at a time."""
    held, size = [[] for _ in views], 0
    for _, data, offsets in text_blocks(batches):
        h, _ = tokens(data, offsets)
        for k, view in enumerate(views):
            held[k].append(np.unique(view(h), return_counts=True))
        size += len(h)
        if size >= CHUNK:
            yield [_merged(x) for x in held]
            held, size = [[] for _ in views], 0
    if size:
        yield [_merged(x) for x in held]


def _merged(parts):
    """One sorted (keys, counts) from several."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches):
    """All unigrams, and the bigrams of one share of the hashes."""
    for one, two in _chunks(batches, lambda h: h, lambda h: (p := pairs(h))[p % np.uint64(SHARE) == 0]):
        yield _rows(1, *one)
        yield _rows(2, *two)


def _grams(ranges):
    """Uni- and bigrams of each chunk, packed: a row for each range of hashes, with key differences and counts."""
    shift = np.uint64(64 - int(ranges).bit_length() + 1)

    def run(batches):
        for one, two in _chunks(batches, lambda h: h & IDENTITY, lambda h: pairs(h) & IDENTITY):
            keys, n = _merged([one, two])
            at = np.searchsorted(keys >> shift, np.arange(ranges + 1, dtype=np.uint64)) if ranges > 1 else np.array([0, len(keys)])
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([
                pa.array(some), pa.array([pack(np.diff(keys[at[r]:at[r + 1]], prepend=np.uint64(0))) for r in some], pa.binary()),
                pa.array([pack(n[at[r]:at[r + 1]].astype(np.uint32)) for r in some], pa.binary())], ["range", "keys", "counts"])

    return run


def _places(keys: np.ndarray, q, blocks: int):
    """Byte at which the key's line of 64 bytes starts, and the bits of every probe in it: rows of PROBES."""
    shift = np.uint64(64 - int(blocks).bit_length() + 1)
    block = keys >> shift if blocks > 1 else np.zeros(len(keys), np.uint64)
    line = (block << np.uint64(BLOCK_BITS - 3)) + (((keys >> np.uint64(16)) & np.uint64((1 << (BLOCK_BITS - 9)) - 1)) << np.uint64(6))
    return line.astype(np.int64), mix(keys + np.asarray(q, np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _probe(line, spread, k):
    """Byte number and bit of the k-th probe."""
    bit = (spread >> np.uint64(9 * k)) & np.uint64(511)
    return line + (bit >> np.uint64(3)).astype(np.int64), (bit & np.uint64(7)).astype(np.uint8)


def _build(blocks, ranges, fine, least):
    """``ranges`` parts of the filter from packed rows sorted by their fine range; one fine range is held at a time."""
    each = (blocks // ranges) << (BLOCK_BITS - 3)

    def put(bits, number, parts):
        keys, n = _merged(parts)
        keys, n = keys[n >= least], n[n >= least]
        q = level(n) if len(n) else n
        while len(keys):
            line, spread = _places(keys, q, blocks)
            for k in range(PROBES):
                byte, bit = _probe(line, spread, k)
                np.bitwise_or.at(bits, byte - number * each, np.uint8(1) << bit)
            q = q - 1
            keys, q = keys[q > 0], q[q > 0]

    def done(number, bits):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["range", "bits"])

    def run(batches):
        current, number, bits, parts = None, None, None, []
        for rows in batches:
            for here, keys, n in zip(*(rows.column(c).to_pylist() for c in ("range", "keys", "counts"))):
                if here != current:
                    if parts:
                        put(bits, number, parts)
                    current, parts = here, []
                    if here // (fine // ranges) != number:
                        if number is not None:
                            yield done(number, bits)
                        number, bits = here // (fine // ranges), np.zeros(each, np.uint8)
                parts.append((np.cumsum(unpack(keys, np.uint64), dtype=np.uint64), unpack(n, np.uint32)))
        if parts:
            put(bits, number, parts)
            yield done(number, bits)

    return run


def _levels(bits: np.ndarray, blocks: int, keys: np.ndarray, begin: int = 0) -> np.ndarray:
    """The highest level of each key, by probing one level after the other; ``bits`` are the filter from byte ``begin``."""
    q = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live) and q[live[0]] < _top - 1:
        line, spread = _places(keys[live], q[live] + 1, blocks)
        for k in range(PROBES):
            byte, bit = _probe(line - begin, spread, k)
            hit = np.flatnonzero((bits[byte] >> bit) & 1)
            live, line, spread = live[hit], line[hit], spread[hit]
        q[live] += 1
    return q


@dataclass
class Model:
    """What a task needs: the filter (no bytes if it is kept in shards), the totals, and exact counts of the most frequent words."""

    bits: np.ndarray
    blocks: int
    least: int
    total: int
    distinct: int
    head_keys: np.ndarray
    head_counts: np.ndarray

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Estimated counts from the broadcast filter."""
        return VALUE[_levels(self.bits, self.blocks, keys & IDENTITY)]

    def log_probability(self, c: np.ndarray, both: np.ndarray, end: float) -> np.ndarray:
        """log10 P(token | token before) from estimated counts of each token, of the bigram that ends there, and of an end."""
        before = np.concatenate([[end], c[:-1]])
        one = (c + 1) / (self.total + self.distinct + 1)
        prior = PRIOR * (before + 1) ** POWER
        return np.log10((np.minimum(both, np.minimum(before, c)) + prior * one) / (before + prior))


@dataclass
class Fitted:
    """The broadcast model, the stored exact unigram counts (key, n), and a filter kept in shards: its parts (range, bits)."""

    shared: object
    words: DataFrame
    parts: DataFrame | None = None
    ranges: int = 1

    def __iter__(self):
        return iter((self.shared, self.words))


def fit(train: DataFrame, max_bits: int | None = None, head: int = HEAD, broadcast_bits: int = 0) -> Fitted:
    """The model of ``train(text)``; unpacked it gives the model and the stored exact unigram counts (key, n).

    A filter of up to ``broadcast_bits`` is broadcast, a larger one is kept in shards. Every n-gram enters, unless the caller bounds the filter by
    ``max_bits``: then the least count that enters is raised. Null texts are empty texts. An empty table gives a model of
    0 tokens.
    """
    spark = train.sparkSession
    train = train.select("text")
    counts = store(train.mapInArrow(_count, "order int, key bigint, n bigint").groupBy("order", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("order = 1").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log("n") / F.lit(float(np.log(BASE))) + 1e-9) + 1
    seen = counts.groupBy("order", step.cast("int").alias("q")).agg(F.count("*").alias("grams"), F.min("n").alias("least")).collect()
    least, bits = 1, 1 << BLOCK_BITS
    for q in range(1, _top):
        kept = [r for r in seen if r.q >= q]
        entries = sum(r.q * r.grams * (SHARE if r.order == 2 else 1) for r in kept)
        bits = 1 << max(BLOCK_BITS, int(np.ceil(np.log2(max(1, entries * PROBES / FILL)))))
        least = min((r.least for r in kept), default=1) if q > 1 else 1
        if max_bits is None or bits <= max_bits:
            break
        bits = max_bits
    blocks = bits >> BLOCK_BITS
    fine = 1 << max(0, int(np.ceil(np.log2(max(1, 2 * int(total) / RANGE_KEYS)))))
    ranges = min(blocks, max(fine, bits // SHARD_BITS) if bits > broadcast_bits else fine)
    fine = max(fine, ranges)
    made = (train.mapInArrow(_grams(fine), "range bigint, keys binary, counts binary").repartition(ranges, (F.col("range") / (fine // ranges)).cast("bigint"))
            .sortWithinPartitions("range").mapInArrow(_build(blocks, ranges, fine, least), "range bigint, bits binary"))
    parts, filled = None, np.zeros((1, 0), np.uint8)
    if bits > broadcast_bits:
        parts = store(made, "filter")
    else:
        made = made.toArrow()
        filled = np.zeros((ranges, bits // 8 // ranges), np.uint8)
        for number, raw in zip(made.column("range").to_pylist(), made.column("bits")):
            filled[number] = np.frombuffer(raw.as_buffer(), np.uint8)
    # The words of the highest levels, as many whole levels as fit.
    kept, least_level = 0, _top
    for r in sorted((r for r in seen if r.order == 1), key=lambda r: -r.q):
        if kept + r.grams > head:
            break
        kept, least_level = kept + r.grams, r.q
    top = words.where(step >= least_level).toArrow()
    keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    model = Model(filled.ravel(), blocks, least, int(total), int(distinct), keys[order], n[order])
    return Fitted(spark.sparkContext.broadcast(model), words, parts, ranges)


def _scored(m: Model, row, doc_id, words, place, at, word_counts, pair_counts) -> pa.RecordBatch:
    """Texts of the tokens ``words[place]`` from each of ``at`` to the next: their scores, and the words that have no count in the task."""
    one = np.log10(m.total + m.distinct + 1)
    end = word_counts[words == END]
    score = np.add.reduceat(m.log_probability(word_counts[place], pair_counts, float(end[0]) if len(end) else 0.0), at[:-1])
    spot = np.searchsorted(m.head_keys, words).clip(max=max(len(m.head_keys) - 1, 0))
    known = (m.head_keys[spot] == words) if len(m.head_keys) else np.zeros(len(words), bool)
    n = np.where(known, m.head_counts[spot], 0) if len(m.head_keys) else np.zeros(len(words), np.int64)
    base = np.add.reduceat((np.where(known, np.log10(n + 1), 0.0) - one)[place], at[:-1])
    known = known[place]
    rest = np.flatnonzero(~known)
    stops = np.searchsorted(rest, at).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [row, doc_id, pa.array(np.diff(at)), pa.array(np.add.reduceat(known.astype(np.int64), at[:-1])), pa.array(base), pa.array(score),
         pa.ListArray.from_arrays(pa.array(stops), pa.array(words[place[rest]].view(np.int64)))],
        ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])


def _score(shared):
    def run(batches):
        m = shared.value
        for rows, data, offsets in text_blocks(batches):
            h, at = tokens(data, offsets)
            words, place = np.unique(h, return_inverse=True)
            two, which = np.unique(pairs(h), return_inverse=True)
            yield _scored(m, rows.column("row"), rows.column("doc_id"), words, place, at, m.count(words), m.count(two)[which])

    return run


_STREAM = "chunk bigint, row array<bigint>, doc_id array<bigint>, sizes binary, words binary, places binary"


def _streams(batches):
    """The tokens of about STREAM at a time as one row: the ids and sizes of the texts, distinct words from the most frequent on, and each token's place among them."""
    held, size = [], 0

    def made():
        row, ids, h, sizes = zip(*held)
        words, places, n = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        row, ids = pa.concat_arrays(row), pa.concat_arrays(ids)
        of = pa.array([0, len(row)], pa.int32())
        packed = (pack(np.concatenate(sizes).astype(np.int64)), pack(words[order]), pack(rank[places]))
        return pa.RecordBatch.from_arrays([row[:1], pa.ListArray.from_arrays(of, row), pa.ListArray.from_arrays(of, ids), *(pa.array([x], pa.binary()) for x in packed)],
                                          [x.split()[0] for x in _STREAM.split(", ")])

    for rows, data, offsets in text_blocks(batches):
        h, at = tokens(data, offsets)
        held.append((rows.column("row"), rows.column("doc_id"), h, np.diff(at)))
        size += len(h)
        if size >= STREAM:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _asked(words: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sorted distinct uni- and bigrams of a stream."""
    return np.unique(np.concatenate([words & IDENTITY, two]))


def _requests(shards):
    """The distinct n-grams of each stream, a row for each shard."""
    shift = np.uint64(64 - int(shards).bit_length() + 1)

    def run(batches):
        for rows in batches:
            for chunk, words, places in zip(*(rows.column(c).to_pylist() for c in ("chunk", "words", "places"))):
                words = unpack(words, np.uint64)
                keys = _asked(words, np.unique(pairs(words[unpack(places, np.uint32)]) & IDENTITY))
                at = np.searchsorted(keys >> shift, np.arange(shards + 1, dtype=np.uint64)) if shards > 1 else np.array([0, len(keys)])
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.ones(len(some), np.int32)), pa.array(np.full(len(some), chunk, np.int64)),
                     pa.array([pack(np.diff(keys[at[r]:at[r + 1]], prepend=np.uint64(0))) for r in some], pa.binary())], ["shard", "kind", "number", "raw"])

    return run


def _answers(shards, ranges, blocks):
    """The levels of requested n-grams; the parts of a shard come before the requests to it."""
    each, part = (blocks // shards) << (BLOCK_BITS - 3), (blocks // ranges) << (BLOCK_BITS - 3)

    def run(batches):
        current, bits = None, np.zeros(each, np.uint8)
        for rows in batches:
            out = []
            for shard, kind, number, raw in zip(*(rows.column(c).to_pylist() for c in ("shard", "kind", "number", "raw"))):
                if shard != current:
                    current = shard
                    bits[:] = 0
                begin = shard * each
                if kind == 0:
                    bits[number * part - begin:(number + 1) * part - begin] = np.frombuffer(raw, np.uint8)
                else:
                    keys = np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)
                    out.append((number, shard, pack(_levels(bits, blocks, keys, begin).astype(np.uint8))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["chunk", "shard", "levels"])

    return run


def _score_streams(shared):
    """The scores of each stream from its levels, which follow it by shard."""

    def done(stream, levels):
        words, place = unpack(stream["words"], np.uint64), unpack(stream["places"], np.uint32)
        two, which = np.unique(pairs(words[place]) & IDENTITY, return_inverse=True)
        keys = _asked(words, two)
        count = VALUE[np.concatenate([unpack(x, np.uint8) for x in levels])]
        at = np.concatenate([[0], np.cumsum(unpack(stream["sizes"], np.int64))])
        return _scored(shared.value, pa.array(stream["row"], pa.int64()), pa.array(stream["doc_id"], pa.int64()), words, place, at,
                       count[np.searchsorted(keys, words & IDENTITY)], count[np.searchsorted(keys, two)][which])

    def run(batches):
        stream, levels = None, []
        for rows in batches:
            for r in range(len(rows)):
                if rows.column("shard")[r].as_py() < 0:
                    if stream:
                        yield done(stream, levels)
                    stream, levels = {c: rows.column(c)[r].as_py() for c in rows.schema.names}, []
                else:
                    levels.append(rows.column("levels")[r].as_py())
        if stream:
            yield done(stream, levels)

    return run


_SCORED = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, rest array<bigint>"


def _score_in_shards(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """The rows of _score where the filter is kept in shards; n-grams are sent once for each stream that has them."""
    blocks, ranges = fitted.shared.value.blocks, fitted.ranges
    shards = min(ranges, max(1, (blocks << BLOCK_BITS) // SHARD_BITS))
    streams = store(docs.mapInArrow(_streams, _STREAM), "streams")
    parts = fitted.parts.select((F.col("range") / (ranges // shards)).cast("bigint").alias("shard"), F.lit(0).alias("kind"), F.col("range").alias("number"), F.col("bits").alias("raw"))
    asked = streams.select("chunk", "words", "places").mapInArrow(_requests(shards), "shard bigint, kind int, number bigint, raw binary")
    answers = (parts.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "number")
               .mapInArrow(_answers(shards, ranges, blocks), "chunk bigint, shard bigint, levels binary"))
    return (streams.withColumn("shard", F.lit(-1).cast("bigint")).unionByName(answers, allowMissingColumns=True)
            .repartition(max(1, streams.count()), "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(_score_streams(fitted.shared), _SCORED))


def score(docs: DataFrame, fitted) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs(doc_id, text)``.

    base_score sums log10((c + 1) / (N + V + 1)) over words and end with exact counts; score is the bigram model's
    log10 probability. Counts of frequent words are looked up in the task, all others by a join on the word, so both
    are exact. Null and empty texts consist of their end. A row that repeats an id is scored like any other.
    """
    shared, words = fitted
    model = shared.value
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = store(_score_in_shards(docs, fitted) if fitted.parts is not None else docs.mapInArrow(_score(shared), _SCORED), "scored")
    rare = found.select("row", F.explode("rest").alias("key"))
    more = rare.join(words, "key").groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1)).alias("base"))
    out = found.drop("rest").join(more, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
                      (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score")
