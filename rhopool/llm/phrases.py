"""Phrase collocations from depth-truncated suffix trees over vertically partitioned texts.

Every word starts a suffix of its piece, cut off after DEPTH words or before the first word, or pair of neighbours, too
rare for any phrase. Pairs are counted by a short hash beforehand: what shares a cell with others is only cut less.
As in elastic-range suffix tree construction, suffixes are divided by variable-length word prefixes: a prefix is made
longer until no more suffixes than the memory budget begin with it, and neighbouring prefixes share a group up to that
budget. The groups are independent: a task sorts the suffixes of a group, which is their tree, and reads the count of
each phrase from the leaf totals below its node. Counts meet in joins for scores; nothing but histograms of fixed size
reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rhopool.llm.filters import Filter
from rhopool.llm.packing import from_planes as _from_planes
from rhopool.llm.packing import loosen, squeeze
from rhopool.llm.packing import planes as _planes
from rhopool.llm.store import store
from rhopool.llm.words import LOWER, chain, mix, span_hashes, text_blocks, word_table

DEPTH = 5             # words of the longest phrase
MIN_COUNT = 100       # occurrences of a phrase
TOP = 2000            # phrases of each language
BUDGET = 1 << 20      # occurrences of suffixes in a group, about
CHUNK = 1 << 21       # words gathered before their suffixes leave a task
CELLS = (10, 20)      # least and most bits of the histograms of prefixes
PAIR_BITS = 32        # of the hash that pairs are counted by, at most
RANGE = 1 << 22       # pairs counted together, about
SALTS = 64

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x09, *range(0x0A, 0x0E), *map(ord, ".,;:!?")]] = True
_ENDS_PIECE = _BETWEEN.copy()
_ENDS_PIECE[[0x20, 0x09]] = False


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    coded = langs.dictionary_encode()
    names = [s.encode() for s in coded.dictionary.to_pylist()]
    stop = np.cumsum([0, *map(len, names)])
    h = np.array([span_hashes(np.frombuffer(n, np.uint8), np.array([0]), np.array([len(n)]))[0] if n else 1 for n in names], np.uint64)
    return h[coded.indices.to_numpy()] if len(stop) > 1 else np.zeros(0, np.uint64)


def _keys(rows, data, offsets):
    """Language-and-word key of every word, where it is, its text, and the piece it is in."""
    starts, ends, doc = word_table(data, offsets, _BETWEEN)
    own = _lang_hashes(rows.column("lang"))[doc]
    piece = np.concatenate([[0], np.cumsum(_ENDS_PIECE[data])])[starts] if len(data) else starts
    return np.maximum(chain(own, span_hashes(data, starts, ends, lower=True)), np.uint64(1)), starts, ends, doc, piece + doc


def _word_counts(batches):
    """Distinct words of about CHUNK words at a time with their languages and counts."""
    held, size = [], 0

    def merged():
        keys, n, lang, word = (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.chunked_array([h[2] for h in held]), pa.chunked_array([h[3] for h in held]))
        found, first, which = np.unique(keys, return_index=True, return_inverse=True)
        first = pa.array(first)
        return pa.RecordBatch.from_arrays([lang.take(first).combine_chunks(), word.take(first).cast(pa.binary()).combine_chunks(), pa.array(found.view(np.int64)),
                                           pa.array(np.bincount(which, n, len(found)).astype(np.int64))], ["lang", "word", "key", "n"])

    for rows, data, offsets in text_blocks(batches):
        keys, starts, ends, doc, _ = _keys(rows, data, offsets)
        if not len(keys):
            continue
        found, first, n = np.unique(keys, return_index=True, return_counts=True)
        bounds = np.stack([starts, ends], axis=1).ravel()      # words and what lies between them, in turn
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data])])
        held.append((found, n, rows.column("lang").take(pa.array(doc[first])), spans.take(pa.array(2 * first))))
        size += len(found)
        if size >= CHUNK:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


@dataclass
class Division:
    """What tasks need to cut and route suffixes: the filters of frequent words and pairs, the heavy cells of each depth, the group of each cell."""

    words: Filter
    pairs: Filter
    pair_bits: int
    heavy: list        # of booleans, one array for each depth that has heavy cells
    groups: np.ndarray  # depth by cell

    def cell(self, prefix: np.ndarray) -> np.ndarray:
        """The histogram cell of prefix hashes."""
        return (mix(prefix) & np.uint64(self.groups.shape[1] - 1)).astype(np.int64)

    def light_at(self, rows: np.ndarray) -> np.ndarray:
        """The depth of each suffix's first prefix that isn't heavy; beyond its length if there is none."""
        size = (rows != 0).sum(axis=1)
        depth = np.ones(len(rows), np.int64)
        live, h = np.arange(len(rows)), rows[:, 0]
        for d, heavy in enumerate(self.heavy, 1):
            on = heavy[self.cell(h)]
            live, h = live[on], h[on]
            depth[live] = d + 1
            more = size[live] > d
            live, h = live[more], h[more]
            if d == DEPTH or not len(live):
                break
            h = chain(h, rows[live, d])
        return depth

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The group of each suffix, by its shortest prefix that isn't heavy, or by its whole."""
        depth = np.minimum(self.light_at(rows), (rows != 0).sum(axis=1))
        h, out = rows[:, 0], np.zeros(len(rows), np.int64)
        for d in range(1, DEPTH + 1):
            here = depth == d
            if here.any():
                out[here] = self.groups[min(d, len(self.groups)) - 1, self.cell(h[here])]
            if d == DEPTH or not (depth > d).any():
                break
            h = chain(h, rows[:, d])
        return out


def _pairs(division: Division, keys: np.ndarray, piece: np.ndarray):
    """Where two frequent words are neighbours in a piece, and the short hashes of these pairs."""
    often = division.words(keys)
    at = np.flatnonzero(often[:-1] & often[1:] & (piece[:-1] == piece[1:]))
    return at, chain(keys[at], keys[at + 1]) >> np.uint64(64 - division.pair_bits)


def _suffixes(division: Division, keys: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The suffixes of two words or more, a row of DEPTH keys each, 0 past the end."""
    at, pairs = _pairs(division, keys, piece)
    on = np.zeros(len(keys) + DEPTH, bool)
    on[at[division.pairs(pairs)]] = True
    at = np.flatnonzero(on)
    rows = np.zeros((len(at), DEPTH), np.uint64)
    padded = np.concatenate([keys, np.zeros(DEPTH, np.uint64)])
    rows[:, 0] = padded[at]
    going = np.ones(len(at), bool)
    for d in range(1, DEPTH):
        going &= on[at + d - 1]
        rows[:, d] = np.where(going, padded[at + d], 0)
    return rows


def _gathered(division, batches):
    """Distinct suffixes and their counts for about CHUNK words at a time."""
    held, size = [], 0
    for rows, data, offsets in text_blocks(batches):
        keys, _, _, _, piece = _keys(rows, data, offsets)
        if not len(keys):
            continue
        held.append(merged(_suffixes(division, keys, piece)))
        size += len(keys)
        if size >= CHUNK:
            yield merged(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if held:
        yield merged(*(np.concatenate(x) for x in zip(*held)))


def merged(rows: np.ndarray, n: np.ndarray | None = None):
    """Equal suffixes as one, in order of their words."""
    n = np.ones(len(rows), np.int64) if n is None else n
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(n, first) if len(first) else n


def _histogram(shared, depth):
    """Cells of the prefixes of ``depth`` words all of whose shorter prefixes are heavy."""

    def run(batches):
        division = shared.value
        total = np.zeros(division.groups.shape[1])
        for rows, n in _gathered(division, batches):
            on = (division.light_at(rows) >= depth) & (rows[:, depth - 1] != 0)
            h = rows[on, 0]
            for d in range(1, depth):
                h = chain(h, rows[on, d])
            total += np.bincount(division.cell(h), n[on], len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["cell", "n"])

    return run


def pack(rows: np.ndarray, n: np.ndarray):
    """Distinct words of sorted suffixes, each suffix as places among them, and the counts; compressed."""
    words, place = np.unique(rows, return_inverse=True)
    return squeeze(_planes(np.diff(words, prepend=np.uint64(0)))), squeeze(_planes(place.reshape(rows.shape).T.ravel().astype(np.uint32))), squeeze(_planes(n.astype(np.uint64)))


def unpack(words: bytes, places: bytes, n: bytes):
    words, places, n = map(loosen, (words, places, n))
    words = np.cumsum(_from_planes(words, np.uint64), dtype=np.uint64)
    return words[_from_planes(places, np.uint32).reshape(DEPTH, -1).T], _from_planes(n, np.uint64).astype(np.int64)


_PACKED = "group bigint, words binary, places binary, n binary"


def _routed(shared):
    """The suffixes of each chunk, packed: a row for each group."""

    def run(batches):
        division = shared.value
        for rows, n in _gathered(division, batches):
            if not len(rows):
                continue
            group = division.route(rows)
            order = np.argsort(group, kind="stable")
            rows, n, group = rows[order], n[order], group[order]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            packed = [pack(rows[a:b], n[a:b]) for a, b in zip(first, [*first[1:], len(rows)])]
            yield pa.RecordBatch.from_arrays([pa.array(group[first]), *(pa.array([p[k] for p in packed], pa.binary()) for k in range(3))], ["group", "words", "places", "n"])

    return run


_NODE = "id bigint, words array<bigint>, firsts array<bigint>, rests array<bigint>, n bigint, whole boolean"


def _lists(columns: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, columns.size + 1, columns.shape[1], dtype=np.int32)), pa.array(columns.ravel().view(np.int64)))


def nodes(division: Division, rows: np.ndarray, n: np.ndarray, least: int):
    """The nodes of two words or more of the tree of sorted suffixes: a batch for each depth.

    ``whole`` nodes have all their suffixes here and come if they count ``least`` or more; the others (all of their
    prefixes are heavy) come with what is here. ids are hashes of the words; ``firsts`` and ``rests`` are the ids of
    both parts of each cut.
    """
    # The depth at which each suffix parts from the one before it.
    apart = np.concatenate([[0], np.argmax(np.concatenate([rows[1:] != rows[:-1], np.ones((len(rows) - 1, 1), bool)], axis=1), axis=1)])
    for depth in range(2, DEPTH + 1):
        first = np.flatnonzero(apart < depth)
        total = np.add.reduceat(n, first)
        top = rows[first, :depth]
        there = top[:, -1] != 0
        padded = np.concatenate([top, np.zeros((len(top), DEPTH - depth), np.uint64)], axis=1)
        whole = division.light_at(padded) <= depth
        keep = there & (~whole | (total >= least))
        top, total, whole = top[keep], total[keep], whole[keep]
        if not len(top):
            continue

        def ids(a, b):
            h = top[:, a]
            for d in range(a + 1, b):
                h = chain(h, top[:, d])
            return h

        yield pa.RecordBatch.from_arrays(
            [pa.array(ids(0, depth).view(np.int64)), _lists(top), _lists(np.stack([ids(0, k) for k in range(1, depth)], axis=1)),
             _lists(np.stack([ids(k, depth) for k in range(1, depth)], axis=1)), pa.array(total), pa.array(whole)], ["id", "words", "firsts", "rests", "n", "whole"])


def _trees(shared, least):
    """The nodes of every group's tree; the rows of a group follow one another."""

    def run(batches):
        division, at, held, size = shared.value, None, [], 0
        for batch in batches:
            for group, words, places, n in zip(*(batch.column(c).to_pylist() for c in ("group", "words", "places", "n"))):
                if group != at and held:
                    yield from nodes(division, *merged(*(np.concatenate(x) for x in zip(*held))), least)
                    held, size = [], 0
                at = group
                held.append(unpack(words, places, n))
                size += len(held[-1][1])
                if size > 2 * BUDGET and len(held) > 1:
                    held = [merged(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][1])
        if held:
            yield from nodes(division, *merged(*(np.concatenate(x) for x in zip(*held))), least)

    return run


def _pair_counts(shared, ranges):
    """Counts of the pairs of about CHUNK words at a time: a row for each range of their hashes, with differences and counts."""

    def run(batches):
        division, held, size = shared.value, [], 0
        shift = np.uint64(division.pair_bits - int(ranges).bit_length() + 1)

        def made():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(keys >> shift, np.arange(ranges + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([
                pa.array(some), pa.array([squeeze(_planes(np.diff(keys[at[r]:at[r + 1]], prepend=np.uint64(0)).astype(np.uint32))) for r in some], pa.binary()),
                pa.array([squeeze(_planes(n[at[r]:at[r + 1]].astype(np.uint32))) for r in some], pa.binary())], ["range", "keys", "counts"])

        for rows, data, offsets in text_blocks(batches):
            keys, _, _, _, piece = _keys(rows, data, offsets)
            if len(keys):
                held.append(_pairs(division, keys, piece)[1])
                size += len(keys)
            if size >= CHUNK:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    return run


def _summed(parts):
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _often(least):
    """The pairs that count ``least`` or more; the rows of a range follow one another."""

    def run(batches):
        at, held, size = None, [], 0

        def done():
            keys, n = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(keys[n >= least].astype(np.int64))], ["key"])

        for batch in batches:
            for number, keys, n in zip(*(batch.column(c).to_pylist() for c in ("range", "keys", "counts"))):
                if number != at and held:
                    yield done()
                    held, size = [], 0
                at = number
                held.append((np.cumsum(_from_planes(loosen(keys), np.uint32), dtype=np.uint64), _from_planes(loosen(n), np.uint32).astype(np.int64)))
                size += len(held[-1][0])
                if size > 2 * RANGE and len(held) > 1:
                    held = [_summed(held)]
                    size = len(held[0][0])
        if held:
            yield done()

    return run


def _loads(counts: DataFrame, cells: int) -> np.ndarray:
    got = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def _cells(shared):
    """The cell of each word's prefix of one word."""

    def run(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.cell(rows.column("key").to_numpy().view(np.uint64))), rows.column("n")], ["cell", "n"])

    return run


def divide(texts: DataFrame, frequent: DataFrame, words: int, total: int, least: int = MIN_COUNT, budget: int = BUDGET) -> Division:
    """The vertical partition of ``texts(lang, text)``: each round counts the prefixes one word longer than the heavy ones."""
    spark = texts.sparkSession
    size = 1 << int(np.clip(np.ceil(np.log2(max(total / budget, 1))) + 6, *CELLS))
    pair_bits = int(np.clip(np.ceil(np.log2(max(total, 1))) + 4, 16, PAIR_BITS))
    division = Division(Filter.of(frequent.select("key"), words), Filter(), pair_bits, [], np.zeros((1, size), np.int64))
    ranges = 1 << int(np.clip(np.ceil(np.log2(max(total / RANGE, 1))), 0, 16))
    often = store(texts.mapInArrow(_pair_counts(spark.sparkContext.broadcast(division), ranges), "range bigint, keys binary, counts binary")
                  .repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_often(least), "key bigint"), "pairs")
    division.pairs = Filter.of(often, often.count())
    loads = [_loads(frequent.select("key", "n").mapInArrow(_cells(spark.sparkContext.broadcast(division)), "cell bigint, n bigint"), size)]
    while (loads[-1] > budget).any() and len(loads) < DEPTH:
        division = Division(division.words, division.pairs, pair_bits, [*division.heavy, loads[-1] > budget], np.zeros((1, size), np.int64))
        counted = texts.mapInArrow(_histogram(spark.sparkContext.broadcast(division), len(loads) + 1), "cell bigint, n bigint")
        loads.append(_loads(counted, size))
    light = np.stack([np.where(x > budget, 0, x) for x in loads[:-1]] + [np.minimum(loads[-1], budget)])
    groups = ((np.cumsum(light.ravel()) - light.ravel()) // budget).reshape(light.shape)
    return Division(division.words, division.pairs, pair_bits, division.heavy, groups)


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, budget: int = BUDGET):
    """(words, totals, phrases) of ``docs(text, lang)``.

    words: lang, word, key, n of those that occur ``least`` times or more; totals: lang, n of all words; phrases: the nodes
    (id, words, firsts, rests, n) of two to DEPTH words that do. Null texts are empty, a null language is 'und'.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    every = texts.mapInArrow(_word_counts, "lang string, word binary, key bigint, n bigint").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    seen = F.col("n") >= least
    # Words too rare for any phrase go on as one row for each language and partition of the counts.
    counts = store(every.withColumns({"word": F.when(seen, F.col("word")), "key": F.when(seen, F.col("key"))}).groupBy("lang", "word", "key").agg(F.sum("n").alias("n")), "words")
    totals = store(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = counts.where("key is not null").select("lang", F.col("word").cast("string").alias("word"), "key", "n")
    words, total = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not words:
        return frequent, totals, spark.createDataFrame([], _NODE).drop("whole")
    division = divide(texts, frequent, words, total, least, budget)
    shared = spark.sparkContext.broadcast(division)
    parts = min(int(division.groups.max()) + 1, 1 << 16)
    found = store(texts.mapInArrow(_routed(shared), _PACKED).repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_trees(shared, least), _NODE), "nodes")
    whole = found.where("whole").drop("whole")
    if not division.heavy:
        return frequent, totals, whole
    parted = found.where("not whole").groupBy("id").agg(F.first("words").alias("words"), F.first("firsts").alias("firsts"), F.first("rests").alias("rests"), F.sum("n").alias("n"))
    return frequent, totals, store(whole.unionByName(parted.where(F.col("n") >= least)), "phrases")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language of ``docs(text, lang)``.

    A phrase of two to DEPTH words with a >= ``least`` occurrences is cut where floor(1000 * a * n / (l * r)) is least,
    ties at the first such place; it is dropped if a longer one that holds it occurs as often. By score, then a (both
    falling), then phrase (bytes). Null texts are empty, a null language is 'und'; texts of no phrase add to n alone.
    Repeated rows count each. A word's identity within a language, and a phrase's, is a 64-bit hash.
    """
    words, totals, phrases = phrase_counts(docs, least, budget)
    sizes = words.select(F.col("key").alias("id"), "n", "lang").unionByName(phrases.select("id", "n", F.lit(None).cast("string").alias("lang")))
    cuts = phrases.select("id", "words", F.col("n").alias("a"), F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "cut")).select(
        "id", "words", "a", (F.col("k") + 1).alias("k"), F.col("cut.firsts").alias("first"), F.col("cut.rests").alias("rest"))
    cuts = cuts.join(sizes.select(F.col("id").alias("first"), F.col("n").alias("l"), "lang"), "first")
    cuts = store(cuts.join(sizes.select(F.col("id").alias("rest"), F.col("n").alias("r")), "rest"), "cuts")
    # A longer phrase as frequent as this one makes all phrases between them as frequent, so those one word longer decide.
    inside = cuts.where("k = size(words) - 1 and l = a").select(F.col("first").alias("id")).union(cuts.where("k = 1 and r = a").select("rest")).distinct()
    one = cuts.groupBy("id").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("k", "l", "r"))).alias("cuts"))
    one = one.join(inside, "id", "left_anti").join(totals, "lang")
    value = F.expr("transform(cuts, c -> struct((cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div "
                   "(cast(c.l as decimal(19, 0)) * cast(c.r as decimal(19, 0))) as score, c.k as k, c.l as l, c.r as r))")
    scored = one.withColumn("best", F.array_min(value)).select("id", "words", "lang", "a", "best.l", "best.r", "n", "best.score")
    # Two steps, so that no task orders all phrases of a language; ties at the end stay until their words are known.
    order = [F.desc("score"), F.desc("a")]
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = store(scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("salt", "place"), "best")
    spelled = (best.select("id", F.posexplode("words").alias("k", "key")).join(words.select("key", "word"), "key").groupBy("id")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    named = best.join(spelled, "id").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint"))
    return named.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
