"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters and digits. Windows of ``tile`` tokens with equal rolling (Karp-Rabin) hashes
seed the comparison of a document with a benchmark item; the longest match of unmarked tokens is marked again and
again, so that passages in another order are found as several tiles. The tiles' share of the item decides.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.llm.store import store
from rhopool.llm.words import SIGNS, mix, per_text, span_hashes, text_blocks, word_table

TILE = 4          # tokens of the shortest tile
COVERAGE = 0.5    # of the item's tokens
FILTER_BITS = 23  # the seed filter has 2**23 bits, 1 MiB, at any size of the benchmark
PAGE_BITS = 11

_B = np.uint64(0xC2B2AE3D27D4EB4F)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` token hashes, modulo 2**64."""
    if len(h) < width:
        return h[:0]
    value = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        value = value * _B + h[k:k + len(value)]
    return mix(value)


def _windows(data, offsets, tile):
    """Token count of each text; text, position and hash of every window."""
    starts, ends, doc = word_table(data, offsets, SIGNS)
    at = per_text(doc, len(offsets) - 1)
    value = rolling(span_hashes(data, starts, ends, lower=True), tile)
    inside = np.flatnonzero(doc[:len(value)] == doc[tile - 1:]) if len(value) else np.zeros(0, np.int64)
    return np.diff(at), doc[inside], inside - at[doc[inside]], value[inside]


def _item_windows(tile):
    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            size, doc, pos, value = _windows(data, offsets, tile)
            yield pa.RecordBatch.from_arrays([rows.column("item_id").take(pa.array(doc)), pa.array(size[doc]), pa.array(pos), pa.array(value.view(np.int64))],
                                             ["item_id", "item_tokens", "j", "seed"])

    return run


def _page(table):
    """The bits of one page of the filter."""
    bits = np.zeros(1 << PAGE_BITS, bool)
    bits[table.column("slot").to_numpy() & ((1 << PAGE_BITS) - 1)] = True
    return pa.table({"page": table.column("page")[:1].cast(pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter of the seeds, of fixed size."""
    slot = F.col("seed").bitwiseAND((1 << FILTER_BITS) - 1)
    pages = (seeds.select(slot.alias("slot")).distinct().withColumn("page", F.shiftright("slot", PAGE_BITS))
             .groupBy("page").applyInArrow(_page, "page bigint, bits binary").collect())
    out = np.zeros((1 << (FILTER_BITS - PAGE_BITS), 1 << (PAGE_BITS - 3)), np.uint8)
    for p in pages:
        out[p.page] = np.frombuffer(p.bits, np.uint8)
    return out.ravel()


def _doc_seeds(shared, tile):
    def run(batches):
        bits = shared.value
        for rows, data, offsets in text_blocks(batches):
            _, doc, pos, value = _windows(data, offsets, tile)
            slot = (value & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
            hit = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()).take(pa.array(doc[hit])), pa.array(pos[hit]), pa.array(value[hit].view(np.int64))],
                                             ["doc_id", "i", "seed"])

    return run


def tiles(i: np.ndarray, j: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the document, start in the item, tokens) from the windows (i, j) that agree.

    Runs of windows on a diagonal are the maximal matches. The longest match is marked first (ties: the earliest in
    the document, then in the item); what marks leave of a match takes its turn by the length left.
    """
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    begin = np.concatenate([[0], breaks])
    size = np.diff(np.append(begin, len(i))) + tile - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, i[begin], j[begin])]
    heapq.heapify(heap)
    in_doc, in_item, out = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + k not in in_doc and b + k not in in_item for k in range(-n)]
        if all(free):
            in_doc.update(range(a, a - n))
            in_item.update(range(b, b - n))
            out.append((a, b, -n))
            continue
        k = 0
        while k < len(free):
            run = k
            while run < len(free) and free[run]:
                run += 1
            if run - k >= tile:
                heapq.heappush(heap, (k - run, a + k, b + k))
            k = run + 1
    return out


def _tiled(tile):
    def run(table):
        found = tiles(*np.unique(np.stack([table.column("i").to_numpy(), table.column("j").to_numpy()]), axis=1), tile)
        return pa.table({"doc_id": table.column("doc_id")[:1], "item_id": table.column("item_id")[:1], "item_tokens": table.column("item_tokens")[:1],
                         "tiles": pa.array([len(found)], pa.int64()), "matched": pa.array([sum(n for *_, n in found)], pa.int64())})

    return run


def overlaps(docs: DataFrame, bench: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, item_id, item_tokens, tiles, matched, coverage for every pair that shares a window of ``tile`` tokens.

    ``docs(doc_id, text)``, ``bench(item_id, text)``; other columns are ignored. Empty and null texts and items of
    fewer than ``tile`` tokens match nothing; rows without an id are left out; rows repeating an id count as one text
    at their common positions. Documents are cut to the windows that the benchmark may hold before any shuffle, by a
    filter of fixed size; the join that follows is exact.
    """
    spark = docs.sparkSession
    bench = bench.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    seeds = store(bench.mapInArrow(_item_windows(tile), "item_id bigint, item_tokens bigint, j bigint, seed bigint").distinct(), "seeds")
    shared = spark.sparkContext.broadcast(seed_filter(seeds))
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    hits = docs.mapInArrow(_doc_seeds(shared, tile), "doc_id bigint, i bigint, seed bigint")
    pairs = hits.join(seeds, "seed").select("doc_id", "item_id", "item_tokens", "i", "j")
    found = pairs.groupBy("doc_id", "item_id").applyInArrow(_tiled(tile), "doc_id bigint, item_id bigint, item_tokens bigint, tiles bigint, matched bigint")
    return found.withColumn("coverage", F.col("matched") / F.col("item_tokens"))


def contaminated(docs: DataFrame, bench: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The pairs of :func:`overlaps` whose tiles cover at least ``coverage`` of the item."""
    return overlaps(docs, bench, tile).where(F.col("coverage") >= coverage)
