"""MinHash near-duplicate groups.

Texts with equal shingle sets form a class. Signatures of universal-hash minima are cut into bands; texts meeting in a
band are compared with the least class there, first by signature, then on their full sets. Classes that met but were
not joined by this are compared among each other, block by block. Groups are connected components of confirmed links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.llm.components import components
from rhopool.llm.store import store
from rhopool.llm.words import chain, mix, per_text, span_hashes, text_blocks, word_table

BANDS, ROWS = 32, 5  # a pair at similarity 0.8 misses every band with probability (1 - 0.8**5)**32 < 4e-6
SLACK = 0.14         # a signature may read this much below the threshold: over four standard deviations at 160 minima
STAR_BLOCK = PAIR_BLOCK = 512
PAIR_SHINGLES = 1 << 20  # shingles of a block of pairs, on average at most

_rng = np.random.default_rng(97)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)

SKETCH = "doc_id bigint, unit bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted. Fewer words than ``size``: the whole sequence is one shingle."""
    starts, ends, doc = word_table(data, offsets)
    h = span_hashes(data, starts, ends, lower=True)
    at = per_text(doc, len(offsets) - 1)
    runs = chain(*(h[k:len(h) - size + 1 + k] for k in range(size))) if len(h) >= size else h[:0]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        elif b > a:
            out.append(chain(*(h[k:k + 1] for k in range(a, b)), np.array([b - a], np.uint64)))
        else:
            out.append(h[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (x[i:i + 2048, None] * _A + _B).min(axis=0), out=least)
    return least


def _sketches(size):
    lane = np.arange(BANDS, dtype=np.uint64)

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            sets = shingle_sets(data, offsets, size)
            n = np.array([len(s) for s in sets], np.int64)
            f = np.array([(s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else (0, 0)
                          for s in sets], np.uint64).reshape(-1, 2)
            sig = np.stack([signature(s) for s in sets if len(s)]) if n.any() else np.zeros((0, BANDS * ROWS), np.uint32)
            part = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = chain(np.broadcast_to(lane, part.shape[:2]), *(part[:, :, r] for r in range(ROWS))).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("unit"), pa.array(n), pa.array(f[:, 0].astype(np.int64)),
                                              pa.array(f[:, 1].astype(np.int64)), bands],
                                             ["doc_id", "unit", "n_shingles", "f1", "f2", "bands"])

    return run


def _confirm(size, percent):
    """Rows ordered by (hub, block, hub first): each member is compared with the hub's set, which alone is held."""

    def run(batches):
        hub, hub_set, hub_sig = None, None, None
        for rows, data, offsets in text_blocks(batches):
            sets = shingle_sets(data, offsets, size)
            hubs, ids = rows.column("hub").to_pylist(), rows.column("id").to_pylist()
            us, vs = [], []
            for h, i, s in zip(hubs, ids, sets):
                if h == i:
                    hub, hub_set, hub_sig = h, s, signature(s)
                    continue
                if h != hub or 100 * min(len(s), len(hub_set)) < percent * max(len(s), len(hub_set)):
                    continue
                if 100 * ((signature(s) == hub_sig).mean() + SLACK) < percent:
                    continue
                common = len(np.intersect1d(hub_set, s, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(hub_set) - common):
                    us.append(h)
                    vs.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (hub, id) whose full sets are similar enough. Large stars are cut into blocks, each with its hub's text."""
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR_BLOCK).alias("nb"))
    members = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("nb")).alias("block"), "id")
    centres = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).alias("block"), F.col("hub").alias("id"))
    rows = members.unionAll(centres).join(texts, "id")
    rows = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("id") != F.col("hub"))
    return rows.select("hub", "id", "text").mapInArrow(_confirm(size, percent), "u bigint, v bigint")


def _matrix(column) -> np.ndarray:
    """Signatures of one group as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _cross(table):
    """Row numbers of both blocks of a cell, labels and ids."""
    block = table.column("block").to_numpy()
    left, right = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    return np.flatnonzero(block == left), np.flatnonzero(block == right), table.column("label").to_numpy(), table.column("id").to_numpy()


def _met(percent):
    """The rows of a cell that have a row of another group with a signature and a size close enough."""

    def run(table):
        a, b, labels, ids = _cross(table)
        sig, size = _matrix(table.column("sig")), table.column("n").to_numpy()
        near = np.zeros(len(ids), bool)
        for x in a:
            other = b[(labels[b] != labels[x]) & (100 * np.minimum(size[b], size[x]) >= percent * np.maximum(size[b], size[x]))]
            if len(other):
                other = other[100 * ((sig[other] == sig[x]).mean(axis=1) + SLACK) >= percent]
                near[other] = True
                near[x] |= len(other) > 0
        return table.filter(pa.array(near)).select(["band", "i", "j", "block", "id", "label"])

    return run


def _linked(percent):
    """Confirmed links between the groups of a cell; groups that one link joins count as one from then on."""

    def run(table):
        a, b, labels, ids = _cross(table)
        labels = labels.copy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        us, vs = [], []
        for x in a:
            other = b[(labels[b] != labels[x]) & (100 * np.minimum(size[b], size[x]) >= percent * np.maximum(size[b], size[x]))]
            if not len(other):
                continue
            pool = np.concatenate([sets[y] for y in other])
            at = np.searchsorted(sets[x], pool).clip(max=size[x] - 1)
            common = np.add.reduceat(sets[x][at] == pool, np.cumsum(size[other]) - size[other], dtype=np.int64)
            for y in other[100 * common >= percent * (size[other] + size[x] - common)]:
                if labels[y] != labels[x]:
                    us.append(int(ids[x]))
                    vs.append(int(ids[y]))
                    labels[labels == labels[y]] = labels[x]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _of_texts(size, name, value):
    """id and a binary made from the text's shingle set."""

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            made = pa.array([value(s).tobytes() for s in shingle_sets(data, offsets, size)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("id"), made], ["id", name])

    return run


def _blocks(rows, shingles):
    return F.greatest(F.ceil(rows / PAIR_BLOCK), F.ceil(shingles / PAIR_SHINGLES))


def _of_one_id(named: DataFrame, several: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of different texts under one doc_id."""
    held = (named.join(several.where("apart"), "doc_id", "left_semi").select("doc_id", "f1", "f2", "n_shingles").distinct()
            .join(classes, ["f1", "f2", "n_shingles"]).select("doc_id", "id"))
    first = held.groupBy("doc_id").agg(F.min("id").alias("u"))
    return held.join(first, "doc_id").where("id <> u").select("u", F.col("id").alias("v"))


def _once(rows: DataFrame, several: DataFrame) -> DataFrame:
    """One row a unit; only those of ids that stand in several rows can repeat and are looked at."""
    return rows.join(several, "doc_id", "left_anti").unionAll(rows.join(several, "doc_id", "left_semi").dropDuplicates(["unit"]))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``.

    A document's set holds its distinct shingles of ``shingle`` lower-cased words; shorter texts are one shingle; a
    text without words, empty or null has none and is linked with nothing. Documents are linked when
    100 * intersection >= ``percent`` * union. component_id is the least doc_id reachable, kept tells doc_id =
    component_id. Rows repeating a doc_id each come back, as parts of one document. A row without doc_id takes part in
    nothing: component_id null, kept true. Other columns are ignored. Inside, a text under an id goes by a hash of both, so
    different texts under one id are each compared.

    Every row stays distributed: equal sets are one class before any join, a band's classes meet its least class only,
    and the classes still apart afterwards meet in blocks of bounded size.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("unit", F.xxhash64("doc_id", "text"))
    sketches = store(docs.mapInArrow(_sketches(shingle), SKETCH), "sketches")
    named = sketches.where("doc_id is not null and n_shingles > 0")
    classes = store(named.groupBy("f1", "f2", "n_shingles").agg(F.min("unit").alias("id"), F.min("doc_id").alias("least")), "classes")
    mark = F.xxhash64("f1", "f2", "n_shingles")
    several = store(named.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(mark) != F.max(mark)).alias("apart")).where("n > 1").select("doc_id", "apart"), "several")
    repeats = not several.isEmpty()
    rows = named.join(classes.select(F.col("id").alias("unit")).distinct(), "unit", "left_semi")
    rows = ((_once(rows, several) if repeats else rows)
            .select(F.col("unit").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band")))
    hubs = rows.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("band", "hub")
    met = store(rows.join(hubs, "band").select("band", "hub", "id", "n"), "met")
    pairs = met.where("hub <> id").select("hub", "id").distinct()
    members = met.select("id").distinct()
    texts = docs.join(members.withColumnRenamed("id", "unit"), "unit", "left_semi")
    texts = store((_once(texts, several) if repeats else texts).select(F.col("unit").alias("id"), "text"), "texts")
    links = _confirmed(pairs, texts, shingle, percent)
    links = store(links.unionAll(_of_one_id(named, several, classes)) if repeats else links, "confirmed")
    groups = store(components(links), "groups")

    # Bands in which several groups are left: their classes have met the hub only, not each other.
    labelled = met.join(groups.select(F.col("node").alias("id"), "label"), "id", "left").select("band", "id", "n", F.coalesce("label", "id").alias("label"))
    # Only the largest group of a band may fill many blocks; its blocks meet those of the other groups, not each other.
    sizes = labelled.groupBy("band", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    apart = (sizes.groupBy("band").agg(F.max(F.struct("rows", "all", "label")).alias("main"), F.sum("rows").alias("rows"), F.sum("all").alias("all"), F.count("*").alias("labels"))
             .where("rows > 2 and labels > 1")
             .select("band", F.col("main.label").alias("main"), _blocks(F.col("main.rows"), F.col("main.all")).alias("inner"),
                     _blocks(F.col("rows") - F.col("main.rows"), F.col("all") - F.col("main.all")).alias("outer")))
    deal, inside = F.xxhash64("id"), F.col("label") == F.col("main")
    left = store(labelled.join(apart, "band").select(
        "band", "id", "n", "label", F.when(inside, F.col("outer") + F.pmod(deal, F.col("inner"))).otherwise(F.pmod(deal, F.col("outer"))).alias("block"),
        F.when(inside, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1).alias("last")), "apart")
    cells = (left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
             .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "n"))
    of_id = texts.join(left.select("id").distinct(), "id", "left_semi")
    signed = of_id.mapInArrow(_of_texts(shingle, "sig", signature), "id bigint, sig binary")
    near = store(cells.join(signed, "id").groupBy("band", "i", "j").applyInArrow(
        _met(percent), "band bigint, i bigint, j bigint, block bigint, id bigint, label bigint"), "near")
    sets = (texts.join(near.select("id").distinct(), "id", "left_semi")
            .mapInArrow(_of_texts(shingle, "shingles", lambda s: s), "id bigint, shingles binary"))
    late = store(near.join(sets, "id").groupBy("band", "i", "j").applyInArrow(_linked(percent), "u bigint, v bigint"), "late")
    if not late.isEmpty():
        groups = store(components(links.unionAll(late)), "groups")

    grouped = classes.join(groups.withColumnRenamed("node", "id"), "id", "left")
    least = grouped.where("label is not null").groupBy("label").agg(F.min("least").alias("first"))
    of_class = grouped.join(least, "label", "left").select("f1", "f2", "n_shingles", F.coalesce("first", "least").alias("component"))
    out = sketches.join(of_class, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
