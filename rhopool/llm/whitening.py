"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries become integers. Each dimension, shifted by its least value, is cut into bit planes, and the planes of a block
of rows are packed into 64-bit words. A popcount of the AND of two planes counts the rows that have both bits; weighted
by the planes' powers of two, the counts add up to exact cross-products. They are summed by Spark as integers in limbs,
centred as integers on the driver (d x d numbers, d the dimension) and only then divided and decomposed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.llm.store import store

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
BLOCK = 8192        # rows whose planes are packed and met at once
LIMB = 24           # bits of a limb
WIDEST = 1 << 62    # an entry beyond it is no long, and its vector is dropped
FLAT = 1e-12        # share of the trace up to which an eigenvalue counts as zero


def integers(column: pa.Array, size: int | None = None):
    """(rows, x): the numbers of the rows kept and their entries as integers, for vectors of length ``size``.

    Null vectors, vectors with null or non-finite entries or entries beyond a long, and vectors of another length are
    left out. Without ``size`` a list of (size, rows, x) comes back, one for each length.
    """
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
    flat = lists.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    first = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)

    def of(n):
        rows = np.flatnonzero(lengths == n)
        c = values[first[rows][:, None] + np.arange(n)] * SCALE
        fine = (np.abs(c) < WIDEST).all(axis=1)        # false for nan
        return rows[fine], np.floor(c[fine]).astype(np.int64) + OFFSET

    if size is not None:
        return of(size)
    return [(int(n), *of(n)) for n in np.unique(lengths[lengths > 0])]


def _ranges(batches):
    """Per length and dimension: rows, least and largest entry, one row for each in a task."""
    seen: dict[int, list] = {}
    for batch in batches:
        for size, rows, x in integers(batch.column(0)):
            if len(rows):
                old = seen.get(size)
                low, high = x.min(axis=0), x.max(axis=0)
                seen[size] = [len(rows), low, high] if old is None else [old[0] + len(rows), np.minimum(old[1], low), np.maximum(old[2], high)]
    for size, (n, low, high) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)),
                                          pa.array(low), pa.array(high)], ["size", "dim", "n", "low", "high"])


@dataclass
class Planes:
    """Which bit of which dimension each plane holds."""

    low: np.ndarray     # what every dimension is shifted by
    dim: np.ndarray     # of each plane, ascending
    bit: np.ndarray

    @staticmethod
    def of(low: np.ndarray, high: np.ndarray) -> Planes:
        widths = [max(1, (int(b) - int(a)).bit_length()) for a, b in zip(low, high)]
        return Planes(low, np.repeat(np.arange(len(low)), widths), np.concatenate([np.arange(w) for w in widths]))

    @property
    def limbs(self) -> int:
        return 2 * int(self.bit.max()) // LIMB + 4     # the last ones take the carries

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Planes by words; the bits past the last row are zero."""
        y = (x.astype(np.uint64) - self.low.astype(np.uint64)).T     # modulo 2**64, so wide ranges are right too
        words = -(-x.shape[0] // 64)
        out = np.zeros((len(self.dim), words * 8), np.uint8)
        for p, (d, b) in enumerate(zip(self.dim, self.bit)):
            bits = np.packbits(((y[d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
            out[p, :len(bits)] = bits
        return out.view(np.uint64)


def _carried(limbs: np.ndarray) -> np.ndarray:
    """The same numbers with every limb but the last below 2**LIMB."""
    for k in range(len(limbs) - 1):
        limbs[k + 1] += limbs[k] >> LIMB
        limbs[k] &= (1 << LIMB) - 1
    return limbs


def scatter(planes: Planes, packed: np.ndarray, total: np.ndarray) -> None:
    """Adds a block's sums (column 0) and cross-products (columns 1 to d, from the diagonal on) to limbs by d by d + 1."""
    starts = np.searchsorted(planes.dim, np.arange(len(planes.low)))
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    limb, shift = planes.bit // LIMB, planes.bit % LIMB
    for k in np.unique(limb):
        total[k, :, 0] += np.add.reduceat(np.where(limb == k, ones << shift, 0), starts)
    for p in range(len(packed)):
        d = planes.dim[p]
        at = starts[d]
        both = np.bitwise_count(packed[at:] & packed[p]).sum(axis=1, dtype=np.int64)
        weight = planes.bit[at:] + planes.bit[p]
        limb = weight // LIMB
        value = both << (weight % LIMB)
        if limb[-1] == limb[0] and limb.max() == limb.min():
            total[limb[0], d, 1 + d:] += np.add.reduceat(value, starts[d:] - at)
        else:
            for k in np.unique(limb):
                total[k, d, 1 + d:] += np.add.reduceat(np.where(limb == k, value, 0), starts[d:] - at)
    _carried(total)


def _scatters(shared, size):
    """One row for each dimension in a task: its limbs of sums and cross-products."""

    def run(batches):
        planes = shared.value
        total = np.zeros((planes.limbs, size, size + 1), np.int64)
        held, rows = [], 0

        def flush(all_of_it):
            nonlocal held, rows
            x = np.concatenate(held)
            stop = len(x) if all_of_it else len(x) // BLOCK * BLOCK
            for a in range(0, stop, BLOCK):
                scatter(planes, planes.pack(x[a:min(a + BLOCK, stop)]), total)
            held, rows = [x[stop:]], len(x) - stop

        for batch in batches:
            held.append(integers(batch.column(0), size)[1])
            rows += len(held[-1])
            if rows >= BLOCK:
                flush(False)
        if rows:
            flush(True)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array([total[:, d].tobytes() for d in range(size)], pa.binary())], ["dim", "limbs"])

    return run


def _sums(limbs, size):
    """Adds up the rows of each dimension as they pass, in order of dimension."""

    def run(batches):
        at, total = None, None
        for batch in batches:
            for d, raw in zip(batch.column("dim").to_pylist(), batch.column("limbs").to_pylist()):
                part = np.frombuffer(raw, np.int64).reshape(limbs, size + 1)
                if d != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["dim", "limbs"])
                    at, total = d, part.copy()
                else:
                    total = _carried(total + part)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["dim", "limbs"])

    return run


@dataclass
class Model:
    """n, exact sums S and V * n * n as Python integers, and the components (columns) with their eigenvalues."""

    size: int
    n: int
    sums: list
    centred: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on each component, over the root of its eigenvalue; nan where that is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > FLAT * self.trace, 1 / np.sqrt(self.values), np.nan)
        return self.away(x).astype(np.float64) / self.n @ self.components * scale

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python integers where longs can't hold it."""
        widest = max(int(np.abs(x).max(initial=0)), 1) * self.n + max((abs(s) for s in self.sums), default=0)
        if widest < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S) ** 2, exact."""
        y = self.away(x)
        most = max((abs(int(v)) for v in (y.max(initial=0), y.min(initial=0))), default=0)
        if most * most * max(self.size, 1) >= 1 << 63:
            y = y.astype(object)
        return [int(v) for v in (y * y).sum(axis=1)]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of all vectors of ``column``; None if no vector remains.

    The dimension is the length that most vectors have (ties: the longest); vectors of other lengths, null vectors and
    those with null, non-finite or too large entries (beyond 2**62 / 1024) are left out. What reaches the driver is
    d x d numbers. A component of eigenvalue zero (up to rounding) whitens nothing.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(column).cast("array<double>").alias("v"))
    ranges = store(own.mapInArrow(_ranges, "size int, dim int, n bigint, low bigint, high bigint").groupBy("size", "dim")
                   .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "ranges")
    most = ranges.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    size, n = most["size"], int(most["n"])
    got = ranges.where(F.col("size") == size).orderBy("dim").toArrow()
    planes = Planes.of(got.column("low").to_numpy(), got.column("high").to_numpy())
    shared = spark.sparkContext.broadcast(planes)
    rows = (own.mapInArrow(_scatters(shared, size), "dim int, limbs binary").repartition("dim").sortWithinPartitions("dim")
            .mapInArrow(_sums(planes.limbs, size), "dim int, limbs binary").toArrow())
    exact = np.zeros((size, size + 1), object)
    for d, raw in zip(rows.column("dim").to_pylist(), rows.column("limbs").to_pylist()):
        part = np.frombuffer(raw, np.int64).reshape(planes.limbs, size + 1).astype(object)
        exact[d] = sum(part[k] * (1 << (LIMB * k)) for k in range(planes.limbs))
    shifted, cross = exact[:, 0], exact[:, 1:]
    cross = np.where(np.tri(size, k=-1, dtype=bool), cross.T, cross)
    # Covariances don't feel the shift, so y = x - low takes the place of x.
    centred = n * cross - np.outer(shifted, shifted)
    squared = n * n
    v = np.array([[float(c * 1.0 / squared) if abs(c) < 1 << 53 else c / squared for c in row] for row in centred], np.float64)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(int(centred[d, d]) for d in range(size)) / squared
    sums = [int(s) + n * int(a) for s, a in zip(shifted, planes.low)]
    return Model(size, n, sums, centred, axes[:, order], values[order], trace)


def _moments(shared):
    """Rows, sums and products of the whitened values of a task."""

    def run(batches):
        m = shared.value
        k = m.components.shape[1]
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = m.whiten(integers(batch.column(0), m.size)[1])
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), k + 1)), pa.array(total.ravel())], ["a", "b", "s"])

    return run


def identity_error(vectors: DataFrame, model: Model, column: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity, measured on all rows.

    Components of eigenvalue zero are left out; with none left it is null.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    got = vectors.select(F.col(column).cast("array<double>")).mapInArrow(_moments(shared), "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()
    k = model.components.shape[1]
    total = np.zeros((k + 1, k))
    for r in got:
        total[r["a"], r["b"]] = r["s"]
    mean = total[0] / model.n
    error = np.abs(total[1:] / model.n - np.outer(mean, mean) - np.eye(k))
    return None if np.isnan(error).all() else float(np.nanmax(error))


WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(vectors: DataFrame, model: Model | None, column: str = "embedding") -> DataFrame:
    """One row for each remaining vector of ``vectors(vec_id, embedding)`` and component, with the columns of WHITENED.

    ``deviation`` is null where the exact number passes a long (``deviation_exact`` holds up to 38 digits, and is null
    beyond). ``whitened`` is null for components of eigenvalue zero, ``explained`` where the trace is zero. Repeated
    rows are each answered; null ids stay null; other columns are ignored.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    if model is None:
        return spark.createDataFrame([], WHITENED)
    error = identity_error(vectors, model, column)
    shared = spark.sparkContext.broadcast(model)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def run(batches):
        m = shared.value
        k = m.components.shape[1]
        for batch in batches:
            rows, x = integers(batch.column("v"), m.size)
            if not len(rows):
                continue
            ids = batch.column("vec_id").take(pa.array(np.repeat(rows, k)))
            exact = m.deviation(x)
            longs = np.array([e if e < 1 << 63 else None for e in exact], object)
            digits = np.array([str(e) if e < 10 ** 38 else None for e in exact], object)
            w = m.whiten(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(w), m.n)), pa.array(np.repeat(longs, k), pa.int64()),
                 pa.array(w, mask=np.isnan(w)), pa.array(explained * len(rows), pa.float64()), pa.array([error] * len(w), pa.float64()),
                 pa.array(np.repeat(digits, k), pa.string())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    out = own.mapInArrow(run, WHITENED.replace("decimal(38,0)", "string"))
    return out.withColumn("deviation_exact", F.col("deviation_exact").cast("decimal(38,0)"))
