"""Points in space, cut into bounded blocks for exact pairwise work.

Equal vectors are merged into one weighted point, so a group of copies costs
one point.  Points go to their nearest pivot (cell); cells, in an order that
keeps near pivots together, are cut into blocks of about ``block`` points.  Two
cells are compared only if the triangle inequality allows a pair within reach:
``|p - q| - radius_p - radius_q <= reach``.  Every task sees two blocks, and
emits per-point results, never all pairs.  Inside a task, tiles of the blocks
are compared by a fast estimate with a known error; only the pairs that it
leaves open are measured.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.operators.upsert import number_rows
from rhopool.session import materialize

BLOCK = 1024
#: Blocks whose tasks work by tiles: about 20 of them, of at most so many points of 64 dimensions.
WIDE_BLOCK = 32768
TILE = 1024
MAX_PIVOTS = 256


def to_points(df: DataFrame, cols: list[str], key: str = "pair_id") -> DataFrame:
    """(id, v): NULL features become 0, -0.0 becomes 0.0 so equal points compare equal."""
    v = F.expr("array(" + ", ".join(f"coalesce(cast(`{c}` as double), 0D) + 0D" for c in cols) + ")")
    return df.select(F.col(key).cast("string").alias("id"), v.alias("v"))


def unit_vectors(points: DataFrame) -> DataFrame:
    """L2-normalised points; zero vectors, which have no direction, drop."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return (points.withColumn("_n", norm).where("_n > 0")
            .select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v")))


def stack(series: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(x, float) for x in series])


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Euclidean or Manhattan distances by differences per dimension (exact zeros for copies)."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j][:, None] - b[:, j][None, :]
        out += np.abs(d) if metric == "manhattan" else d * d
    return out if metric == "manhattan" else np.sqrt(out)


def _sums(batches):
    """n, sums and products of all dimensions of a task, about its first point."""
    at, total, n = None, None, 0
    for pdf in batches:
        if len(pdf):
            v = stack(pdf["v"])
            at = v[0] if at is None else at
            v = v - at
            part = np.concatenate([v.sum(axis=0)[None], v.T @ v])
            total, n = part if total is None else total + part, n + len(v)
    if n:
        yield pd.DataFrame({"n": [n], "at": [at.tolist()], "total": [total.ravel().tolist()]})


def covariance(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of points(id, v) in one pass; a row per task reaches the driver, merged as it comes."""
    n, mean, cov = 0, None, None
    for r in points.select("v").mapInPandas(_sums, "n bigint, at array<double>, total array<double>").toLocalIterator():
        d = len(r["at"])
        total = np.array(r["total"]).reshape(d + 1, d)
        m = total[0] / r["n"]
        c = total[1:] / r["n"] - np.outer(m, m)
        m = m + np.array(r["at"])
        if not n:
            n, mean, cov = r["n"], m, c
        else:
            share, gap = r["n"] / (n + r["n"]), m - mean
            cov = (1 - share) * cov + share * c + share * (1 - share) * np.outer(gap, gap)
            mean, n = mean + share * gap, n + r["n"]
    return (mean, cov) if n else (np.zeros(0), np.zeros((0, 0)))


def _mapped(points: DataFrame, turn: np.ndarray) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pdf.assign(v=list(stack(pdf["v"]) @ turn)) if len(pdf) else pdf

    return points.select("id", "v").mapInPandas(run, "id string, v array<double>")


def mahalanobis_points(points: DataFrame) -> DataFrame:
    """Points whose Euclidean distances are the Mahalanobis distances of ``points`` under their population covariance.

    They are turned by the Cholesky factor of its inverse; where the covariance is singular, by its pseudo-inverse:
    directions without variance don't count.
    """
    mean, cov = covariance(points)
    if not len(mean):
        return points
    values, axes = np.linalg.eigh(cov)
    if values.min() > 1e-12 * max(values.max(), 0.0):
        turn = np.linalg.cholesky(np.linalg.inv(cov))
    else:
        some = values > 1e-12 * max(values.max(), 1e-300)
        turn = axes * np.where(some, 1 / np.sqrt(np.where(some, values, 1)), 0)
    return _mapped(points, turn)


def in_metric(points: DataFrame, metric: str, weights: list[float] | None = None) -> tuple[DataFrame, str]:
    """Points and the plain metric ("euclidean" or "manhattan") that measures ``metric`` between ``points``.

    "manhattan" takes a weight of at least 0 for each dimension (default 1).
    """
    if metric == "mahalanobis":
        return mahalanobis_points(points), "euclidean"
    if metric == "manhattan":
        if weights is None:
            return points, metric
        if min(weights) < 0:
            raise ValueError("weights must not be negative")
        return _mapped(points, np.diag(weights)), metric
    if metric == "euclidean":
        return points, metric
    raise ValueError(f"unknown metric {metric!r}")


@dataclass
class Cells:
    """Distinct weighted points with their block, plus cell geometry (bounded by the pivot count)."""
    points: DataFrame       # num, id, v, w, cell, blk; num counts the ids in their order
    pivots: np.ndarray
    radius: np.ndarray
    first_block: np.ndarray
    last_block: np.ndarray
    n: int
    metric: str = "euclidean"

    def gaps(self) -> np.ndarray:
        """What lies between two cells at least, a little less for rounding."""
        apart = distances(self.pivots, self.pivots, self.metric)
        return apart - (self.radius[:, None] + self.radius[None, :]) * (1 + 1e-9) - 1e-9 * (1 + apart)

    def partners(self, reach: np.ndarray | float) -> dict[int, list[int]]:
        """Block numbers each cell must meet; ``reach`` may differ per cell."""
        need = self.gaps() <= (np.asarray(reach, float)[:, None] if np.ndim(reach) else reach)
        need |= need.T
        ids = [np.arange(f, l + 1) for f, l in zip(self.first_block, self.last_block)]
        return {c: np.unique(np.concatenate([ids[d] for d in np.flatnonzero(need[c])])).tolist() for c in range(len(self.pivots))}

    def block_pairs(self, rows: DataFrame, reach) -> DataFrame:
        """Rows replicated to every block pair they take part in, keyed (bi, bj)."""
        p = self.partners(reach)
        table = rows.sparkSession.createDataFrame(list(p.items()), "cell int, other array<int>")
        return (rows.join(table, "cell").withColumn("other", F.explode("other"))
                .withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other"))


def distinct_points(points: DataFrame) -> DataFrame:
    return points.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("w"))


def _chain(pivots: np.ndarray, metric: str) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest one that is left."""
    apart = distances(pivots, pivots, metric)
    order = [0]
    apart[:, 0] = np.inf
    while len(order) < len(pivots):
        order.append(int(apart[order[-1]].argmin()))
        apart[:, order[-1]] = np.inf
    return np.array(order)


def make_cells(points: DataFrame, block: int | None = BLOCK, max_pivots: int = MAX_PIVOTS, seed: int = 42, metric: str = "euclidean") -> Cells:
    """Cells of points(id, v). Without ``block`` there are about 20 blocks, more past 20 of ``WIDE_BLOCK``."""
    distinct = materialize(number_rows(distinct_points(points), ["id"], "num"), "points")
    n = distinct.count()
    k = int(min(max_pivots, max(1, n // (2 * min(block or BLOCK, BLOCK)))))
    pivots = stack(distinct.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("v").toPandas()["v"]) \
        if n else np.zeros((1, 1))
    pivots = pivots[_chain(pivots, metric)]
    if block is None:
        most = max(BLOCK, WIDE_BLOCK * 64 // max(64, pivots.shape[1]))
        block = min(most, max(BLOCK, math.ceil(n / 20)))

    def nearest(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            d = distances(stack(pdf["v"]), pivots, metric)
            pdf["cell"] = d.argmin(1).astype("int32")
            pdf["dist"] = d.min(1)
            yield pdf

    placed = distinct.select("num", "v", "id", "w").mapInPandas(nearest, "num bigint, v array<double>, id string, w double, cell int, dist double")
    placed = materialize(placed, "cells")
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()}
    radius = np.array([stats[c]["r"] if c in stats else 0.0 for c in range(len(pivots))])
    size = np.array([stats[c]["n"] if c in stats else 0 for c in range(len(pivots))])
    start = np.cumsum(size) - size
    blocks = max(1, round(n / block))
    size_of = F.create_map(*[F.lit(x) for c in range(len(pivots)) for x in (c, int(max(size[c], 1)))])
    start_of = F.create_map(*[F.lit(x) for c in range(len(pivots)) for x in (c, int(start[c]))])
    place = F.element_at(start_of, F.col("cell")) + F.pmod(F.xxhash64("id"), F.element_at(size_of, F.col("cell")))
    blk = F.floor(place * F.lit(blocks) / F.lit(max(n, 1))).cast("int")
    first, last = start * blocks // max(n, 1), (start + np.maximum(size, 1) - 1) * blocks // max(n, 1)
    return Cells(placed.withColumn("blk", blk).drop("dist"), pivots, radius, first, last, n, metric)


@dataclass
class Estimate:
    """Estimates ``e`` of the distances between two tiles: a distance is at most u only if e <= ``allow(u)``, it is
    if e <= ``sure(u)``, and at most ``most(e)``."""
    e: np.ndarray
    step: float             # Manhattan: units of e; Euclidean: 0, e is squared
    slack: float
    off: float

    def allow(self, u):
        if self.step:
            return np.minimum(np.floor(u / self.step) + self.slack, 65535).astype("u2")
        return np.float32(1 + 1e-6) * ((u + self.off) ** 2 + self.slack).astype("f4")

    def sure(self, u: float) -> float:
        if self.step:
            return float(np.floor(u / self.step)) - self.slack
        return (max(u - self.off, 0.0) ** 2 - self.slack) * (1 - 1e-6)

    def most(self, e):
        if self.step:
            return (e.astype(float) + self.slack) * self.step
        return np.sqrt(np.maximum(e.astype(float), 0) + self.slack) * (1 + 1e-6) + self.off


def estimate(a: np.ndarray, b: np.ndarray, metric: str) -> Estimate | None:
    """None where numbers are too large or too many for an estimate.

    Euclidean: squares by one product in single precision about the tile's middle. Manhattan: coordinates are counted in
    steps of one size, so that the sum of |x - y| = x + y - 2 min(x, y) fits 16 bits.
    """
    dims = a.shape[1]
    top = max(np.abs(a).max(), np.abs(b).max())
    if not top < 1e15 or dims > 4096:
        return None
    if metric == "manhattan":
        low = np.minimum(a.min(0), b.min(0))
        wide = (np.maximum(a.max(0), b.max(0)) - low).sum()
        step = float(max(wide / 60000, top * 1e-12, 1e-290))
        x, y = ((np.floor((v - low) / step)).astype("u2").T.copy() for v in (a, b))
        total = x.sum(0, dtype="u2")[:, None] + y.sum(0, dtype="u2")[None, :]
        rows = max(1, 65536 // max(1, len(b)))
        w = np.empty((rows, len(b)), "u2")
        for s in range(0, len(a), rows):
            e, t = total[s:s + rows], w[:len(a) - s]
            less = np.zeros_like(e)
            for j in range(dims):
                np.minimum(x[j, s:s + rows, None], y[j], out=t)
                less += t
            less += less
            e -= less
        return Estimate(total, step, dims + 2, 0.0)
    mid = b.mean(0)
    a, b = a - mid, b - mid
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    x = np.concatenate([-2 * a, na[:, None], np.ones((len(a), 1))], 1).astype("f4")
    y = np.concatenate([b, np.ones((len(b), 1)), nb[:, None]], 1).astype("f4")
    return Estimate(x @ y.T, 0.0, 1.3e-7 * (dims + 8) * float(na.max() + nb.max()) + 1e-36, 4e-16 * math.sqrt(dims) * top)


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances row by row, added up in the order of ``distances``."""
    out = np.empty(len(a))
    for s in range(0, len(a), 4096):
        d = a[s:s + 4096] - b[s:s + 4096]
        d = np.abs(d, out=d) if metric == "manhattan" else np.multiply(d, d, out=d)
        out[s:s + 4096] = np.add.accumulate(d, axis=1, out=d)[:, -1]
    return out if metric == "manhattan" else np.sqrt(out)


def measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (x[i], y[j]), a slice at a time."""
    out = np.empty(len(i))
    for s in range(0, len(i), 65536):
        out[s:s + 65536] = pair_distances(x[i[s:s + 65536]], y[j[s:s + 65536]], metric)
    return out


class Rows:
    """Points of a block in a task: by cell, cut into tiles."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("cell")
        self.table, self.n = table, len(table)
        self.cell = self.column("cell")
        v = table["v"].combine_chunks()
        self.v = np.asarray(v.flatten().to_numpy(zero_copy_only=False), float).reshape(self.n, -1) if self.n else np.zeros((0, 1))
        self.tiles = []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.cell)) + 1, [self.n]]) if self.n else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            edges = np.linspace(lo, hi, math.ceil((hi - lo) / TILE) + 1).astype(int)
            self.tiles += [(int(self.cell[lo]), slice(s, t)) for s, t in zip(edges[:-1], edges[1:])]

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()


def row_sides(table: pa.Table) -> tuple[Rows, Rows, bool]:
    """The two blocks of a task and whether they are the same block."""
    lo, hi = table["bi"][0].as_py(), table["bj"][0].as_py()
    if lo == hi:
        a = Rows(table)
        return a, a, True
    blk = table["blk"].to_numpy()
    return Rows(table.filter(pa.array(blk == lo))), Rows(table.filter(pa.array(blk == hi))), False


def tile_pairs(a: Rows, b: Rows, same: bool):
    """Tiles of two blocks, each pair once: (cell, rows, cell, rows)."""
    for i, (c, s) in enumerate(a.tiles):
        for d, t in b.tiles[i:] if same else b.tiles:
            yield c, s, d, t
