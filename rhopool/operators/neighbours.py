"""Local outlier factor (Breunig et al. 2000) and silhouette, exact, over block pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.operators.points import BLOCK, WIDE_BLOCK, Cells, distances, estimate, in_metric, make_cells, measured, row_sides, tile_pairs
from rhopool.session import materialize

_CAND = "num bigint, d array<double>, n array<bigint>, w array<double>"
#: Points whose candidates are merged in one group.
_MERGED = 4096
#: Members on each side of a tile of distances, and sums of distances that a task holds for a block.
_SIDE, _SUMS = 512, 1 << 24


class _Best:
    """The nearest others of ``size`` rows that cover weight k; no farther than ``u``, which falls as they come in."""

    def __init__(self, size: int, u: np.ndarray, k: int):
        self.size, self.u, self.k = size, u.copy(), k
        self.found, self.held, self.limit = [], 0, 2 * k * size + (1 << 18)

    def add(self, row: np.ndarray, d: np.ndarray, num: np.ndarray, w: np.ndarray) -> None:
        near = d <= self.u[row]
        self.found.append((row[near], d[near], num[near], w[near]))
        self.held += len(self.found[-1][0])
        if self.held > self.limit:
            self.cut()

    def cut(self):
        """(row, d, num, w, weight before) by row, distance and number, as far as weight k needs them."""
        row, d, num, w = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((num, d, row))
        row, d, num, w = row[order], d[order], num[order], w[order]
        before = np.cumsum(w) - w
        before -= before[np.searchsorted(row, row)]
        need = before < self.k
        row, d, num, w, before = row[need], d[need], num[need], w[need], before[need]
        full = before + w >= self.k
        self.u[row[full]] = d[full]
        self.found, self.held = [(row, d, num, w)], len(row)
        return row, d, num, w, before


def _lists(row: np.ndarray, size: int, *columns: np.ndarray) -> list[pa.Array]:
    edges = np.searchsorted(row, np.arange(size + 1)).astype("i4")
    return [pa.ListArray.from_arrays(pa.array(edges), pa.array(c)) for c in columns]


def _knn_kernel(k: int, metric: str, gaps: np.ndarray):
    """Per row of a task's blocks the closest others of the other block (or of its own) covering weight k and no farther
    than the row's bound ``u``; own copies count as w - 1 at distance 0."""
    def kernel(table: pa.Table) -> pa.Table:
        a, b, same = row_sides(table)
        best = {}
        for x in (a, b):
            x.num, x.w = x.column("num"), x.column("w")
            best[id(x)] = best.get(id(x)) or _Best(x.n, x.column("u"), k)
        left, right = best[id(a)], best[id(b)]
        if same:
            copies = np.flatnonzero(a.w > 1)
            left.add(copies, np.zeros(len(copies)), a.num[copies], a.w[copies] - 1)
        for c, s, d, t in tile_pairs(a, b, same):
            us, ut, own = left.u[s], right.u[t], same and s == t
            if gaps[c, d] > max(us.max(), ut.max()):
                continue
            x, y = a.v[s], b.v[t]
            got = estimate(x, y, metric)
            if got is None:
                i, j = np.divmod(np.arange(len(x) * len(y)), len(y))
            else:
                # Where nothing bounds a row yet, its k + 1 smallest estimates do: one of them may be the row itself.
                for u, e in ((us, got.e), (ut, got.e.T)):
                    free = np.flatnonzero(np.isinf(u))
                    if len(free) and e.shape[1] > k:
                        u[free] = got.most(np.partition(e[free], k, axis=1)[:, k])
                mask = got.e <= got.allow(us)[:, None]
                if not own:
                    mask |= got.e <= got.allow(ut)
                i, j = np.divmod(np.flatnonzero(mask), len(y))
            if own:
                i, j = i[i != j], j[i != j]
            dist = measured(x, y, i, j, metric)
            i, j = i + s.start, j + t.start
            left.add(i, dist, b.num[j], b.w[j])
            if not own:
                right.add(j, dist, a.num[i], a.w[i])
        out = []
        for x in (a,) if same else (a, b):
            row, d, num, w, _ = best[id(x)].cut()
            out.append(pa.table([pa.array(x.num), *_lists(row, x.n, d, num, w)], ["num", "d", "n", "w"]))
        return pa.concat_tables(out)
    return kernel


def _flat(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Numbers repeated for their candidates, and the candidates' columns."""
    lists = [table[c].combine_chunks() for c in ("d", "n", "w")]
    length = np.diff(lists[0].offsets.to_numpy())
    return np.repeat(table["num"].to_numpy(), length), *(x.flatten().to_numpy() for x in lists)


def _merge_kernel(k: int):
    def merge(table: pa.Table) -> pa.Table:
        num, row = np.unique(table["num"].to_numpy(), return_inverse=True)
        flat, d, n, w = _flat(table)
        best = _Best(len(num), np.full(len(num), np.inf), k)
        best.found = [(np.searchsorted(num, flat), d, n, w)]
        row, d, n, w, before = best.cut()
        return pa.table([pa.array(num), pa.array(best.u), *_lists(row, len(num), d, n, np.minimum(w, k - before))], ["num", "kdist", "d", "n", "m"])
    return merge


def nearest(cells: Cells, k: int) -> DataFrame:
    """(num, kdist, d, n, m): the k nearest others by weight, their distances, numbers and multiplicities.

    Distances inside the own block bound each point's reach first; only cells
    within that reach are compared, and a task keeps only candidates inside
    the point's own bound, which keeps the result exact.
    """
    gaps = cells.gaps()
    kernel = _knn_kernel(k, cells.metric, gaps)
    points = cells.points.drop("id")
    own = materialize(points.withColumns({"bi": F.col("blk"), "bj": F.col("blk"), "u": F.lit(float("inf"))})
                      .groupBy("bi", "bj").applyInArrow(kernel, _CAND), "own")
    found = own
    if int(cells.last_block.max()) > 0:
        total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
        bound = F.when(total >= k, F.element_at("d", -1)).otherwise(F.lit(float("inf")))
        bounded = materialize(points.join(own.select("num", bound.alias("u")), "num"), "bounded")
        reach = {r["cell"]: r["u"] for r in bounded
                 .groupBy("cell").agg(F.max("u").alias("u")).collect()}
        reach = np.array([reach.get(c, 0.0) for c in range(len(cells.pivots))])
        others = cells.block_pairs(bounded, reach).where("bi < bj").groupBy("bi", "bj").applyInArrow(kernel, _CAND)
        found = own.unionByName(others.where("size(d) > 0"))
    return (found.withColumn("part", F.floor(F.col("num") / F.lit(_MERGED))).groupBy("part")
            .applyInArrow(_merge_kernel(k), "num bigint, kdist double, d array<double>, n array<bigint>, m array<double>"))


def local_outlier_factor(points: DataFrame, k: int = 20, block: int | None = None, metric: str = "euclidean",
                         weights: list[float] | None = None) -> DataFrame:
    """(id, lof) with k capped at n - 1; metrics: euclidean, mahalanobis, and manhattan with ``weights``."""
    points, plain = in_metric(points, metric, weights)
    points = materialize(points, "lof")
    cells = make_cells(points, block, metric=plain)
    n = points.count()
    k = min(k, n - 1)
    if k < 1:
        return points.select("id", F.lit(0.0).alias("lof"))
    knn = materialize(nearest(cells, k), "knn")
    pairs = knn.select("num", F.inline(F.arrays_zip("d", "n", "m")))
    kd = knn.select(F.col("num").alias("n"), F.col("kdist").alias("okd"))
    lrd = materialize(pairs.join(kd, "n").groupBy("num").agg(
        (1.0 / (F.sum(F.col("m") * F.greatest("okd", "d")) / F.lit(float(k)) + F.lit(1e-10))).alias("lrd")), "lrd")
    lof = (pairs.join(lrd.select(F.col("num").alias("n"), F.col("lrd").alias("olrd")), "n")
           .groupBy("num").agg((F.sum(F.col("m") * F.col("olrd")) / F.lit(float(k))).alias("s"))
           .join(lrd, "num").select("num", (F.col("s") / F.col("lrd")).alias("lof")))
    by_vector = cells.points.select("v", "num").join(lof, "num").select("v", "lof")
    return points.join(by_vector, "v").select("id", "lof")


def _tile_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by one product about the tile's middle; those that it would blur are measured by differences."""
    mid = y.mean(0)
    a, b = x - mid, y - mid
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d = np.concatenate([-2 * a, na[:, None], np.ones((len(a), 1))], 1) @ np.concatenate([b, np.ones((len(b), 1)), nb[:, None]], 1).T
    top = 1e-4 * (na.max() + nb.max())
    if not top < 1e300:
        return distances(x, y)
    blurred = np.flatnonzero(d <= top)
    if len(blurred) > d.size // 16:
        blurred = np.flatnonzero(d <= 1e-4 * (na[:, None] + nb))
    if len(blurred) > d.size // 4:
        return distances(x, y)
    i, j = np.divmod(blurred, len(y))
    d.flat[blurred] = 0.0
    np.sqrt(d, out=d)
    d.flat[blurred] = measured(x, y, i, j, "euclidean")
    return d


class _Labelled:
    """Members of a block by label and number, with the distance sums of each to every label."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("lab", "ascending"), ("num", "ascending")])
        self.n = len(table)
        self.num, self.lab, self.m = (table[c].to_numpy() for c in ("num", "lab", "m"))
        self.v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1) if self.n else np.zeros((0, 1))
        self.sums: dict[int, np.ndarray] = {}

    def slices(self):
        return [slice(s, min(s + _SIDE, self.n)) for s in range(0, self.n, _SIDE)]

    def add(self, s: slice, d: np.ndarray, other: "_Labelled", t: slice) -> None:
        lab = other.lab[t]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(lab)) + 1, [len(lab)]])
        for lo, hi in zip(starts[:-1], starts[1:]):
            if lab[lo] not in self.sums:
                self.sums[lab[lo]] = np.zeros(self.n)
            self.sums[lab[lo]][s] += d[:, lo:hi] @ other.m[t][lo:hi]


def _label_sums(table: pa.Table) -> pa.Table:
    """Per block of a task and label of the other one, the block's points and their sums of distances."""
    lo, hi = table["bi"][0].as_py(), table["bj"][0].as_py()
    blk = table["blk"].to_numpy()
    a = _Labelled(table.filter(pa.array(blk == lo)))
    b = a if lo == hi else _Labelled(table.filter(pa.array(blk == hi)))
    for i, s in enumerate(a.slices()):
        for t in b.slices()[i if a is b else 0:]:
            d = _tile_distances(a.v[s], b.v[t])
            a.add(s, d, b, t)
            if a is not b or s != t:
                b.add(t, d.T, a, s)
    out = []
    for number, x in ((lo, a),) if a is b else ((lo, a), (hi, b)):
        num, first = np.unique(x.num, return_index=True)
        out += [(number, int(lab), num, s[first]) for lab, s in x.sums.items()]
    return pa.table([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                     pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.list_(pa.float64()))],
                    ["blk", "other", "num", "s"])


def _added(table: pa.Table) -> pa.Table:
    s = table["s"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(0)
    return pa.table([table["other"].slice(0, 1).combine_chunks(), table["num"].slice(0, 1).combine_chunks(), pa.array([s], pa.list_(pa.float64()))], ["other", "num", "s"])


def silhouette(points: DataFrame, labels: DataFrame, label: str = "cluster_label", block: int | None = None) -> DataFrame:
    """One row (n_labels, silhouette): plain Euclidean mean silhouette; noise is a label; -1 below two labels.

    Tasks emit distance sums per block and label, never pairs.  Work is
    quadratic by definition.
    """
    sizes = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("other")).agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "sizes")
    cells = make_cells(points, block)
    # A task holds a sum for each point and label.
    if block is None and sizes.count() * WIDE_BLOCK > _SUMS:
        cells = make_cells(points, max(BLOCK, _SUMS // sizes.count()))
    tag = points.join(labels.select("id", F.col(label).alias("lab")), "id")
    # Copies may carry different labels, so weights are kept per label.
    members = tag.groupBy("v", "lab").agg(F.count(F.lit(1)).cast("double").alias("m"))
    rows = materialize(cells.points.join(members, "v").select("num", "v", "lab", "m", "cell", "blk"), "members")
    parts = (cells.block_pairs(rows.where("lab is not null"), float("inf")).drop("cell").groupBy("bi", "bj")
             .applyInArrow(_label_sums, "blk int, other int, num array<bigint>, s array<double>"))
    per = (parts.groupBy("blk", "other").applyInArrow(_added, "other int, num array<bigint>, s array<double>")
           .select("other", F.inline(F.arrays_zip("num", "s"))).join(sizes, "other"))
    mine = rows.select("num", "lab", "m").join(per, "num", "left")
    own = F.col("other") == F.col("lab")
    score = mine.groupBy("num", "lab", "m").agg(
        F.max(F.when(own, F.col("n"))).alias("n"),
        F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    s = F.when(F.col("n") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    total = score.agg(F.sum(F.col("m") * s).alias("t"), F.sum("m").alias("w"), F.countDistinct("lab").alias("n_labels"))
    return total.select("n_labels", F.when(F.col("n_labels") > 1, F.col("t") / F.col("w")).otherwise(-1.0).alias("silhouette"))


def calinski_harabasz(points: DataFrame, labels: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Between/within dispersion ratio from per-label, per-dimension moments only."""
    rows = points.join(labels.select("id", F.col(label).alias("lab")), "id").select("lab", F.posexplode("v"))
    per = rows.groupBy("lab", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("col").alias("m"), F.var_pop("col").alias("s2"))
    dims = per.groupBy("pos").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    j = per.join(dims, "pos")
    d = F.col("m") - F.col("g")
    agg = j.agg(F.sum(F.col("n") * d * d).alias("between"), F.sum(F.col("n") * F.col("s2")).alias("within"),
                F.countDistinct("lab").alias("k"), F.sum(F.when(F.col("pos") == 0, F.col("n"))).alias("n"))
    ratio = F.try_divide(F.try_divide("between", F.col("k") - 1), F.try_divide("within", F.col("n") - F.col("k")))
    return agg.select(F.col("k").alias("n_labels"), ratio.alias("calinski_harabasz"))
