"""Density clustering (DBSCAN, Ester et al. 1996), exact, over block pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.operators.points import Cells, Rows, distances, estimate, in_metric, make_cells, measured, row_sides, tile_pairs, unit_vectors
from rhopool.operators.upsert import number_rows
from rhopool.session import materialize


def _near_pairs(a: Rows, b: Rows, same: bool, eps: float, metric: str, gaps: np.ndarray):
    """Pairs (i, j) within eps tile by tile; within one tile of one block in both directions, and each point with itself."""
    for c, s, d, t in tile_pairs(a, b, same):
        if gaps[c, d] > eps:
            continue
        x, y = a.v[s], b.v[t]
        got = estimate(x, y, metric)
        if got is None:
            near = np.flatnonzero(distances(x, y, metric) <= eps)
        else:
            near = np.flatnonzero(got.e <= got.allow(np.float64(eps)))
            open_ = got.e.ravel()[near] > got.sure(eps)
            if open_.any():
                i, j = np.divmod(near[open_], len(y))
                open_[open_] = measured(x, y, i, j, metric) > eps
                near = near[~open_]
        if len(near):
            i, j = np.divmod(near, len(y))
            yield i + s.start, j + t.start, same and s == t


def _neighbour_counts(cells: Cells, eps: float) -> DataFrame:
    metric, gaps = cells.metric, cells.gaps()

    def count(table: pa.Table) -> pa.Table:
        a, b, same = row_sides(table)
        left = np.zeros(a.n)
        right = left if same else np.zeros(b.n)
        aw, bw = a.column("w"), b.column("w")
        for i, j, both in _near_pairs(a, b, same, eps, metric, gaps):
            left += np.bincount(i, bw[j], a.n)
            if not both:
                right += np.bincount(j, aw[i], b.n)
        out = [pa.table({"num": x.column("num"), "n": n}) for x, n in ((a, left), (b, right))[:1 if same else 2]]
        return pa.concat_tables(out)

    return (cells.block_pairs(cells.points.drop("id"), eps).groupBy("bi", "bj").applyInArrow(count, "num bigint, n double")
            .groupBy("num").agg(F.sum("n").alias("n")))


def _roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each node's component, by hooking roots to smaller ones with pointer jumping."""
    label = np.arange(n) if label is None else label
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        apart = low < high
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _links(cells: Cells, counts: DataFrame, eps: float) -> DataFrame:
    """(num, root, kind): a spanning forest of core points per task, and roots of the cores next to other points.

    Points without a neighbour but their copies link with nothing and are left out.
    """
    metric, gaps = cells.metric, cells.gaps()

    def link(table: pa.Table) -> pa.Table:
        a, b, same = row_sides(table)
        shift = 0 if same else a.n
        num, core = (np.concatenate([a.column(c), b.column(c)]) if not same else a.column(c) for c in ("num", "core"))
        label, border = np.arange(len(num)), []
        for i, j, both in _near_pairs(a, b, same, eps, metric, gaps):
            j = j + shift
            linked = core[i] & core[j]
            label = _roots(len(num), i[linked], j[linked], label)
            for x, y in ((i, j),) if both else ((i, j), (j, i)):
                some = ~core[x] & core[y]
                border.append((x[some], y[some]))
        hooked = np.flatnonzero(label != np.arange(len(num)))
        point, root = (np.concatenate(x) for x in zip(*border)) if border else (np.zeros(0, int), np.zeros(0, int))
        pairs = np.unique(np.stack([point, label[root]], 1), axis=0)
        return pa.table({"num": num[np.concatenate([hooked, pairs[:, 0]])], "root": num[np.concatenate([label[hooked], pairs[:, 1]])],
                         "kind": ["core"] * len(hooked) + ["border"] * len(pairs)},
                        pa.schema([("num", pa.int64()), ("root", pa.int64()), ("kind", pa.string())]))

    rows = materialize(cells.points.drop("id").join(counts.select("num", "n", "core"), "num").where("n > w").drop("n"), "linked")
    return cells.block_pairs(rows, eps).groupBy("bi", "bj").applyInArrow(link, "num bigint, root bigint, kind string")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) with label the smallest node of the component, from (a, b) edges.

    Each round takes the least neighbouring label and jumps once through the
    label's own label; rounds are stored, so lost executors replay one round.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label"))
                         .withColumnRenamed("a", "node"), "labels")
    while True:
        via = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
               .agg(F.min("label").alias("near")))
        step = labels.join(via, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialize(step.join(jump, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def dbscan(points: DataFrame, eps: float, min_samples: int, metric: str = "euclidean", block: int | None = None,
           weights: list[float] | None = None) -> DataFrame:
    """(id, cluster_label, is_core): noise is -1, clusters are numbered by their smallest member.

    A border point next to several clusters joins the one with the smallest
    member.  Cosine distance d equals Euclidean sqrt(2d) between unit vectors.
    Other metrics: euclidean, mahalanobis, and manhattan with ``weights``.
    """
    if metric == "cosine":
        work, radius, plain = unit_vectors(points), math.sqrt(2.0 * eps), "euclidean"
    else:
        (work, plain), radius = in_metric(points, metric, weights), eps
    work = materialize(work, "dbscan")
    cells = make_cells(work, block, metric=plain)
    core = materialize(_neighbour_counts(cells, radius).select("num", "n", (F.col("n") >= min_samples).alias("core")), "core")
    links = materialize(_links(cells, core, radius), "links")
    alone = core.where("core").select(F.col("num").alias("a"), F.col("num").alias("b"))
    comp = connected_components(links.where("kind = 'core'").select(F.col("num").alias("a"), F.col("root").alias("b")).union(alone))
    border = (links.where("kind = 'border'").join(comp, F.col("root") == F.col("node"))
              .groupBy("num").agg(F.min("label").alias("label")))
    named = comp.select(F.col("node").alias("num"), "label").unionByName(border)
    numbers = number_rows(comp.select("label").distinct(), ["label"], "cluster_label", start=0)
    named = named.join(numbers, "label").select("num", F.col("cluster_label").cast("int").alias("cluster_label"))
    # Copies take the label of their representative through the equal vector.
    reps = cells.points.select("v", "num").join(named, "num", "left").join(core, "num").select(
        "v", "cluster_label", F.col("core").alias("is_core"))
    out = work.join(reps, "v").select("id", F.coalesce("cluster_label", F.lit(-1)).alias("cluster_label"), "is_core")
    if metric == "cosine":
        out = points.select("id").join(out, "id", "left").select(
            "id", F.coalesce("cluster_label", F.lit(-1)).alias("cluster_label"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
    return out


def cosine_distance(a: str, b: str):
    """1 - cosine, clipped to [0, 2]; 1 when a side has no direction."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    cos = F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
    return F.least(F.greatest(F.lit(1.0) - cos, F.lit(0.0)), F.lit(2.0))
