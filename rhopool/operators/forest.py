"""Isolation forest (Liu, Ting and Zhou 2008).

Trees see a fixed number of rows each, so growing costs the same at any table
size: the pool they draw from is the trees x subsample rows with the smallest
hash, and each tree is sent its own subsample only.  One task grows one tree; the forest (at most trees x 2 x subsample
nodes) is small enough to travel with the scoring tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rhopool.operators.points import stack
from rhopool.operators.scaling import exact_quantiles
from rhopool.session import materialize


def average_path(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes as (feature, cut, left, right, path): feature -1 marks a leaf whose path is the expected depth."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            p = list(nodes[parent])
            p[2 + side] = me
            nodes[parent] = tuple(p)
        sub = x[rows]
        lo, hi = sub.min(0), sub.max(0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((-1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        if cut >= hi[f]:  # rounding between neighbouring doubles must not empty the right side
            cut = float(lo[f])
        nodes.append((f, cut, -1, -1, 0.0))
        left = sub[:, f] <= cut
        todo += [(rows[left], depth + 1, me, 0), (rows[~left], depth + 1, me, 1)]
    return nodes


class IsolationForest:
    """``fit`` on points (id, v), ``score`` any points of the same width."""

    def __init__(self, trees: int = 100, subsample: int = 256, seed: int = 42):
        self.trees, self.subsample, self.seed = trees, subsample, seed
        self.forest: list[np.ndarray] | None = None
        self.psi = 0

    def fit(self, points: DataFrame) -> "IsolationForest":
        pool = materialize(points.orderBy(F.xxhash64("id", F.lit(self.seed)), "id").limit(self.trees * self.subsample)
                           .select("id", "v", F.monotonically_increasing_id().alias("pos")), "pool")
        # Draws are made on ids alone; only the rows drawn meet their vectors.
        draws = (pool.select("id", "pos", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"))
                 .withColumn("h", F.xxhash64("id", "tree", F.lit(self.seed)))
                 .withColumn("place", F.row_number().over(W.partitionBy("tree").orderBy("h", "id", "pos")))
                 .where(F.col("place") <= self.subsample))
        drawn = draws.select("tree", "place", "pos").join(pool.select("pos", "v"), "pos")
        seed = self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tree"].iloc[0])
            x = stack(pdf.sort_values("place")["v"])
            limit = max(1, math.ceil(math.log2(max(len(x), 2))))
            nodes = _grow(x, limit, np.random.default_rng([seed, t]))
            out = pd.DataFrame(nodes, columns=["f", "cut", "l", "r", "path"])
            out["tree"], out["node"], out["psi"] = t, np.arange(len(out)), len(x)
            return out[["tree", "node", "f", "cut", "l", "r", "path", "psi"]]

        got = drawn.groupBy("tree").applyInPandas(
            grow, "tree int, node int, f int, cut double, l int, r int, path double, psi int").toPandas()
        if got.empty:
            raise ValueError("no points to fit on")
        got = got.sort_values(["tree", "node"])
        self.psi = int(got["psi"].iloc[0])
        self.forest = [g[["f", "cut", "l", "r", "path"]].to_numpy(float) for _, g in got.groupby("tree")]
        return self

    def score(self, points: DataFrame) -> DataFrame:
        """(id, isolation_score) in (0, 1); larger is more anomalous."""
        if self.forest is None:
            raise ValueError("fit the forest first")
        forest, norm = self.forest, average_path(self.psi) or 1.0

        def run(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                x = stack(pdf["v"])
                depth = np.zeros(len(x))
                for t in forest:
                    at = np.zeros(len(x), int)
                    while True:
                        f = t[at, 0].astype(int)
                        inner = f >= 0
                        if not inner.any():
                            break
                        go = x[np.flatnonzero(inner), f[inner]] <= t[at[inner], 1]
                        at[inner] = np.where(go, t[at[inner], 2], t[at[inner], 3]).astype(int)
                    depth += t[at, 4]
                yield pd.DataFrame({"id": pdf["id"], "isolation_score": 2.0 ** (-depth / len(forest) / norm)})

        return points.mapInPandas(run, "id string, isolation_score double")


def flag_outliers(scores: DataFrame, contamination: float | str = "auto") -> DataFrame:
    """Adds is_outlier: score above 0.5 (auto) or above the (1 - contamination) quantile."""
    cut = 0.5 if contamination == "auto" else \
        exact_quantiles(scores, ["isolation_score"], [1.0 - float(contamination)])["isolation_score"][0]
    return scores.withColumn("is_outlier", F.col("isolation_score") > F.lit(float(cut)))
