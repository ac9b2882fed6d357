"""K-means distance, Gaussian mixture and PCA on the built-in ML estimators."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.operators.scaling import num
from rhopool.session import materialize



def _vectors(points: DataFrame) -> DataFrame:
    return points.select("id", "v", array_to_vector("v").alias("features"))


def kmeans_distance(points: DataFrame, k: int = 5, seed: int = 42, n_init: int = 10, max_iter: int = 20) -> DataFrame:
    """(id, kmeans_label, center_distance); the cheapest of ``n_init`` runs."""
    data = materialize(_vectors(points), "kmeans")
    n = points.count()
    best = None
    for i in range(n_init):
        model = KMeans(k=max(1, min(k, n)), seed=seed + i, maxIter=max_iter, predictionCol="kmeans_label").fit(data)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    centers = best[1].clusterCenters()
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    out = best[1].transform(data)
    own = F.element_at(table, F.col("kmeans_label") + 1)
    d = F.sqrt(F.aggregate(F.zip_with("v", own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return out.select("id", "kmeans_label", d.alias("center_distance"))


def mixture(points: DataFrame, k: int = 3, seed: int = 42, max_iter: int = 100, tol: float = 1e-3) -> DataFrame:
    """(id, gmm_label, gmm_confidence); label 0 with confidence 1 where a component has no spread at all."""
    data = _vectors(points)
    try:
        model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=tol, predictionCol="gmm_label",
                                probabilityCol="prob").fit(data)
    except Exception as e:  # without any spread the mixture is undefined; every other failure is the caller's
        if "singular" not in str(e):
            raise
        return points.select("id", F.lit(0).alias("gmm_label"), F.lit(1.0).alias("gmm_confidence"))
    return model.transform(data).select("id", "gmm_label", F.array_max(vector_to_array("prob")).alias("gmm_confidence"))


def _row_array(cols: list[str], have: set[str]):
    """The columns as one array; a missing value or column counts as 0."""
    return F.expr("array(" + ", ".join(f"coalesce(cast(`{c}` as double), 0D)" if c in have else "0D" for c in cols) + ")")


class PrincipalComponents:
    """Centred PCA with a fixed sign: the largest loading of every component is positive."""

    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, df: DataFrame, cols: list[str]) -> "PrincipalComponents":
        self.cols = list(cols)
        k = min(self.k, len(cols))
        v = _row_array(cols, set(cols))
        data = df.select(array_to_vector(v).alias("features"))
        model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
        row = data.select(Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("s")).first()["s"]
        comps = np.asarray(model.pc.toArray())
        sign = np.sign(comps[np.abs(comps).argmax(0), np.arange(k)])
        self.components = comps * np.where(sign == 0, 1.0, sign)
        self.mean = np.asarray(row["mean"].toArray())
        self.ratio = np.asarray(model.explainedVariance.toArray())
        self.variance = self.ratio * float(row["variance"].toArray().sum())
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds pc_1..pc_k; a missing feature column or value counts as 0."""
        out = df.withColumn("_v", _row_array(self.cols, set(df.columns)))
        pcs = {}
        for i in range(self.components.shape[1]):
            w = "array(" + ", ".join(num(x) for x in self.components[:, i]) + ")"
            pcs[f"pc_{i + 1}"] = F.expr(f"aggregate(zip_with(_v, {w}, (a, b) -> a * b), 0D, (s, x) -> s + x)"
                                        f" - {num(self.mean @ self.components[:, i])}")
        return out.withColumns(pcs).drop("_v")

    def loadings(self, spark) -> DataFrame:
        """(feature, component, loading), loading = weight * sqrt(variance)."""
        load = self.components * np.sqrt(np.maximum(self.variance, 0.0))
        rows = [(c, j + 1, float(load[i, j])) for i, c in enumerate(self.cols) for j in range(load.shape[1])]
        return spark.createDataFrame(rows, "feature string, component int, loading double")

    def summary(self, spark) -> DataFrame:
        """(component, explained, cumulative)."""
        cum = np.cumsum(self.ratio)
        return spark.createDataFrame([(j + 1, float(r), float(c)) for j, (r, c) in enumerate(zip(self.ratio, cum))],
                                     "component int, explained double, cumulative double")
