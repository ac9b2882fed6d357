"""Agreement between clusterings and scores derived from labels."""

from __future__ import annotations

from decimal import Decimal
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.operators.scaling import minmax


def consensus(df: DataFrame, labels: list[str], min_methods: int | None = None) -> DataFrame:
    """Adds is_high_confidence: another row shares a non-noise label in at least ``min_methods`` methods.

    Rows agree in a set of methods exactly when they share that set's label
    tuple, so each set needs one count per tuple instead of a row-by-row matrix.
    """
    need = min_methods or len(labels)
    flags = F.lit(False)
    out = df
    for i, pick in enumerate(combinations(labels, need)):
        counts = df.groupBy(*pick).agg((F.count(F.lit(1)) > 1).alias(f"_many{i}"))
        real = F.lit(True)
        for c in pick:
            real = real & (F.col(c) != -1)
        out = out.join(counts, list(pick), "left")
        flags = flags | (real & F.coalesce(F.col(f"_many{i}"), F.lit(False)))
    return out.withColumn("is_high_confidence", flags).select(*df.columns, "is_high_confidence")


def consensus_summary(df: DataFrame, labels: list[str]) -> DataFrame:
    """Mean agreement over all ordered pairs of rows (diagonal counts 0), from label sizes alone."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = None
    for c in labels:
        one = df.where(F.col(c) != -1).groupBy(F.col(c).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("size")).select("size")
        sizes = one if sizes is None else sizes.unionByName(one)
    pairs = F.coalesce(F.sum(F.col("size").cast("double") * (F.col("size") - 1)), F.lit(0.0))
    return sizes.agg(pairs.alias("p")).select(S.div("p", F.lit(float(len(labels))) * n * n).alias("mean_consensus"))


def consensus_distribution(df: DataFrame, labels: list[str]) -> DataFrame:
    """(agreement, cells): how many cells of the row-by-row matrix have each number of agreeing methods, 0 to all.

    A cell counts the methods in which two rows share a label other than -1; the diagonal has 0. No pairs are made: the
    rows of each label tuple are counted for every set of methods, which gives the ordered pairs that agree in at least
    that set, and inclusion and exclusion turns these into pairs that agree in exactly so many. One number for each set
    of methods reaches the driver.
    """
    square = F.sum((F.col("n").cast("decimal(38,0)") * (F.col("n") - 1)).cast("decimal(38,0)"))
    tuples = df.groupBy(*[F.col(c).cast("long").alias(c) for c in labels]).agg(F.count(F.lit(1)).alias("n"))
    rows = int(tuples.agg(F.sum("n").alias("n")).first()["n"] or 0)
    at_least = [rows * (rows - 1)]
    for size in range(1, len(labels) + 1):
        total = 0
        for pick in combinations(labels, size):
            real = tuples.where(" and ".join(f"`{c}` <> -1" for c in pick)).groupBy(*pick).agg(F.sum("n").alias("n"))
            total += int(real.agg(square.alias("p")).first()["p"] or 0)
        at_least.append(total)
    exactly = [sum((-1) ** (j - k) * comb(j, k) * at_least[j] for j in range(k, len(at_least))) for k in range(len(at_least))]
    exactly[0] += rows
    return df.sparkSession.createDataFrame([(k, Decimal(v)) for k, v in enumerate(exactly)], "agreement int, cells decimal(38,0)")


def cluster_density(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Adds density: 1 / cluster size, 0 for noise."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    return df.join(sizes, label).withColumn(
        "density", F.when(F.col(label) == -1, F.lit(0.0)).otherwise(S.div(F.lit(1.0), "_size"))).drop("_size")


def ml_score(df: DataFrame, anomaly: str = "isolation_score", confidence: str = "gmm_confidence",
             label: str = "cluster_label", variant: str = "current") -> DataFrame:
    """Adds ml_score in [0, 1]: thirds of scaled anomaly, density and scaled mixture confidence;
    ``variant="earlier"``: 0.7 anomaly + 0.3 density."""
    d = minmax(cluster_density(df, label), {anomaly: "_a", confidence: "_g"}, eps=None)
    if variant == "earlier":
        v = 0.7 * F.col("_a") + 0.3 * F.col("density")
    else:
        v = (F.col("_a") + F.col("density") + F.col("_g")) / 3.0
    return d.withColumn("ml_score", S.clip(v, 0.0, 1.0)).drop("_a", "_g")
