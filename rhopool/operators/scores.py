"""Composite scores of the pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.operators.clean import same_pair
from rhopool.operators.scaling import fill_zero, minmax, scalars

# Features of the metrics score.
SCORE_FEATURES = ["neglog_q_ss", "abs_dz_ss", "kappa_ss", "neglog_q_soth", "abs_dz_soth", "kappa_soth",
                  "combined_effect_size", "power_score", "consistency_score", "direction_consistency",
                  "magnitude_consistency"]


def _mean_of_scaled(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Mean of the min-max scaled columns as one new column."""
    tmp = {c: f"_n_{c}" for c in cols}
    total = sum((F.col(t) for t in tmp.values()), F.lit(0.0))
    return minmax(df, tmp).withColumn(name, total / F.lit(float(len(cols)))).drop(*tmp.values())


def metrics_score(df: DataFrame) -> DataFrame:
    """Mean of eleven min-max scaled evidence columns; a missing value counts as 0."""
    raw = [c for c in SCORE_FEATURES if not c.startswith("neglog")] + ["q_ss", "q_soth"]
    absent = {c: F.lit(0.0) for c in raw if c not in df.columns}
    df = fill_zero(df.withColumns(absent), raw)
    df = df.withColumns({"neglog_q_ss": S.neglog10("q_ss"), "neglog_q_soth": S.neglog10("q_soth")})
    return _mean_of_scaled(df, SCORE_FEATURES, "metrics_score")


def unsupervised_score(df: DataFrame, cols: tuple[str, ...] = ("isolation_score", "lof", "center_distance")) -> DataFrame:
    """Mean of the min-max scaled anomaly scores."""
    return _mean_of_scaled(df, list(cols), "unsupervised_score")


def new_rank_score(df: DataFrame) -> DataFrame:
    return df.withColumn("new_rank_score", (F.col("unsupervised_score") + F.col("metrics_score")) / 2.0)


def baseline_similarity(df: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """1 - d/max(d), d the distance to the baseline pair in the plane of the two effects."""
    base = df.where(same_pair("GeneAName", "GeneBName", *pair)).select("pair_id", "dz_ss_mean", "dz_soth_mean")
    if base.isEmpty():
        raise ValueError(f"baseline pair {pair} is not in the table")
    ref = scalars(base, x=F.min_by("dz_ss_mean", "pair_id"), y=F.min_by("dz_soth_mean", "pair_id"))
    dx, dy = F.col("dz_ss_mean") - ref["x"], F.col("dz_soth_mean") - ref["y"]
    d = df.withColumn("_d", F.sqrt(dx * dx + dy * dy))
    top = scalars(d, m=F.max("_d"))["m"]
    return d.withColumn("baseline_similarity", F.when(top > 0, 1.0 - S.div("_d", top)).otherwise(F.lit(1.0))).drop("_d")
