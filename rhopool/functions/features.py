"""Derived features of a pair row. Each block needs its inputs and is skipped without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.operators.scaling import fill_median, null_nonfinite, numeric_columns

P_FLOOR = 1e-10



def both(x: Column, y: Column, fn) -> Column:
    """fn over two columns, NULL if either is missing."""
    return F.when(x.isNotNull() & y.isNotNull(), fn(x, y))


def effect_features() -> dict[str, Column]:
    x, y = F.col("dz_ss_mean"), F.col("dz_soth_mean")
    return {"effect_size_ratio": S.safe_ratio(x, y), "effect_size_diff": x - y, "effect_size_sum": x + y,
            "effect_size_product": x * y}


def p_features() -> dict[str, Column]:
    a, b = S.at_least("p_ss", P_FLOOR), S.at_least("p_soth", P_FLOOR)
    return {"log_p_ss": -F.log10(a), "log_p_soth": -F.log10(b),
            # exp(-X/2) of Fisher's X is the plain product; 1 when missing.
            "p_composite": F.coalesce(a * b, F.lit(1.0)),
            "p_harmonic_mean": S.div(F.lit(2.0), S.div(F.lit(1.0), a) + S.div(F.lit(1.0), b))}


def ci_features(c: str) -> dict[str, Column]:
    lo, hi = F.col(f"dz_{c}_ci_low"), F.col(f"dz_{c}_ci_high")
    width, center = hi - lo, (hi + lo) / 2.0
    return {f"ci_{c}_width": width, f"ci_{c}_center": center,
            f"ci_{c}_relative_width": S.div(width, F.abs(center) + P_FLOOR)}


def i2_features() -> dict[str, Column]:
    x, y = F.col("dz_ss_I2"), F.col("dz_soth_I2")
    return {"i2_ratio": S.safe_ratio(x, y), "i2_max": both(x, y, F.greatest), "i2_min": both(x, y, F.least),
            "i2_mean": (x + y) / 2.0}


def z_features() -> dict[str, Column]:
    x, y = F.col("dz_ss_z"), F.col("dz_soth_z")
    return {"z_composite": F.sqrt(x * x + y * y), "z_ratio": S.safe_ratio(F.abs(x), F.abs(y)), "z_sum": x + y,
            "z_product": x * y}


def study_features() -> dict[str, Column]:
    x, y = F.col("n_studies_ss"), F.col("n_studies_soth")
    ratio = S.safe_ratio(x, y)
    return {"total_studies": x + y, "study_ratio": ratio, "study_log_ratio": F.log(ratio + P_FLOOR)}


def q_features() -> dict[str, Column]:
    a, b = S.at_least("q_ss", P_FLOOR), S.at_least("q_soth", P_FLOOR)
    harmonic = S.div(F.lit(2.0), S.div(F.lit(1.0), a + P_FLOOR) + S.div(F.lit(1.0), b + P_FLOOR))
    return {"log_q_ss": -F.log10(a), "log_q_soth": -F.log10(b), "q_composite": F.coalesce(harmonic, F.lit(1.0)),
            "q_max": both(a, b, F.greatest), "q_min": both(a, b, F.least)}


BLOCKS = [
    (["dz_ss_mean", "dz_soth_mean"], effect_features),
    (["p_ss", "p_soth"], p_features),
    (["dz_ss_ci_low", "dz_ss_ci_high"], lambda: ci_features("ss")),
    (["dz_soth_ci_low", "dz_soth_ci_high"], lambda: ci_features("soth")),
    (["dz_ss_I2", "dz_soth_I2"], i2_features),
    (["dz_ss_z", "dz_soth_z"], z_features),
    (["n_studies_ss", "n_studies_soth"], study_features),
    (["q_ss", "q_soth"], q_features),
]


def derived_features(df: DataFrame, absolute: bool = True) -> DataFrame:
    """Inputs (median-filled) + derived columns (from the unfilled inputs) + ``_abs`` of every numeric column."""
    nums = numeric_columns(df)
    new: dict[str, Column] = {}
    for needs, block in BLOCKS:
        if all(c in df.columns for c in needs):
            new |= block()
    augmented = df.withColumns(new)
    augmented = null_nonfinite(augmented, [c for c in nums if dict(df.dtypes)[c] in ("double", "float")])
    augmented = fill_median(augmented, nums)
    if not absolute:
        return augmented
    skip = ("pair_id", "GeneAKey", "GeneBKey")
    return augmented.withColumns({f"{c}_abs": F.abs(c) for c in numeric_columns(augmented, skip)})


def two_condition_features(df: DataFrame) -> DataFrame:
    """Combined p, effect and z of the two contrasts, power, and their difference."""
    for c in ("ss", "soth"):
        df = S.add_signed_z(df, f"p_{c}", f"dz_{c}_mean", f"dz_{c}_z")
    df = df.withColumns({
        "combined_p_value": F.sqrt(F.col("p_ss") * F.col("p_soth")),
        "combined_effect_size": F.sqrt(F.col("abs_dz_ss") * F.col("abs_dz_soth")),
        "delta_effect_size": F.col("dz_soth_mean") - F.col("dz_ss_mean")})
    cz2 = F.col("dz_ss_z") * F.col("dz_ss_z") + F.col("dz_soth_z") * F.col("dz_soth_z")
    return df.withColumns({"combined_z_score": F.sqrt(cz2), "statistical_power": S.div(cz2, cz2 + 1.0),
                           "abs_delta_effect_size": F.abs("delta_effect_size")})
