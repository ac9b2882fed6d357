"""Statistical column functions.

Every division is guarded: under ANSI mode a bare ``/`` on data raises.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rational approximation of the normal upper tail
# (Hart 1968, as given by West 2005).
TAIL_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
TAIL_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
TAIL_SPLIT = 7.07106781186547
TAIL_ZERO = 37.0
SQRT_2PI = 2.506628274631

# Rational approximation of the normal quantile (Acklam 2003).
Q_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
       1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
Q_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
       6.680131188771972e+01, -1.328068155288572e+01, 1.0]
Q_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
       -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
Q_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
       3.754408661907416e+00, 1.0]
Q_LOW = 0.02425

# Fixed values of the analysis.
Z_975 = 1.959963984540054
RHO_CLIP = 0.999999


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _horner(coef: list[float], x: Column) -> Column:
    acc = F.lit(coef[0])
    for c in coef[1:]:
        acc = acc * x + F.lit(c)
    return acc


def finite(x) -> Column:
    """Map NaN and +-Inf to NULL; NULL is the only missing value inside the engine."""
    c = _c(x).cast("double")
    return F.when(c * F.lit(0.0) == F.lit(0.0), c)


def div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def fisher_z(r) -> Column:
    c = F.least(F.greatest(_c(r), F.lit(-RHO_CLIP)), F.lit(RHO_CLIP))
    c = F.when(_c(r).isNotNull(), c)
    return F.lit(0.5) * F.log((F.lit(1.0) + c) / (F.lit(1.0) - c))


def effective_n(n) -> Column:
    return F.when(_c(n) > 3, (_c(n) - 3).cast("double"))


def inverse_or_zero(x) -> Column:
    """1/x for x > 0, otherwise 0."""
    return F.coalesce(F.when(_c(x) > 0, div(F.lit(1.0), _c(x))), F.lit(0.0))


def normal_tail(a) -> Column:
    """P(Z > a) for a >= 0."""
    a = _c(a)
    gauss = F.exp(-a * a / F.lit(2.0))
    near = gauss * _horner(TAIL_NUM, a) / _horner(TAIL_DEN, a)
    cf = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = a + F.lit(k) / cf
    far = gauss / cf / F.lit(SQRT_2PI)
    return F.when(a > TAIL_ZERO, F.lit(0.0)).when(a < TAIL_SPLIT, near).when(a.isNotNull(), far)


def two_sided_p(z) -> Column:
    return F.lit(2.0) * normal_tail(F.abs(_c(z)))


def normal_cdf(x) -> Column:
    t = normal_tail(F.abs(_c(x)))
    return F.when(_c(x) > 0, F.lit(1.0) - t).otherwise(t)


def _quantile_raw(p: Column, lo: Column, r: Column) -> Column:
    """Lower-half quantile from p, lo = sqrt(-2 ln p) and r = (p - 1/2)^2."""
    low = _horner(Q_C, lo) / _horner(Q_D, lo)
    mid = _horner(Q_A, r) * (p - F.lit(0.5)) / _horner(Q_B, r)
    return F.when(p < Q_LOW, low).otherwise(mid)


def add_upper_quantile(df: DataFrame, tail_p: str, out: str) -> DataFrame:
    """Add x >= 0 with P(Z > x) = ``tail_p`` for 0 < tail_p <= 1/2, else NULL.

    Acklam's start is polished by one Halley step; working on the tail keeps
    tiny p-values accurate where 1 - p would round to 1.  Each stage is its own
    projection: nested as one expression the polynomials multiply.
    """
    t, x, u = F.col("_t"), F.col("_x"), F.col("_u")
    p = F.col(tail_p)
    df = df.withColumn("_t", F.when((p > 0) & (p <= 0.5), p))
    df = df.withColumns({"_lo": F.sqrt(F.lit(-2.0) * F.log(t)), "_r": (t - 0.5) * (t - 0.5)})
    df = df.withColumn("_x", F.greatest(-_quantile_raw(t, F.col("_lo"), F.col("_r")), F.lit(0.0)))
    df = df.withColumn("_u", (t - normal_tail(x)) * F.lit(SQRT_2PI) * F.exp(x * x / F.lit(2.0)))
    return df.withColumn(out, F.when(t.isNotNull(), x - u / (F.lit(1.0) + x * u / F.lit(2.0)))) \
             .drop("_t", "_lo", "_r", "_x", "_u")


def add_signed_z(df: DataFrame, p: str, effect: str, out: str) -> DataFrame:
    """Add the z implied by a two-sided p and the sign of the effect; 0 for a missing or non-positive p."""
    df = add_upper_quantile(df.withColumn("_p2", F.col(p) / 2.0), "_p2", "_z")
    signed = F.when(F.col(effect) >= 0, F.col("_z")).otherwise(-F.col("_z"))
    v = F.when(F.col(p) > 1, F.lit(None).cast("double")).otherwise(F.coalesce(signed, F.lit(0.0)))
    return df.withColumn(out, v).drop("_p2", "_z")


def tanh_back(mean) -> Column:
    return F.tanh(_c(mean))


def se_of_r(se_z, r) -> Column:
    return _c(se_z) * (F.lit(1.0) - _c(r) * _c(r))


def clip(x, lo, hi) -> Column:
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi)))


def at_least(x, lo) -> Column:
    return F.when(_c(x).isNotNull(), F.greatest(_c(x), F.lit(lo)))


def neglog10(x, floor: float = 1e-300) -> Column:
    return -F.log10(at_least(x, floor))


def safe_ratio(a, b, bound: float = 1000.0) -> Column:
    """a / b; b = 0 gives +-bound by the sign of a and 0 for a = 0."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    at_zero = F.when(a > 0, F.lit(bound)).when(a < 0, F.lit(-bound)).otherwise(F.lit(0.0))
    q = div(a, b)
    q = F.when(F.abs(q) == F.lit(float("inf")), F.signum(q) * F.lit(bound)).otherwise(q)
    return F.when(b == 0, at_zero).otherwise(q)


# --- Student t ------------------------------------------------------------



def _gammaln(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.lgamma, 1, 1)(x).astype(float)


def _beta_cf(a, b, x, tol=1e-15, iters=400):
    """Continued fraction of the incomplete beta function (modified Lentz), vectorised."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, iters):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < tol):
            break
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t; NaN where t is missing or df <= 0."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    if ok.any():
        tt, v = t[ok], df[ok]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            x = v / (v + tt * tt)
            y = tt * tt / (v + tt * tt)
            y = np.where(np.isinf(tt), 1.0, y)
            x = np.where(np.isinf(tt), 0.0, x)
            a, b = v / 2.0, np.full_like(v, 0.5)
            front = np.exp(_gammaln(a + b) - _gammaln(a) - _gammaln(b)
                           + a * np.log(np.where(x > 0, x, 1.0))
                           + b * np.log(np.where(y > 0, y, 1.0)))
            direct = x < (a + 1.0) / (a + b + 2.0)
            p = np.where(direct,
                         front * _beta_cf(a, b, np.where(direct, x, 0.0)) / a,
                         1.0 - front * _beta_cf(b, a, np.where(direct, 0.0, y)) / b)
        p = np.where(x <= 0, 0.0, np.where(y <= 0, 1.0, p))
        out[ok] = np.clip(p, 0.0, 1.0)
    return out


def _student_batch(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float)))


def student_p(t, df) -> Column:
    """Two-sided Student-t p-value; no built-in CDF exists, so one Arrow-batched UDF."""
    return finite(F.pandas_udf(_student_batch, "double")(_c(t).cast("double"), _c(df).cast("double")))
