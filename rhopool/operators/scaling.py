"""Whole-column statistics brought back to every row, imputation and scaling.

Whole-table aggregates return as scalar subqueries: one row, evaluated once,
no join.  Exact quantiles never build a per-value buffer over the whole table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.functions import stats as S

DIGITS = (22, 21, 21)   # bits of a double that each pass of a quantile fixes
HELD = 1 << 20          # counts gathered before they leave a task


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns in schema order, minus exclusions."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def scalars(df: DataFrame, **aggs: Column) -> dict[str, Column]:
    """Named whole-table aggregates as columns usable in any projection (shared subquery)."""
    row = df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("s")).scalar()
    return {n: row.getField(n) for n in aggs}


def num(x: float) -> str:
    """A double literal in SQL text. Wide projections are built as text: one call instead of hundreds."""
    return f"{float(x)!r}D"


def column_stats(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """n, avg, var_pop, var_samp, min, max per column in one small aggregation.

    Columns are unpivoted and grouped by name: partial aggregation leaves one
    row per column and task, and the generated code does not grow with the
    number of columns.  One row per column reaches the driver.
    """
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "c", "x")
    got = long.groupBy("c").agg(
        F.count("x").alias("n"), F.count(F.lit(1)).alias("rows"), F.avg("x").alias("avg"), F.var_pop("x").alias("var_pop"),
        F.var_samp("x").alias("var_samp"), F.min("x").alias("min"), F.max("x").alias("max")).collect()
    empty = {"n": 0, "rows": 0, "avg": None, "var_pop": None, "var_samp": None, "min": None, "max": None}
    return {**{c: dict(empty) for c in cols}, **{r["c"]: r.asDict() for r in got}}


def _keys(column: pa.Array) -> np.ndarray:
    """The non-null values as unsigned integers of the same order (-0.0 as 0.0, nan last)."""
    x = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _histograms(cols: list[str], wanted: dict[str, list[int]] | None, width: int, shift: int):
    """Counts of the next ``width`` bits below the wanted prefixes of each column: rows (c, prefix, digit, n)."""

    def run(batches):
        held: dict[str, list] = {c: [] for c in cols}
        size = 0

        def flush():
            for c, parts in held.items():
                if parts:
                    keys, n = (np.concatenate(x) for x in zip(*parts))
                    found, which = np.unique(keys, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([c] * len(found), pa.string()), pa.array((found >> np.uint64(width)).astype(np.int64)),
                        pa.array((found & np.uint64((1 << width) - 1)).astype(np.int64)), pa.array(np.bincount(which, n, len(found)).astype(np.int64))], ["c", "prefix", "digit", "n"])
                    parts.clear()

        for batch in batches:
            for c in cols:
                keys = _keys(batch.column(c)) >> np.uint64(shift)
                if wanted is not None:
                    keys = keys[np.isin(keys >> np.uint64(width), np.array(wanted.get(c, []), np.uint64))]
                if len(keys):
                    held[c].append(np.unique(keys, return_counts=True))
                    size += len(held[c][-1][0])
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()

    return run


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], stats: dict[str, dict] | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles, exact at any row count and alike at every size; nan counts as the largest value.

    Doubles are read as integers of the same order. A pass counts, for all columns and probabilities together, the next
    bits of the values that share the higher bits found so far with a wanted order statistic; three passes fix all 64.
    Tasks emit counts; the driver gets one row for each wanted order statistic. The number of jobs depends on neither
    columns nor probabilities.
    """
    if not cols:
        return {}
    counts = {c: s["n"] for c, s in (stats or column_stats(df, cols)).items()}
    full = [c for c in cols if counts[c]]
    # Both neighbours of each position: (column, prefix so far, rank among the values with that prefix) -> what asks for it.
    asked = {(c, int(p * (counts[c] - 1)) + k) for c in full for p in probs for k in (0, 1)}
    state = {(c, min(k, counts[c] - 1)): (0, min(k, counts[c] - 1)) for c, k in asked}
    wide, left = df.select(*[F.col(c).cast("double").alias(c) for c in full]), 64
    for width in DIGITS:
        if not full:
            break
        left -= width
        wanted: dict[str, list[int]] = {}
        for (c, _), (prefix, _) in state.items():
            wanted.setdefault(c, []).append(prefix)
        wanted = {c: sorted(set(p)) for c, p in wanted.items()}
        ranks = sorted({(c, prefix, rank) for (c, _), (prefix, rank) in state.items()})
        found = wide.mapInArrow(_histograms(full, None if left + width == 64 else wanted, width, left), "c string, prefix bigint, digit bigint, n bigint")
        found = found.groupBy("c", "prefix", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("c", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        table = df.sparkSession.createDataFrame(ranks, "c string, prefix bigint, rank bigint")
        hit = (found.withColumn("upto", upto).join(table, ["c", "prefix"]).where("rank < upto and rank >= upto - n")
               .select("c", "prefix", "rank", "digit", (F.col("upto") - F.col("n")).alias("before")).collect())
        at = {(r["c"], r["prefix"], r["rank"]): (r["prefix"] << width | r["digit"], r["rank"] - r["before"]) for r in hit}
        state = {(c, k): at[(c, prefix, rank)] for (c, k), (prefix, rank) in state.items()}
    value = {ck: _value(prefix) for ck, (prefix, _) in state.items()}
    out: dict[str, list] = {c: [None] * len(probs) for c in cols}
    for c in full:
        for i, p in enumerate(probs):
            pos = p * (counts[c] - 1)
            a, b = value[c, int(pos)], value[c, min(int(pos) + 1, counts[c] - 1)]
            out[c][i] = a if pos == int(pos) or a == b else a + (pos - int(pos)) * (b - a)
    return out


def fill_median(df: DataFrame, cols: list[str], stats: dict[str, dict] | None = None) -> DataFrame:
    """Replace NULLs by the exact column median; all-null columns stay null.

    Medians are computed only for the columns one counting pass finds incomplete.
    """
    st = stats or column_stats(df, cols)
    med = exact_quantiles(df, [c for c in cols if 0 < st[c]["n"] < st[c]["rows"]], [0.5], stats=st)
    fills = {c: m[0] for c, m in med.items() if m[0] is not None}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fills.items()})


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0, subset=cols)


def null_nonfinite(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: S.finite(c) for c in cols})


def minmax(df: DataFrame, cols: dict[str, str], eps: float | None = 1e-12) -> DataFrame:
    """(x - min) / (max - min + eps); with ``eps=None`` a constant column gives 0."""
    out = {}
    for c, s in column_stats(df, list(cols)).items():
        x, lo, hi = F.col(c).cast("double"), s["min"], s["max"]
        if lo is None:
            v = F.lit(None).cast("double")
        elif eps is None:
            v = (x - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
        else:
            v = (x - F.lit(lo)) / F.lit(hi - lo + eps)
        out[cols[c]] = v
    return df.withColumns(out)


def standard_scale(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Zero mean, unit population sd; a constant column is only centred."""
    st = column_stats(df, cols)
    out = {}
    for c in cols:
        s = st[c]
        if s["n"]:
            sd = math.sqrt(s["var_pop"])
            by = sd if sd > 0 and s["max"] > s["min"] else 1.0
            out[f"{c}{suffix}"] = F.expr(f"(cast(`{c}` as double) - {num(s['avg'])}) / {num(by)}")
    return df.withColumns(out)


def robust_scale(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - median) / IQR with exact quantiles; a zero IQR divides by 1."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    out = {}
    for c in cols:
        a, m, b = q[c]
        if m is not None:
            out[f"{c}{suffix}"] = (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(b - a) or 1.0)
    return df.withColumns(out)


def select_features(df: DataFrame, cols: list[str], min_variance: float | None = None,
                    max_missing: float = 0.5, stats: dict[str, dict] | None = None) -> list[str]:
    """Columns with at least half their values present and non-zero variance after median filling.

    ``min_variance`` additionally drops columns whose variance is below it.
    """
    st = stats or column_stats(df, cols)
    kept = [c for c in cols if st[c]["rows"] and (st[c]["rows"] - st[c]["n"]) / st[c]["rows"] < max_missing
            # A constant column is told by min = max: rounding cannot blur it and median filling keeps it constant.
            and st[c]["max"] > st[c]["min"]]
    if min_variance is None:
        return kept
    med = exact_quantiles(df, [c for c in kept if st[c]["n"] < st[c]["rows"]], [0.5], stats=st)

    def filled_variance(c: str) -> float:
        # Variance after adding the missing rows as copies of the median.
        s, k, n = st[c], st[c]["n"], st[c]["rows"]
        gap = s["avg"] - med[c][0] if c in med else 0.0
        return (s["var_pop"] * k + k * (n - k) / n * gap * gap) / max(n - 1, 1)

    return [c for c in kept if filled_variance(c) >= min_variance]


def top_correlated(df: DataFrame, cols: list[str], target: str, n: int = 20) -> list[tuple[str, float]]:
    """The n columns with the largest |Pearson correlation| with ``target``; ties by name."""
    row = df.agg(*[safe_corr(c, target).alias(c) for c in cols]).first()
    got = [(c, abs(row[c])) for c in cols if row[c] is not None]
    return sorted(got, key=lambda x: (-x[1], x[0]))[:n]


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are present; NULL for degenerate input."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(ok, F.col(a)).cast("double"), F.when(ok, F.col(b)).cast("double")
    return S.div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
