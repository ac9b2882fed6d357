"""Quality of a ranking and agreement of two: precision at k, reciprocal rank, rank correlation, Kendall's tau."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.operators.ranks import grouped_ranks
from rhopool.session import materialize

RANGE_ROWS = 1_000_000   # distinct value pairs that one task orders, about
MAX_RANGES = 2048        # beyond it ranges grow; the driver holds a table of ranges by ranges


def precision_at(df: DataFrame, score: str, relevant: Column, ks: list[int], tie: str) -> DataFrame:
    """(k, precision): the relevant share of the first k rows by falling ``score``, ties by ``tie``; nulls are last.

    Fewer than k rows count as all there are; no rows give null. Only the largest k rows leave the tasks.
    """
    top = df.select(F.col(score).alias("s"), F.col(tie).alias("t"), F.coalesce(relevant, F.lit(False)).alias("hit"))
    top = top.orderBy(F.desc_nulls_last("s"), "t").limit(max(ks))
    marks = [r["hit"] for r in top.collect()]
    rows = [(k, sum(marks[:k]) / len(marks[:k]) if marks else None) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, precision double")


def reciprocal_rank(df: DataFrame, score: str, control: Column, tie: str) -> DataFrame:
    """One row reciprocal_rank: 1 / position of the best row for which ``control`` holds; 0 if there is none.

    Two aggregations; nothing is sorted.
    """
    rows = df.select(F.col(score).alias("s"), F.col(tie).alias("t"), F.coalesce(control, F.lit(False)).alias("c")).where("s is not null")
    best = rows.where("c").agg(F.max("s").alias("s")).first()["s"]
    if best is None:
        return df.sparkSession.createDataFrame([(0.0,)], "reciprocal_rank double")
    first = rows.where(F.col("c") & (F.col("s") == F.lit(best))).agg(F.min("t").alias("t")).first()["t"]
    before = (F.col("s") > F.lit(best)) | ((F.col("s") == F.lit(best)) & (F.col("t") < F.lit(first)))
    return rows.agg((1.0 / (F.count_if(before) + 1)).alias("reciprocal_rank"))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row rank_correlation: Spearman's rho of two columns over the rows that have both, average ranks for ties."""
    both = materialize(df.select(F.lit(1).alias("g"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null"), "both")
    ranked = grouped_ranks(grouped_ranks(both, ["g"], "a", "ra"), ["g"], "b", "rb")
    return ranked.agg(S.div(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("rank_correlation"))


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """The summed weight products of pairs whose earlier value is greater, exact.

    From the highest bit of the dense ranks down: among ranks equal so far, a one before a zero is an inversion.
    """
    _, rank = np.unique(values, return_inverse=True)
    if len(rank) < 2:
        return 0
    total = int(sum(int(w) for w in weights)) if weights.dtype == object else int(weights.sum())
    weights = weights.astype(object if total * total >= 1 << 63 else np.int64)
    rank = rank.astype(np.int64)
    found = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        group = rank >> (bit + 1)
        order = np.argsort(group, kind="stable")
        one, w, g = (rank[order] >> bit) & 1, weights[order], group[order]
        before = np.cumsum(w * one)
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        base = np.concatenate([[0], before])[start]
        inside = before - np.repeat(base, np.diff(np.append(start, len(g))))
        found += int((w * (1 - one) * inside).sum())
    return found


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def _tied(rows: DataFrame, *keys: str) -> int:
    """Pairs of rows with equal ``keys``."""
    sizes = rows.groupBy(*keys).agg(F.sum("w").alias("w")) if keys else rows.agg(F.sum("w").alias("w"))
    got = sizes.agg(F.sum((_exact("w") * (F.col("w") - 1)).cast("decimal(38,0)")).alias("t")).first()["t"]
    return int(got or 0) // 2


def _inside(part: str, value: str, order: list[str]):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(order, kind="stable")
        return pd.DataFrame({"found": [str(inversions(d[value].to_numpy(), d["w"].to_numpy()))]})
    return lambda df: df.groupBy(part).applyInPandas(count, "found string").agg(F.sum(F.col("found").cast("decimal(38,0)")).alias("n")).first()["n"] or 0


def kendall_tau(df: DataFrame, a: str, b: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row: n, concordant, discordant, ties_a, ties_b, ties_both (pairs of rows; decimal(38,0)), tau_b.

    Rows with a null or nan in either column are left out; copies are counted, not compared. Discordant pairs are the
    inversions of b in the order of (a, b). That order is cut into ranges: inversions within a range are counted by its
    task; those between ranges by b: rows are dealt to buckets of b, bucket pairs are told by counts alone, and inside
    a bucket the rows of other ranges are compared in one task. A value of b that fills buckets of its own has no
    inversions and is not gathered. tau_b is null where a column has a single value.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    rows = df.select((x + 0.0).alias("a"), (y + 0.0).alias("b")).where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    rows = materialize(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), "weighted")
    size, n = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    ranges = min(MAX_RANGES, max(1, math.ceil(size / range_rows)))
    parted = materialize(rows.repartitionByRange(ranges, "a", "b").withColumn("part", F.spark_partition_id()), "ranges") if size else rows.withColumn("part", F.lit(0))
    found = int(_inside("part", "b", ["a", "b"])(parted))
    if ranges > 1:
        cuts = parted.agg(F.percentile_approx("b", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("c")).first()["c"]
        edges = np.unique(cuts)
        # Values that are cuts more than once have a bucket to themselves: odd numbers are single values.
        single = np.array([cuts.count(e) > 1 for e in edges])

        def deal(batches):
            for pdf in batches:
                at = np.searchsorted(edges, pdf["b"].to_numpy(), "left")
                here = (at < len(edges)) & (edges[np.minimum(at, len(edges) - 1)] == pdf["b"].to_numpy()) & single[np.minimum(at, len(edges) - 1)]
                yield pdf.assign(bucket=2 * at + here)

        dealt = materialize(parted.mapInPandas(deal, "a double, b double, w bigint, part int, bucket bigint"), "dealt")
        cells = dealt.groupBy("part", "bucket").agg(F.sum("w").alias("w")).toPandas()
        table = np.zeros((ranges, 2 * len(edges) + 2), object)
        np.add.at(table, (cells["part"].to_numpy(), cells["bucket"].to_numpy()), cells["w"].to_numpy().astype(object))
        # Rows of earlier ranges in greater buckets.
        greater = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
        earlier = np.cumsum(greater, axis=0) - greater
        found += int((table * earlier).sum())
        # Within a bucket, in order of range; rows of one range come by b, so they don't count among themselves again.
        found += int(_inside("bucket", "b", ["part", "b"])(dealt.where("bucket % 2 = 0")))
    pairs = int(n) * (int(n) - 1) // 2
    ties_a, ties_b, both = _tied(rows, "a"), _tied(rows, "b"), _tied(rows, "a", "b")
    agree = pairs - ties_a - ties_b + both - found
    below = math.sqrt(pairs - ties_a) * math.sqrt(pairs - ties_b)
    out = (int(n), *(Decimal(v) for v in (agree, found, ties_a, ties_b, both)), (agree - found) / below if below > 0 else None)
    return df.sparkSession.createDataFrame([out], "n bigint, concordant decimal(38,0), discordant decimal(38,0), ties_a decimal(38,0), ties_b decimal(38,0), ties_both decimal(38,0), tau_b double")
