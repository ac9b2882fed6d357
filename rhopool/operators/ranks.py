"""Average ranks inside groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rhopool.operators.attach import attach
from rhopool.session import materialize

BUCKETS = 64


def grouped_ranks(df: DataFrame, keys: list[str], value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Add the average rank of ``value`` within ``keys``.

    Values are counted first (ties collapse map-side), cut at stored approximate
    quantiles of their group, ranked inside each cut, and shifted by the counts
    of the lower cuts.  The cuts only shape the tasks; the ranks are exact.
    """
    d = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = materialize(d.groupBy(*keys).agg(F.percentile_approx("_v", probs, 10_000).alias("_cuts")), "cuts")
    d = d.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    low = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = d.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn")) \
              .withColumn("_before", F.coalesce(F.sum("_bn").over(low), F.lit(0))).drop("_bn")
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = d.join(before, [*keys, "_b"]).select(
        *keys, "_v", "_n", (F.col("_before") + F.sum("_n").over(inside) - (F.col("_n") - 1) / 2.0).alias(out))
    return attach(df, ranked, {**{k: k for k in keys}, value: "_v"}, out, "_n").where(F.col(out).isNotNull())
