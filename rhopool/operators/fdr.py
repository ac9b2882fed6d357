"""False-discovery-rate control without a single-task global sort.

The global ordering is split into value buckets that depend only on p itself
(``floor(4096 * -log2 p)``, monotone in p), so every task re-derives the same
bucket after a retry.  Ties are collapsed before anything is ordered, which
removes hot values (p = 1 or p = 0 may be a third of all rows).  Only one row
per bucket reaches the carry window; its size is bounded by the bucket grid,
not by the data.  Values that serve many rows are written back without a
shuffle of those rows by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rhopool.operators.attach import attach

BUCKETS_PER_OCTAVE = 4096
ZERO_BUCKET = -(10**9)


def _bucket(p):
    # Ascending in p; p > 1 cannot occur for a probability but keeps its order.
    return F.when(p <= 0, F.lit(ZERO_BUCKET)).otherwise(
        F.floor(F.log2(p) * F.lit(float(BUCKETS_PER_OCTAVE)))
    ).cast("long")


def adjust(df: DataFrame, p: str, q: str, keys: list[str] | None = None,
           mode: str = "standard") -> DataFrame:
    """Add the Benjamini-Hochberg column ``q`` for ``p`` within ``keys`` (all rows when empty).

    ``standard``: running minimum of p*m/rank from the largest p down.
    ``reference``: running minimum from the smallest p up (q can be below p).
    Tied p-values share the value at their last rank; q is capped at 1 and is
    NULL where p is NULL.
    """
    if mode not in ("standard", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = list(keys or [])
    d = (df.where(F.col(p).isNotNull())
           .groupBy(*keys, F.col(p).alias("_p"))
           .agg(F.count(F.lit(1)).alias("_n"))
           .withColumn("_b", _bucket(F.col("_p"))))

    # Totals per bucket -> rank offset before the bucket and m.
    over_keys = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    up = over_keys.orderBy("_b")
    totals = (d.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
                .withColumn("_before", F.sum("_bn").over(up.rowsBetween(W.unboundedPreceding, 0)) - F.col("_bn"))
                .withColumn("_m", F.sum("_bn").over(over_keys))
                .drop("_bn"))

    in_bucket = W.partitionBy(*keys, "_b").orderBy("_p")
    ranked = (d.join(totals, [*keys, "_b"])
               .withColumn("_rank", F.col("_before") + F.sum("_n").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)))
               .withColumn("_v", F.col("_p") * F.col("_m") / F.col("_rank")))

    # Both directions run as a preceding frame: a following frame is re-read per row.
    if mode == "standard":
        walk, carry_walk = W.partitionBy(*keys, "_b").orderBy(F.desc("_p")), over_keys.orderBy(F.desc("_b"))
    else:
        walk, carry_walk = in_bucket, up
    frame = walk.rowsBetween(W.unboundedPreceding, 0)
    carry_frame = carry_walk.rowsBetween(W.unboundedPreceding, -1)
    carried = (ranked.groupBy(*keys, "_b").agg(F.min("_v").alias("_bv"))
                     .withColumn("_carry", F.min("_bv").over(carry_frame))
                     .drop("_bv"))
    qs = (ranked.withColumn("_w", F.min("_v").over(frame))
                .join(carried, [*keys, "_b"])
                .select(*keys, "_p", "_n", F.least(F.col("_w"), F.col("_carry"), F.lit(1.0)).alias(q)))
    return attach(df, qs, {**{k: k for k in keys}, p: "_p"}, q, "_n")
