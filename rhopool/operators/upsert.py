"""Upsert, latest-row dedupe, retention, surrogate keys and key checks on parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from rhopool.session import materialize


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the largest ``order`` tuple (NULLs lowest).

    max_by merges map-side, so a key repeated very often never lands in one
    sort the way a row_number window would put it.
    """
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_r"))
    return best.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest]).select(*df.columns)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str],
           order: list[str] | None = None) -> DataFrame:
    """Target with ``source`` merged on ``keys``: matched rows take the source's ``update`` columns,
    unmatched source rows are inserted, everything else is kept.

    Repeated source keys are reduced to the latest row first.  A full outer
    join carries presence flags, so a NULL in the source does overwrite.
    """
    if order:
        source = latest_rows(source, keys, order)
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns], F.lit(True).alias("_in_s"))
    t = target.withColumn("_in_t", F.lit(True))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_s_{k}")
        cond = c if cond is None else cond & c
    j = t.join(s, cond, "full_outer")
    out = []
    for c in target.columns:
        src = F.col(f"_s_{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        if c in keys:
            v = F.coalesce(F.col(c), src)
        elif c in update:
            v = F.when(F.col("_in_s"), src).otherwise(F.col(c))
        else:
            v = F.when(F.col("_in_t"), F.col(c)).otherwise(src)
        out.append(v.alias(c))
    return j.select(*out)


def retain(df: DataFrame, at: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows not older than ``days``."""
    now = now if now is not None else F.current_timestamp()
    return df.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def unmatched_keys(facts: DataFrame, dim: DataFrame, *key: str) -> DataFrame:
    """Distinct fact keys absent from the dimension."""
    return facts.select(*key).distinct().join(dim.select(*key), list(key), "left_anti")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right) for each distinct key of either side, by one aggregation: union, intersection and difference.

    NULL is a key like others.
    """
    both = left.select(F.col(key), F.lit(True).alias("_l")).unionByName(right.select(F.col(key), F.lit(False).alias("_l")))
    return both.groupBy(key).agg(F.bool_or("_l").alias("in_left"), F.bool_or(~F.col("_l")).alias("in_right"))


def resolve_stage(stage: DataFrame, dims: list[tuple[DataFrame, str, str]], at: str) -> DataFrame:
    """Staged rows with the surrogate of each (dimension, natural key, surrogate), one row for each set of surrogates.

    Rows that a dimension doesn't know are dropped (count them with ``unmatched_keys``); ``at`` is the latest of a row's.
    """
    for dim, natural, surrogate in dims:
        stage = resolve_keys(stage, dim, natural, surrogate)
    return stage.groupBy(*[s for _, _, s in dims]).agg(F.max(at).alias(at))


def resolve_keys(facts: DataFrame, dim: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """Swap a natural key for its surrogate; unmatched rows drop (count them with ``unmatched_keys``).

    The join strategy is left to the planner: a gene dimension is small, a
    sample dimension need not be.
    """
    return facts.join(dim.select(natural, surrogate), natural).drop(natural)


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Dense 1..n in global ``order`` without a single-task sort.

    Rows are range-partitioned on ``order`` and stored once, so the partition
    number is a fixed fact; counts of the earlier partitions give each one its
    offset (one row per partition, whatever the data size).
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part").orderBy(*order)
    return (ranged.join(offsets, "_part")
            .withColumn(name, F.col("_before") + F.row_number().over(inside) + F.lit(start - 1))
            .drop("_part", "_before"))


def extend_dimension(existing: DataFrame, incoming: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """New natural keys get surrogate keys after the largest existing one; known keys keep theirs."""
    new = incoming.join(existing.select(natural), natural, "left_anti").dropDuplicates([natural])
    top = existing.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("m")).scalar()
    numbered = number_rows(new, [natural], "_seq").withColumn(surrogate, F.col("_seq") + top).drop("_seq")
    return existing.unionByName(numbered.select(*existing.columns), allowMissingColumns=True)
