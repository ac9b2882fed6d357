"""Writing values back to the rows they were computed for, whatever share of the rows one value serves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.session import materialize

SHARE = 1024


def attach(df: DataFrame, values: DataFrame, on: dict[str, str], out: str, weight: str, share: int = SHARE) -> DataFrame:
    """``df`` with column ``out`` of the ``values`` row whose keys agree; NULL where there is none or a key is NULL.

    ``on`` maps columns of ``df`` to those of ``values``, which holds each key once; ``weight`` is the number of rows
    of ``df`` with that key. Keys that serve at least 1 of ``share`` rows are ``share`` at most, so they are broadcast;
    their rows, and those with a NULL key, are spread by partition instead of meeting in the join's task for that key.
    """
    keys = {v: f"_k{i}" for i, v in enumerate(on.values())}
    named = values.select(*[F.col(v).alias(k) for v, k in keys.items()], F.col(out).alias("_out"), F.col(weight).alias("_weight"), F.lit(0).alias("_place"))
    named = materialize(named, "attach")
    top = named.where(F.col("_weight") * share >= named.agg(F.sum("_weight")).scalar())
    top = top.select(*[F.col(k).alias(f"_top{k}") for k in keys.values()], F.col("_out").alias("_top_out"), F.lit(True).alias("_top"))
    own = [c for c in df.columns if c != out]
    # Copies of the key columns, as ``out`` may be one of them.
    d = df.withColumns({f"_own{keys[v]}": F.col(c) for c, v in on.items()}).select(*own, *[f"_own{k}" for k in keys.values()])
    d = d.join(F.broadcast(top), [F.col(f"_own{k}") == F.col(f"_top{k}") for k in keys.values()], "left")
    alone = F.col("_top").isNotNull()
    for k in keys.values():
        alone = alone | F.col(f"_own{k}").isNull()
    d = d.withColumn("_spread", F.when(alone, -1 - F.spark_partition_id()).otherwise(0))
    met = [F.col(f"_own{k}") == F.col(k) for k in keys.values()] + [F.col("_spread") == F.col("_place")]
    return d.join(named, met, "left").select(*own, F.coalesce("_out", "_top_out").alias(out))
