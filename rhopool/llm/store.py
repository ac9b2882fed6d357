"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from rhopool.session import checkpoint_root


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed parquet in the folder of ``spark.checkpoint.dir`` and read it back.

    The table outlives lost executors, cuts lineage and gives the planner a size.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
