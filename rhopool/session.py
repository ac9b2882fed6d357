"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_memo: dict[tuple, DataFrame] = {}


def build_session(app: str = "rhopool", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; anything already configured wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-rhopool-")
    return _local_dirs[app]


def materialize(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a parquet table to the shared checkpoint folder.

    A written table survives executor loss, keeps column pruning and gives the
    planner a size, none of which hold for cached blocks.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_once(spark: SparkSession, key: tuple, name: str, make) -> DataFrame:
    """Materialise ``make()`` the first time ``key`` is asked for in this application."""
    full = (spark.sparkContext.applicationId, name, *key)
    if full not in _memo:
        _memo[full] = materialize(make(), name)
    return _memo[full]


def forget_materialized() -> None:
    _memo.clear()
