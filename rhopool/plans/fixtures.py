"""Views that map the test tables onto the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhopool.operators.meta import pair_metrics
from rhopool.operators.spearman import correlation_facts
from rhopool.session import materialize_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expression_long(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """gene = brand, study = supplier region, condition = return flag, sample = ship month."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_returnflag", "l_quantity",
        F.date_format("l_shipdate", "yyyy-MM").alias("sample"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    key = F.expr("cast(substring(p_brand, 7) as bigint)")
    gene = F.col("p_brand")
    if by_type:
        gene = F.concat_ws("-", "p_brand", "p_type")
        key = key * 1000 + F.pmod(F.crc32(F.col("p_type")), F.lit(997))
    return (li.join(part, li.l_partkey == part.p_partkey)
              .join(supp, li.l_suppkey == supp.s_suppkey)
              .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
              .groupBy(key.alias("gene_key"), gene.alias("gene"), F.col("n_regionkey").cast("long").alias("study_key"),
                       F.expr("case l_returnflag when 'R' then 'septic shock' when 'N' then 'sepsis' else 'control' end")
                        .alias("condition"), "sample")
              .agg(F.avg("l_quantity").alias("value")))


def corr_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize_once(spark, (sf_dir,), "corr_facts",
                            lambda: correlation_facts(expression_long(spark, sf_dir)))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize_once(spark, (sf_dir,), "pair_metrics",
                            lambda: pair_metrics(corr_facts(spark, sf_dir)))
