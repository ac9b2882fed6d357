"""Record, warning and error counts of pipeline steps, taken while the rows are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STEPS = ("extract", "transform", "load")


class StageSummary:
    """Counts per step and table. They ride on the write itself as observed metrics, so no table is read for them."""

    def __init__(self):
        self.counts: list[tuple] = []

    def write(self, df: DataFrame, path: str, step: str, table: str, warning: Column | None = None, error: Column | None = None,
              partition_by: str | None = None) -> None:
        """Writes ``df`` to ``path`` as parquet and counts its rows, and those for which ``warning`` or ``error`` holds (null: doesn't).

        A write that fails leaves no counts.
        """
        seen = Observation()
        held = lambda c: F.lit(0).cast("bigint") if c is None else F.count_if(F.coalesce(c, F.lit(False)))
        watched = df.observe(seen, F.count(F.lit(1)).alias("records"), held(warning).alias("warnings"), held(error).alias("errors"))
        writer = watched.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        got = seen.get
        self.counts.append((step, table, got.get("records", 0), got.get("warnings", 0), got.get("errors", 0)))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(step, table, records, warnings, errors); what was written more than once in a step is added up."""
        found = spark.createDataFrame(self.counts, "step string, table string, records bigint, warnings bigint, errors bigint")
        return found.groupBy("step", "table").agg(F.sum("records").alias("records"), F.sum("warnings").alias("warnings"), F.sum("errors").alias("errors"))

    def totals(self, spark: SparkSession) -> DataFrame:
        """(step, tables, records, warnings, errors)."""
        return self.rows(spark).groupBy("step").agg(F.count("*").alias("tables"), F.sum("records").alias("records"), F.sum("warnings").alias("warnings"), F.sum("errors").alias("errors"))
