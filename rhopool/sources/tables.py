"""Table access: described tables, row counts, filtered and batched fetches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame) -> DataFrame:
    """column, type, nullable, and the row count on every line."""
    cols = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                              F.lit(f.nullable).alias("nullable")) for f in df.schema])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(cols), "rows")


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    return reduce(DataFrame.unionByName, [
        d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, d in tables.items()])


def table_rows_by(tables: dict[str, DataFrame], by: str) -> DataFrame:
    """(table, ``by``, rows): row counts for each value of a column; a table without it has one line with NULL."""
    def rows(name, d):
        d = d.withColumn("_by", F.col(by).cast("string") if by in d.columns else F.lit(None).cast("string"))
        return d.groupBy("_by").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.col("_by").alias(by), "rows")
    return reduce(DataFrame.unionByName, [rows(n, d) for n, d in tables.items()])


def stored_sizes(spark, paths: dict[str, str]) -> DataFrame:
    """(table, files, bytes) of stored tables from their listings alone; names that begin with _ or . don't count."""
    def sizes(name, path):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
        return f.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(F.lit(name).alias("table"), "files", "bytes")
    return reduce(DataFrame.unionByName, [sizes(n, p) for n, p in paths.items()])


def fetch(df: DataFrame, limit: int | None = None, order: list[str] | None = None, **equals) -> DataFrame:
    """Optional equality filters, then an optional limit made deterministic by ``order``."""
    for c, v in equals.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if limit and limit > 0:
        df = df.orderBy(*(order or df.columns)).limit(limit)
    return df


def fetch_pairs(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts of the (x, y) pairs in ``wanted``, in either orientation, by one semi join."""
    keys = wanted.select(F.least("x", "y").alias("_a"), F.greatest("x", "y").alias("_b"))
    cond = ((F.least("gene_a_key", "gene_b_key") == F.col("_a")) & (F.greatest("gene_a_key", "gene_b_key") == F.col("_b")))
    return facts.join(keys, cond, "left_semi")


def jdbc(spark, url: str, table: str, partition_column: str | None = None, lower=None, upper=None, partitions: int = 1,
         **options) -> DataFrame:
    """A database table or view, read in parallel ranges when a partition column is named."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", partitions))
    return r.load()
