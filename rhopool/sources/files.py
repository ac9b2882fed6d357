"""File sources and sinks: pair tables, annotations, matrices, result bundles, reports."""

from __future__ import annotations

import hashlib
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.functions.text import STUDY_PATTERN
from rhopool.operators.clean import MANDATORY, missing_columns, null_tokens, stack_ragged

# Reader format by file suffix.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".json": "json", ".parquet": "parquet"}
MD5_LIMIT = 512 * 1024 * 1024  # larger files are hashed in chunks
MD5_CHUNK = 4 * 1024 * 1024
MATRIX_WIDTH = 1024  # columns of a matrix that meet their header at once


def format_of(path: str, file_type: str = "auto") -> str:
    if file_type != "auto":
        return file_type
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".xls", ".xlsx"):
        raise ValueError("spreadsheets have no Spark source; export the sheet to CSV")
    if suffix not in FORMATS:
        raise ValueError(f"unknown file type {suffix!r}")
    return FORMATS[suffix]


def read_table(spark: SparkSession, path: str, file_type: str = "auto", schema: T.StructType | str | None = None,
               multiline: bool = True) -> DataFrame:
    """A table from CSV, TSV, JSON (records or lines) or parquet; pass ``schema`` to skip inference."""
    fmt = format_of(path, file_type)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "parquet":
        return r.parquet(path)
    if fmt == "json":
        return r.option("multiLine", multiline).json(path)
    return r.csv(path, sep="\t" if fmt == "tsv" else ",", header=True, inferSchema=schema is None)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as top-level columns named a.b."""
    def leaves(fields, path):
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, here)
            else:
                yield here
    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema.fields, [])])


def read_pairs(spark: SparkSession, path: str, file_type: str = "auto", multiline: bool = True) -> DataFrame:
    """A flattened pair table; an error names absent mandatory columns. JSON is records, or lines with ``multiline`` false."""
    df = flatten(read_table(spark, path, file_type, multiline=multiline))
    absent = missing_columns(df, MANDATORY)
    if absent:
        raise ValueError(f"missing mandatory columns: {', '.join(absent)}")
    return df


def read_annotations(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Tab-separated sample annotations as text: no quoting, malformed lines dropped, names trimmed,
    a common column prefix removed, null spellings as NULL, study from the path."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", mode="DROPMALFORMED", inferSchema=False)
    df = df.withColumn("study", study_of_path(F.input_file_name()))
    names = {c: c.strip().removeprefix(prefix) for c in df.columns}
    return null_tokens(df.withColumnsRenamed({a: b for a, b in names.items() if a != b}))


def read_matrix(spark: SparkSession, path: str, width: int = MATRIX_WIDTH) -> DataFrame:
    """Wide gene x sample matrices as (study, gene, sample, value text), each file under its own header.

    ``path`` may name many files. The header is a file's first line; cells beyond it are dropped, absent and empty
    cells are NULL. Header and lines are cut into ranges of ``width`` columns and meet by split of a file and range, so
    neither a wide header nor a long file is one key or one broadcast.
    """
    cells = F.transform(F.split("value", "\t", -1), lambda c: F.nullif(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit("")))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("line"), cells.alias("cells"))

    def ranges(column, n):
        last = F.greatest(F.ceil(n / F.lit(float(width))).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(column, i * width + 2, F.least(F.lit(width), F.greatest(n - i * width, F.lit(0)))))

    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("cells", "line").alias("names"), F.min("line").alias("first"))
    heads = lines.select("file", "block").distinct().join(heads.withColumn("n", F.size("names") - 1), "file")
    names = heads.select("file", "block", F.posexplode(ranges("names", F.col("n"))).alias("range", "names"))
    body = lines.join(heads.select("file", "block", "first", "n"), ["file", "block"]).where("block > 0 or line <> first")
    body = body.select("file", "block", F.element_at("cells", 1).alias("gene"), F.posexplode(ranges("cells", F.col("n"))).alias("range", "cells"))
    pairs = F.arrays_zip(F.col("names").alias("sample"), F.col("cells").alias("value"))
    return (body.join(names, ["file", "block", "range"]).select(study_of_path(F.col("file")).alias("study"), "gene", F.explode(pairs).alias("p"))
            .select("study", "gene", "p.sample", "p.value").where("sample is not null and gene is not null"))


def study_of_path(path):
    """The last path element that looks like a study code."""
    return F.element_at(F.filter(F.transform(F.split(path, "/"), lambda p: F.regexp_extract(p, f"^({STUDY_PATTERN})", 1)),
                                 lambda p: p != ""), -1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def discover_studies(spark: SparkSession, path: str, documents: DataFrame | None = None) -> DataFrame:
    """Distinct study codes from folder names and, when given, from experiment keys of metadata documents."""
    found = _files(spark, path).select(study_of_path(F.col("path")).alias("study"))
    if documents is not None:
        found = found.union(documents.select(F.explode(F.map_keys("experiments"))).where(
            F.col("col").rlike(f"^(?:{STUDY_PATTERN})")))
    return found.where("study is not null and study <> ''").distinct()


def fingerprints(spark: SparkSession, path: str, limit: int = MD5_LIMIT) -> DataFrame:
    """(path, length, modified, md5) of every file; files above ``limit`` are read in chunks in tasks, not loaded whole.

    Those are opened by pyarrow: stores that it doesn't know raise an error.
    """
    f = _files(spark, path)
    small = f.where(F.col("length") <= limit).select("path", "length", F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))
    large = f.where(F.col("length") > limit).select("path", "length", F.col("modificationTime").alias("modified"))
    return small.unionByName(large.mapInArrow(_hashed, T.StructType([*large.schema.fields, T.StructField("md5", T.StringType())])))


def _hashed(batches):
    """Adds md5, the hash of the file at ``path``."""
    import pyarrow as pa
    from pyarrow import fs

    def md5(path):
        store, at = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        h = hashlib.md5()
        with store.open_input_stream(at, compression=None) as f:
            while part := f.read(MD5_CHUNK):
                h.update(part)
        return h.hexdigest()

    for rows in batches:
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([md5(p) for p in rows.column("path").to_pylist()], pa.string())], [*rows.schema.names, "md5"])


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    b = before.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"), F.col("md5").alias("_h"))
    same = F.when(F.col("md5").isNotNull() & F.col("_h").isNotNull(), F.col("md5") == F.col("_h")).otherwise(
        (F.col("length") == F.col("_l")) & (F.col("modified") == F.col("_m")))
    return now.join(b, "path", "left").where(~F.coalesce(same, F.lit(False))).select(*now.columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt in ("json", "parquet", "orc"):
        getattr(w, fmt)(path)
    else:
        raise ValueError(f"unknown sink format {fmt!r}")


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """Result tables of different shape in one place, tagged by a ``table`` column.

    CSV has no nested types: structs, arrays and maps are stored as JSON text.
    """
    if fmt == "csv":
        tables = {n: d.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
                                else F.col(f.name) for f in d.schema]) for n, d in tables.items()}
    write_table(stack_ragged(tables), path, fmt)


def read_bundle(spark: SparkSession, path: str, fmt: str = "json") -> dict[str, DataFrame]:
    """The tables of a bundle, each without the columns it never had."""
    df = spark.read.json(path) if fmt == "json" else spark.read.csv(path, header=True, inferSchema=True)
    present = df.groupBy("table").agg(*[F.count(c).alias(c) for c in df.columns if c != "table"]).collect()
    return {r["table"]: df.where(F.col("table") == r["table"]).select(*[c for c in df.columns if c != "table" and r[c]])
            for r in present}


def write_report(findings: DataFrame, path: str) -> None:
    """A validation report twice: JSON rows and readable text lines."""
    findings.write.mode("overwrite").json(f"{path}/json")
    line = F.concat_ws("  ", F.upper("level"), *[c for c in findings.columns if c in ("study",)], "check", F.col("value").cast("string"))
    findings.select(line.alias("value")).write.mode("overwrite").text(f"{path}/text")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
