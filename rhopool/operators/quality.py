"""Validation reports, column profiles and sanity checks. Reports are long: (check, level, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.functions.text import GENE_SYMBOL_PATTERN, SAMPLE_PATTERN, STUDY_PATTERN, TECHNOLOGIES
from rhopool.operators.clean import REQUIRED, UNIT_INTERVAL, add_missing, missing_columns
from rhopool.operators.scaling import exact_quantiles, numeric_columns

# Quality thresholds.
WARN_NULL, WARN_DUPLICATE, MIN_GENES, MAX_VALUE, MIN_SAMPLES = 0.1, 0.05, 1000, 1_000_000, 3
PENALTY_NULL, PENALTY_DUPLICATE = 0.05, 0.02
MAX_EXPRESSION_NULL, MIN_OVERLAP, MANY_SAMPLES, MANY_GENES = 0.1, 0.8, 1000, 50_000
PROFILE_COLUMNS = ["dz_ss_mean", "dz_soth_mean", "p_ss", "p_soth", "q_ss", "q_soth", "kappa_ss", "kappa_soth"]


def unpivot_metrics(row: DataFrame, metrics: list[str], name: str = "metric") -> DataFrame:
    """A one-row aggregate as (metric, value) rows."""
    return row.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, name, "value")


def table_metrics(df: DataFrame, pair: tuple[str, str] = ("GeneAName", "GeneBName")) -> DataFrame:
    """Rows, complete rows, missing percentage and distinct pairs in one aggregation."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(nulls == 0).alias("complete_cases"),
        (S.div(F.sum(nulls), F.count(F.lit(1)) * len(df.columns)) * 100.0).alias("missing_percentage"),
        F.countDistinct(*pair).alias("unique_pairs"))


def row_predicates(df: DataFrame) -> DataFrame:
    """Counts of rows that break a row-level expectation."""
    number = lambda c: F.col(c).try_cast("double")
    out = [F.count_if((number(c) < 0) | (number(c) > 1)).alias(f"{c}_out_of_range") for c in UNIT_INTERVAL]
    out += [F.count_if(number(c) <= 0).alias(f"{c}_not_positive") for c in ("n_studies_ss", "n_studies_soth")]
    out += [F.count_if(F.abs(number(c)) > 10).alias(f"{c}_extreme") for c in ("dz_ss_mean", "dz_soth_mean")]
    numeric = [c for c in (*UNIT_INTERVAL, "n_studies_ss", "n_studies_soth", "dz_ss_mean", "dz_soth_mean")]
    out += [F.count_if(F.col(c).isNotNull() & number(c).isNull()).alias(f"{c}_not_numeric") for c in numeric]
    return df.agg(*out)


def validate_pairs(df: DataFrame) -> DataFrame:
    """(check, level, value) of a pair table, with a last row is_valid (1 without errors, else 0).

    Absent required columns and p or q outside [0, 1] are errors, other broken expectations warnings, metrics info.
    Absent columns read as null, so that the other checks still run.
    """
    absent = missing_columns(df, REQUIRED)
    full = add_missing(df, REQUIRED)
    broken = row_predicates(full)
    level = F.when(F.col("check").endswith("_out_of_range"), "error").otherwise("warning")
    rows = unpivot_metrics(broken, broken.columns, "check").where("value > 0").withColumn("level", level)
    info = table_metrics(df if {"GeneAName", "GeneBName"} <= set(df.columns) else full)
    rows = rows.unionByName(unpivot_metrics(info, info.columns, "check").withColumn("level", F.lit("info")))
    if absent:
        rows = rows.unionByName(df.sparkSession.createDataFrame([(f"missing column {c}", "error", 1.0) for c in absent], "check string, level string, value double"))
    valid = rows.agg(F.count_if(F.col("level") == "error").alias("e")).select(
        F.lit("is_valid").alias("check"), F.lit("info").alias("level"), F.when(F.col("e") == 0, 1.0).otherwise(0.0).alias("value"))
    return rows.unionByName(valid).select("check", "level", "value")


def column_profile(df: DataFrame, cols: list[str] = PROFILE_COLUMNS) -> DataFrame:
    """mean, median, sd, min, max and missing count per column, one row each."""
    med = exact_quantiles(df, cols, [0.5])
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), F.lit(med[c][0]).cast("double").alias("median"),
                              F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                              F.max(c).cast("double").alias("max"), F.count_if(F.col(c).isNull()).alias("missing"))
                     .alias(c) for c in cols])
    return stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), f"{c}.*") for c in cols])))


def significance_counts(df: DataFrame) -> DataFrame:
    p, o = F.col("p_ss"), F.col("p_soth")
    return df.agg(
        F.count(F.lit(1)).alias("total_pairs"), F.count_if(p < 0.05).alias("significant_ss"),
        F.count_if(o < 0.01).alias("significant_soth"), F.count_if((p < 0.05) & (o < 0.05)).alias("significant_both"),
        F.count_if((F.abs("dz_ss_mean") > 0.5) & (F.abs("dz_soth_mean") > 1.0)).alias("large_effects"))


def unique_genes(df: DataFrame, a: str = "GeneAName", b: str = "GeneBName") -> DataFrame:
    return df.select(F.explode(F.array(a, b)).alias("g")).agg(F.countDistinct("g").alias("unique_genes"))


def overlap_ratios(tagged: DataFrame, sources: list[str], key: str = "sample", tag: str = "source",
                   by: list[str] | None = None) -> DataFrame:
    """Pairwise intersection / union of key sets given as (key, source) rows."""
    by = by or []
    flags = tagged.groupBy(*by, key).agg(*[F.max((F.col(tag) == s).cast("int")).alias(s) for s in sources])
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1:]]
    return flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("all_keys"),
        *[S.div(F.sum(F.col(a) * F.col(b)), F.count(F.lit(1))).alias(f"{a}_{b}_overlap") for a, b in pairs])


def null_duplicate_ratios(df: DataFrame) -> DataFrame:
    """Null cell share, duplicated row share and number of all-null columns."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    cells = df.agg(F.count(F.lit(1)).alias("rows"), S.div(F.sum(nulls), F.count(F.lit(1)) * len(df.columns)).alias("null_ratio"),
                   sum((F.when(F.count(c) == 0, 1).otherwise(0) for c in df.columns), F.lit(0)).alias("empty_columns"))
    distinct = df.groupBy(*df.columns).count().agg(F.count(F.lit(1)).alias("d"), F.sum("count").alias("n"))
    dup = distinct.select(S.div(F.col("n") - F.col("d"), "n").alias("r")).scalar()
    return cells.withColumn("duplicate_ratio", F.coalesce(dup, F.lit(0.0)))


def matrix_quality(expression: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Dimensions, null share, range, negatives and duplicate symbols of a long (gene, sample, value) matrix."""
    by = by or []
    cells = expression.groupBy(*by).agg(
        F.countDistinct("gene").alias("genes"), F.countDistinct("sample").alias("samples"),
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("value").isNull()).alias("null_cells"),
        F.max("value").alias("max_value"), F.min("value").alias("min_value"),
        F.count_if(F.col("value") < 0).alias("negative_cells"))
    repeated = (expression.groupBy(*by, "gene", "sample").agg(F.count(F.lit(1)).alias("n"))
                .groupBy(*by, "gene").agg(F.max("n").alias("n"))
                .groupBy(*by).agg(F.sum(F.col("n") - 1).alias("duplicate_symbols")))
    if by:
        return cells.join(repeated, by)
    dup = repeated.select("duplicate_symbols").scalar()
    return cells.withColumn("duplicate_symbols", dup)


def sanity_checks(m: DataFrame, contrast: str = "ss") -> DataFrame:
    """Counts of rows where the interval misses the mean, q < p, or p disagrees with z."""
    c = contrast
    return m.agg(
        F.count_if((F.col(f"dz_{c}_mean") < F.col(f"dz_{c}_ci_low")) | (F.col(f"dz_{c}_mean") > F.col(f"dz_{c}_ci_high")))
         .alias("ci_misses_mean"),
        F.count_if(F.col(f"q_{c}") < F.col(f"p_{c}") - 1e-12).alias("q_below_p"),
        F.count_if(F.abs(F.col(f"p_{c}") - S.two_sided_p(f"dz_{c}_z")) > 1e-6).alias("p_not_from_z"),
        F.count_if((F.col(f"dz_{c}_I2") < 0) | (F.col(f"dz_{c}_I2") > 100)).alias("i2_out_of_range"))


# --- study validation: all studies at once -------------------------------------

EXPERIMENT_FIELDS = ["accession_code", "title", "organism"]


def _finding(df: DataFrame, check: str, level: str, value: Column, when: Column) -> DataFrame:
    return df.where(when).select("study", F.lit(check).alias("check"), F.lit(level).alias("level"),
                                 value.cast("double").alias("value"))


def validate_studies(experiments: DataFrame, samples: DataFrame, annotations: DataFrame,
                     expression: DataFrame, min_genes: int = MIN_GENES) -> DataFrame:
    """Findings for every study in one job.

    experiments(study, accession_code, title, organism, technology), samples(study, sample, accession_code),
    annotations(study, accession_code, experiment_accession_code, organism, ...), expression(study, gene, sample, value).
    """
    out = []
    f = lambda *a: out.append(_finding(*a))
    one = F.lit(1.0)
    f(experiments, "study code format", "warning", one, ~F.col("study").rlike(f"^(?:{STUDY_PATTERN})"))
    for field in EXPERIMENT_FIELDS:
        f(experiments, f"experiment field {field}", "error", one, F.col(field).isNull())
    f(experiments, "technology", "warning", one, F.col("technology").isNotNull() & (F.col("technology") != "")
      & ~F.col("technology").isin(TECHNOLOGIES))

    per_json = samples.groupBy("study").agg(F.count(F.lit(1)).alias("n"),
                                            F.count_if(F.col("accession_code").isNull()).alias("bad"))
    per_json = experiments.select("study").join(per_json, "study", "left")
    f(per_json, "no sample records", "error", one, F.col("n").isNull())
    f(per_json, "json samples", "metric", F.col("n"), F.col("n").isNotNull())
    f(per_json, "invalid sample records", "warning", F.col("bad"), F.col("bad") > 0)

    cols = [c for c in annotations.columns if c != "study"]
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    rows = annotations.withColumn("_nulls", nulls).groupBy(*annotations.columns).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_nulls").alias("_nulls"))
    rows = rows.withColumn("_bad", ~F.col("accession_code").rlike(SAMPLE_PATTERN))
    tsv = rows.groupBy("study").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("distinct"), F.sum("_nulls").alias("nulls"),
        F.sum(F.when(F.col("_bad"), F.col("_n")).otherwise(0)).alias("bad"))
    tsv = tsv.withColumns({"null_ratio": S.div("nulls", F.col("n") * len(cols)),
                           "duplicate_ratio": S.div(F.col("n") - F.col("distinct"), "n")})
    tsv = experiments.select("study").join(tsv, "study", "left")
    f(tsv, "annotation empty", "error", one, F.col("n").isNull())
    f(tsv, "annotation rows", "metric", F.col("n"), F.col("n").isNotNull())
    f(tsv, "annotation null ratio", "metric", F.col("null_ratio"), F.col("n").isNotNull())
    f(tsv, "annotation duplicate ratio", "metric", F.col("duplicate_ratio"), F.col("n").isNotNull())
    f(tsv, "invalid sample accessions", "warning", F.col("bad"), F.col("bad") > 0)
    f(tsv, "high annotation null ratio", "warning", F.col("null_ratio"), F.col("null_ratio") > WARN_NULL)
    f(tsv, "high annotation duplicate ratio", "warning", F.col("duplicate_ratio"), F.col("duplicate_ratio") > WARN_DUPLICATE)

    genes = expression.groupBy("study", "gene").agg(F.max(F.lit(1)).alias("x"))
    invalid = genes.groupBy("study").agg(F.count(F.lit(1)).alias("g"),
                                         F.count_if(~F.col("gene").rlike(GENE_SYMBOL_PATTERN)).alias("bad"))
    f(invalid, "invalid gene symbols", "warning", F.col("bad"), F.col("bad") > F.col("g") * 0.1)
    mq = matrix_quality(expression, ["study"]).withColumn("null_ratio", S.div("null_cells", "cells"))
    mq = experiments.select("study").join(mq, "study", "left")
    f(mq, "expression empty", "error", one, F.col("cells").isNull())
    f(mq, "expression genes", "metric", F.col("genes"), F.col("cells").isNotNull())
    f(mq, "expression samples", "metric", F.col("samples"), F.col("cells").isNotNull())
    f(mq, "expression null ratio", "metric", F.col("null_ratio"), F.col("cells").isNotNull())
    f(mq, "low gene count", "warning", F.col("genes"), F.col("genes") < min_genes)
    f(mq, "low sample count", "warning", F.col("samples"), F.col("samples") < MIN_SAMPLES)
    f(mq, "high expression null ratio", "warning", F.col("null_ratio"), F.col("null_ratio") > MAX_EXPRESSION_NULL)
    f(mq, "high expression values", "warning", F.col("max_value"), F.col("max_value") > MAX_VALUE)
    f(mq, "negative expression values", "warning", F.col("min_value"), F.col("min_value") < 0)
    f(mq, "duplicate gene symbols", "warning", F.col("duplicate_symbols"), F.col("duplicate_symbols") > 0)
    f(mq, "many samples", "warning", F.col("samples"), F.col("samples") > MANY_SAMPLES)
    f(mq, "many genes", "warning", F.col("genes"), F.col("genes") > MANY_GENES)

    tagged = reduce(DataFrame.unionByName, [
        samples.select("study", "sample", F.lit("json").alias("source")),
        annotations.where("accession_code is not null").select("study", F.col("accession_code").alias("sample"),
                                                               F.lit("tsv").alias("source")),
        expression.select("study", "sample", F.lit("expression").alias("source"))])
    ov = overlap_ratios(tagged, ["json", "tsv", "expression"], by=["study"])
    for c in ("json_tsv", "tsv_expression", "json_expression"):
        f(ov, f"{c} overlap", "metric", F.col(f"{c}_overlap"), F.lit(True))
        f(ov, f"low {c} overlap", "warning", F.col(f"{c}_overlap"), F.col(f"{c}_overlap") < MIN_OVERLAP)

    refs = annotations.groupBy("study", "experiment_accession_code", "organism").agg(F.max(F.lit(1)).alias("x"))
    ref = (refs.join(experiments.select("study", F.col("accession_code").alias("code"), F.col("organism").alias("org")), "study")
           .groupBy("study").agg(
               F.bool_or(F.col("experiment_accession_code") == F.col("code")).alias("code_ok"),
               F.bool_or(F.col("organism") == F.col("org")).alias("org_ok"),
               F.count("experiment_accession_code").alias("codes"), F.count("organism").alias("orgs")))
    f(ref, "experiment accession mismatch", "warning", one, (F.col("codes") > 0) & ~F.col("code_ok"))
    f(ref, "organism mismatch", "warning", one, (F.col("orgs") > 0) & ~F.col("org_ok"))
    return reduce(DataFrame.unionByName, out)


def quality_score(findings: DataFrame) -> DataFrame:
    """0-100 per study: 0 with any error, minus 5 per warning and fixed penalties on the metrics."""
    metric = lambda name: F.max(F.when((F.col("check") == name) & (F.col("level") == "metric"), F.col("value")))
    s = findings.groupBy("study").agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"),
        F.coalesce(metric("annotation null ratio"), F.lit(0.0)).alias("_null"),
        F.coalesce(metric("annotation duplicate ratio"), F.lit(0.0)).alias("_dup"),
        F.coalesce(metric("expression null ratio"), F.lit(0.0)).alias("_xnull"),
        *[F.coalesce(metric(f"{c} overlap"), F.lit(1.0)).alias(f"_{c}")
          for c in ("json_tsv", "tsv_expression", "json_expression")])
    overlap = (F.col("_json_tsv") + F.col("_tsv_expression") + F.col("_json_expression")) / 3.0
    penalty = lambda cond, v: F.when(cond, F.lit(float(v))).otherwise(F.lit(0.0))
    score = (F.lit(100.0) - F.col("warnings") * 5.0 - penalty(F.col("_null") > PENALTY_NULL, 10)
             - penalty(F.col("_dup") > PENALTY_DUPLICATE, 5) - penalty(F.col("_xnull") > MAX_EXPRESSION_NULL, 15)
             - penalty(overlap < MIN_OVERLAP, 20))
    return s.select("study", "errors", "warnings",
                    F.when(F.col("errors") > 0, F.lit(0.0))
                     .otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))).alias("quality_score"))
