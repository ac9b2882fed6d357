"""Queries of the cleaning, quality, feature, rule, text, join and report operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rhopool.functions import features as FE
from rhopool.functions import stats as S
from rhopool.functions import text as T
from rhopool.operators import clean as C
from rhopool.operators import meta as M
from rhopool.operators import quality as QU
from rhopool.operators import reports as R
from rhopool.operators import rules as RU
from rhopool.operators import scaling as SC
from rhopool.operators import upsert as U
from rhopool.plans import fixtures as X
from rhopool.plans import sqltext as Q
from rhopool.plans.registry import query, r, rounded, rs

PM = Q.metrics()
# The pair table with holes, out-of-range values and infinities.
DIRTY = PM + """,
dirty AS MATERIALIZED (SELECT * REPLACE (
    CASE WHEN GeneAKey % 7 = 0 THEN NULL ELSE dz_ss_I2 END AS dz_ss_I2,
    CASE WHEN GeneBKey % 5 = 0 THEN NULL WHEN GeneBKey % 11 = 0 THEN -abs_dz_ss ELSE abs_dz_ss END AS abs_dz_ss,
    q_soth * 1.5 AS q_soth,
    CASE WHEN GeneAKey = 4 THEN NULL ELSE p_ss END AS p_ss), {0} AS extra FROM pm)""".format(
        "CASE WHEN GeneBKey % 9 = 0 THEN CAST('inf' AS DOUBLE) WHEN GeneBKey % 9 = 1 THEN CAST('nan' AS DOUBLE) ELSE dz_ss_z END")


def dirty(spark, sf):
    a, b = F.col("GeneAKey"), F.col("GeneBKey")
    return X.metrics(spark, sf).withColumns({
        "dz_ss_I2": F.when(a % 7 != 0, F.col("dz_ss_I2")),
        "abs_dz_ss": F.when(b % 5 == 0, None).when(b % 11 == 0, -F.col("abs_dz_ss")).otherwise(F.col("abs_dz_ss")),
        "q_soth": F.col("q_soth") * 1.5, "p_ss": F.when(a != 4, F.col("p_ss")),
        "extra": F.when(b % 9 == 0, float("inf")).when(b % 9 == 1, float("nan")).otherwise(F.col("dz_ss_z"))})


# --- cleaning ---------------------------------------------------------------------

@query("critical_null_drop", Q.with_(DIRTY, "SELECT pair_id FROM dirty WHERE GeneAName IS NOT NULL AND GeneBName IS NOT NULL AND p_ss IS NOT NULL AND p_soth IS NOT NULL"))
def critical_null_drop(spark, sf):
    return C.drop_critical_nulls(dirty(spark, sf)).select("pair_id")


@query("median_imputation", Q.with_(DIRTY, f"""SELECT pair_id, {r('coalesce(dz_ss_I2, (SELECT median(dz_ss_I2) FROM dirty))', 'dz_ss_I2')},
  {r('coalesce(abs_dz_ss, (SELECT median(abs_dz_ss) FROM dirty))', 'abs_dz_ss')} FROM dirty"""))
def median_imputation(spark, sf):
    return rounded(SC.fill_median(dirty(spark, sf), ["dz_ss_I2", "abs_dz_ss"]).select("pair_id", "dz_ss_I2", "abs_dz_ss"))


@query("zero_imputation", Q.with_(DIRTY, f"SELECT pair_id, {r('coalesce(dz_ss_I2, 0)', 'dz_ss_I2')}, {r('coalesce(abs_dz_ss, 0)', 'abs_dz_ss')} FROM dirty"))
def zero_imputation(spark, sf):
    return rounded(SC.fill_zero(dirty(spark, sf), ["dz_ss_I2", "abs_dz_ss"]).select("pair_id", "dz_ss_I2", "abs_dz_ss"))


@query("range_clamp", Q.with_(DIRTY, f"""SELECT pair_id, {r('CASE WHEN abs_dz_ss IS NOT NULL THEN greatest(abs_dz_ss, 0) END', 'abs_dz_ss')},
  {r('least(greatest(q_soth, 0), 1)', 'q_soth')} FROM dirty"""))
def range_clamp(spark, sf):
    return rounded(C.clamp(dirty(spark, sf)).select("pair_id", "abs_dz_ss", "q_soth"))


@query("nonfinite_to_null", Q.with_(DIRTY, f"SELECT pair_id, {r('CASE WHEN isfinite(extra) THEN extra END', 'extra')} FROM dirty"))
def nonfinite_to_null(spark, sf):
    return rounded(SC.null_nonfinite(dirty(spark, sf), ["extra"]).select("pair_id", "extra"))


@query("finite_pairs", Q.with_(DIRTY, f"SELECT pair_id, {r('extra')}, {r('dz_soth_mean')} FROM dirty WHERE isfinite(extra) AND isfinite(dz_soth_mean)"))
def finite_pairs(spark, sf):
    return rounded(C.finite_pairs(dirty(spark, sf), "extra", "dz_soth_mean").select("pair_id", "extra", "dz_soth_mean"))


@query("clean_pairs", Q.with_(DIRTY + """,
kept AS (SELECT * FROM dirty WHERE p_ss IS NOT NULL AND p_soth IS NOT NULL),
med AS (SELECT median(dz_ss_I2) AS mi, median(abs_dz_ss) AS ma FROM kept)""", f"""
SELECT pair_id, {r('coalesce(dz_ss_I2, mi)', 'dz_ss_I2')}, {r('greatest(coalesce(abs_dz_ss, ma), 0)', 'abs_dz_ss')},
  {r('least(greatest(q_soth, 0), 1)', 'q_soth')}, {r('sqrt(dz_ss_mean * dz_ss_mean + dz_soth_mean * dz_soth_mean)', 'effect_magnitude')},
  {r('-log10(p_ss * p_soth + 1e-10)', 'significance_composite')} FROM kept, med"""))
def clean_pairs(spark, sf):
    c = C.clean_pairs(dirty(spark, sf))
    return rounded(c.select("pair_id", "dz_ss_I2", "abs_dz_ss", "q_soth", "effect_magnitude", "significance_composite"))


@query("numeric_coercion", """SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS DOUBLE) AS number,
  TRY_CAST(c_mktsegment AS DOUBLE) AS segment_number FROM customer""")
def numeric_coercion(spark, sf):
    c = X.table(spark, sf, "customer")
    return c.select("c_custkey", C.coerce_number(F.regexp_extract("c_name", r"([0-9]+)$", 1)).alias("number"),
                    C.coerce_number("c_mktsegment").alias("segment_number"))


@query("boolean_parsing", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS flag,
  CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS strict_flag FROM orders""")
def boolean_parsing(spark, sf):
    words = F.element_at(F.array(*map(F.lit, ["Yes", " TRUE", "1", "off", "", "perhaps"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o = X.table(spark, sf, "orders").select("o_orderkey", words.alias("w"))
    return o.select("o_orderkey", C.parse_bool("w").alias("flag"), C.parse_bool("w", strict=True).alias("strict_flag"))


@query("significance_class", Q.with_(PM, """SELECT pair_id, CASE WHEN p_ss < 0.05 AND p_soth < 0.01 THEN 'both'
  WHEN p_ss < 0.1 OR p_soth < 0.05 THEN 'one' ELSE 'none' END AS significance FROM pm"""))
def significance(spark, sf):
    return X.metrics(spark, sf).select("pair_id", C.significance_class().alias("significance"))


@query("row_predicates", Q.with_(DIRTY, """SELECT count(*) FILTER (p_ss < 0 OR p_ss > 1) AS p_ss_out_of_range,
  count(*) FILTER (p_soth < 0 OR p_soth > 1) AS p_soth_out_of_range, count(*) FILTER (q_ss < 0 OR q_ss > 1) AS q_ss_out_of_range,
  count(*) FILTER (q_soth < 0 OR q_soth > 1) AS q_soth_out_of_range, count(*) FILTER (n_studies_ss <= 0) AS n_studies_ss_not_positive,
  count(*) FILTER (n_studies_soth <= 0) AS n_studies_soth_not_positive, count(*) FILTER (abs(dz_ss_mean) > 10) AS dz_ss_mean_extreme,
  count(*) FILTER (abs(dz_soth_mean) > 10) AS dz_soth_mean_extreme, """ + ", ".join(
    f"count(*) FILTER ({c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) AS {c}_not_numeric"
    for c in ("p_ss", "p_soth", "q_ss", "q_soth", "n_studies_ss", "n_studies_soth", "dz_ss_mean", "dz_soth_mean")) + " FROM dirty"))
def row_predicates(spark, sf):
    return QU.row_predicates(dirty(spark, sf))


# --- quality --------------------------------------------------------------------

@query("table_metrics", f"""SELECT count(*) AS total_records, count(*) FILTER (nulls = 0) AS complete_cases,
  {r('sum(nulls) * 100.0 / (count(*) * 3)', 'missing_percentage')}, count(DISTINCT (p_brand, t)) AS unique_pairs
FROM (SELECT p_brand, t, x, CASE WHEN t IS NULL THEN 1 ELSE 0 END + CASE WHEN x IS NULL THEN 1 ELSE 0 END AS nulls
      FROM (SELECT p_brand, p_type AS t, CASE WHEN p_size > 10 THEN p_size END AS x FROM part))""")
def table_metrics(spark, sf):
    p = X.table(spark, sf, "part").select("p_brand", F.col("p_type").alias("t"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("x"))
    return rounded(QU.table_metrics(p, ("p_brand", "t")))


@query("validate_pairs", Q.with_(DIRTY, """SELECT 'q_soth_out_of_range' AS "check", 'error' AS level, CAST(count(*) AS DOUBLE) AS value FROM dirty WHERE q_soth > 1 HAVING count(*) > 0
UNION ALL SELECT 'total_records', 'info', count(*) FROM dirty
UNION ALL SELECT 'unique_pairs', 'info', count(DISTINCT (GeneAName, GeneBName)) FROM dirty
UNION ALL SELECT 'is_valid', 'info', CASE WHEN count(*) FILTER (q_soth > 1) = 0 THEN 1 ELSE 0 END FROM dirty"""))
def validate_pairs(spark, sf):
    v = QU.validate_pairs(dirty(spark, sf))
    return v.where(~F.col("check").isin("complete_cases", "missing_percentage"))


_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r(f'avg({c})', 'mean')}, {r(f'median({c})', 'median')}, {r(f'stddev_samp({c})', 'std')},
  {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, count(*) FILTER ({c} IS NULL) AS missing FROM dirty""" for c in QU.PROFILE_COLUMNS)


@query("column_profile", Q.with_(DIRTY, _PROFILE))
def column_profile(spark, sf):
    return rounded(QU.column_profile(dirty(spark, sf)))


@query("significance_counts", Q.with_(PM, """SELECT count(*) AS total_pairs, count(*) FILTER (p_ss < 0.05) AS significant_ss,
  count(*) FILTER (p_soth < 0.01) AS significant_soth, count(*) FILTER (p_ss < 0.05 AND p_soth < 0.05) AS significant_both,
  count(*) FILTER (abs(dz_ss_mean) > 0.5 AND abs(dz_soth_mean) > 1.0) AS large_effects FROM pm"""))
def significance_counts(spark, sf):
    return QU.significance_counts(X.metrics(spark, sf))


@query("unique_genes", Q.with_(PM, "SELECT count(DISTINCT g) AS unique_genes FROM (SELECT GeneAName AS g FROM pm UNION ALL SELECT GeneBName FROM pm)"))
def unique_genes(spark, sf):
    return QU.unique_genes(X.metrics(spark, sf))


@query("source_overlap", f"""SELECT count(*) AS all_keys, {r('sum(a * b) * 1.0 / count(*)', 'json_tsv_overlap')},
  {r('sum(a * c) * 1.0 / count(*)', 'json_expression_overlap')}, {r('sum(b * c) * 1.0 / count(*)', 'tsv_expression_overlap')}
FROM (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS b,
             max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS c FROM orders GROUP BY 1)""")
def source_overlap(spark, sf):
    t = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("sample"), M.map_labels(
        "o_orderstatus", {"F": "json", "O": "tsv", "P": "expression"}).alias("source"))
    return rounded(QU.overlap_ratios(t, ["json", "tsv", "expression"]))


@query("null_duplicate_ratios", f"""SELECT count(*) AS rows, {r('avg(CASE WHEN s IS NULL THEN 1.0 ELSE 0.0 END) / 3', 'null_ratio')},
  0 AS empty_columns, {r('(count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, CASE WHEN p_size > 10 THEN p_size END FROM part))) * 1.0 / count(*)', 'duplicate_ratio')}
FROM (SELECT CASE WHEN p_size > 10 THEN p_size END AS s FROM part)""")
def null_duplicate_ratios(spark, sf):
    p = X.table(spark, sf, "part").select("p_brand", "p_type", F.when(F.col("p_size") > 10, F.col("p_size")).alias("s"))
    return rounded(QU.null_duplicate_ratios(p))


@query("matrix_quality", Q.with_(Q.EXPR, f"""SELECT count(DISTINCT gene) AS genes, count(DISTINCT sample) AS samples, count(*) AS cells,
  count(*) FILTER (value IS NULL) AS null_cells, {r('max(value)', 'max_value')}, {r('min(value)', 'min_value')},
  count(*) FILTER (value < 0) AS negative_cells,
  CAST((SELECT sum(m - 1) FROM (SELECT gene, max(n) AS m FROM (SELECT gene, sample, count(*) AS n FROM expr GROUP BY 1, 2) GROUP BY 1)) AS BIGINT) AS duplicate_symbols
FROM expr"""))
def matrix_quality(spark, sf):
    return rounded(QU.matrix_quality(X.expression_long(spark, sf)))


@query("sanity_checks", Q.with_(PM, """SELECT count(*) FILTER (GeneAKey % 3 = 0 AND dz_ss_mean IS NOT NULL) AS ci_misses_mean, count(*) FILTER (GeneBKey % 4 = 0 AND p_ss IS NOT NULL) AS q_below_p,
  count(*) FILTER (GeneAKey % 5 = 0 AND abs(p_ss - 1) > 1e-6) AS p_not_from_z, count(*) FILTER (GeneBKey % 6 = 0) AS i2_out_of_range FROM pm"""))
def sanity_checks(spark, sf):
    """Each violation is planted in a part of the rows; the others have none."""
    a, b = F.col("GeneAKey"), F.col("GeneBKey")
    return QU.sanity_checks(X.metrics(spark, sf).withColumns({
        "dz_ss_ci_low": F.when(a % 3 == 0, F.col("dz_ss_mean") + 1).otherwise(F.col("dz_ss_ci_low")), "q_ss": F.when(b % 4 == 0, F.col("p_ss") - 0.1).otherwise(F.col("q_ss")),
        "dz_ss_z": F.when(a % 5 == 0, 0.0).otherwise(F.col("dz_ss_z")), "dz_ss_I2": F.when(b % 6 == 0, 101.0).otherwise(F.col("dz_ss_I2"))}))


# --- scaling and scores ------------------------------------------------------------

@query("minmax_scale", Q.with_(PM, f"""SELECT pair_id, {r('(rank_score - (SELECT min(rank_score) FROM pm)) / ((SELECT max(rank_score) - min(rank_score) FROM pm) + 1e-12)', 'scaled')} FROM pm"""))
def minmax_scale(spark, sf):
    return rounded(SC.minmax(X.metrics(spark, sf).select("pair_id", "rank_score"), {"rank_score": "scaled"}).select("pair_id", "scaled"))


@query("standard_scale", f"""SELECT l_orderkey, l_linenumber, {r('(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem)', 'l_quantity')},
  {r('(l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem)', 'l_tax')} FROM lineitem""")
def standard_scale(spark, sf):
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(SC.standard_scale(li, ["l_quantity", "l_tax"]))


@query("robust_scale", f"""SELECT l_orderkey, l_linenumber, {r('(l_extendedprice - (SELECT median(l_extendedprice) FROM lineitem)) / (SELECT quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) FROM lineitem)', 'l_extendedprice')} FROM lineitem""")
def robust_scale(spark, sf):
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(SC.robust_scale(li, ["l_extendedprice"]))


@query("metrics_score", Q.with_(PM + """,
f AS (SELECT pair_id, -log10(greatest(q_ss, 1e-300)) AS f1, abs_dz_ss AS f2, kappa_ss AS f3, -log10(greatest(q_soth, 1e-300)) AS f4,
  abs_dz_soth AS f5, kappa_soth AS f6, combined_effect_size AS f7, power_score AS f8, consistency_score AS f9, direction_consistency AS f10,
  magnitude_consistency AS f11 FROM (SELECT pair_id, coalesce(q_ss, 0) AS q_ss, coalesce(q_soth, 0) AS q_soth, """
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("abs_dz_ss", "kappa_ss", "abs_dz_soth", "kappa_soth", "combined_effect_size",
                                                      "power_score", "consistency_score", "direction_consistency", "magnitude_consistency"))
    + " FROM pm))", "SELECT pair_id, " + r("(" + " + ".join(
        f"(f{i} - (SELECT min(f{i}) FROM f)) / ((SELECT max(f{i}) - min(f{i}) FROM f) + 1e-12)" for i in range(1, 12)) + ") / 11", "metrics_score") + " FROM f"))
def metrics_score(spark, sf):
    from rhopool.operators.scores import metrics_score as score
    return rounded(score(X.metrics(spark, sf)).select("pair_id", "metrics_score"))


@query("two_condition_features", Q.with_(PM + """, zz AS (SELECT *, CASE WHEN p_ss > 0 THEN dz_ss_z ELSE 0 END AS z1, CASE WHEN p_soth > 0 THEN dz_soth_z ELSE 0 END AS z2 FROM pm)""",
    f"SELECT pair_id, {r('sqrt(p_ss * p_soth)', 'combined_p_value')}, {r('sqrt(abs_dz_ss * abs_dz_soth)', 'combined_effect_size')}, "
    f"{r('dz_soth_mean - dz_ss_mean', 'delta_effect_size')}, {r('abs(dz_soth_mean - dz_ss_mean)', 'abs_delta_effect_size')}, {r('z1', 'dz_ss_z', 4)}, {r('z2', 'dz_soth_z', 4)}, "
    f"{r('sqrt(z1 * z1 + z2 * z2)', 'combined_z_score', 3)}, {r('(z1 * z1 + z2 * z2) / (z1 * z1 + z2 * z2 + 1)', 'statistical_power', 3)} FROM zz"))
def two_condition_features(spark, sf):
    """All pairs. The z implied by p and sign must reproduce the pooled z that p came from; it is 0 without a p above 0."""
    m = FE.two_condition_features(X.metrics(spark, sf))
    m = m.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in (("dz_ss_z", 4), ("dz_soth_z", 4), ("combined_z_score", 3), ("statistical_power", 3))})
    return rounded(m.select("pair_id", "combined_p_value", "combined_effect_size", "delta_effect_size", "abs_delta_effect_size", "dz_ss_z", "dz_soth_z", "combined_z_score", "statistical_power"))


@query("baseline_similarity", Q.with_(PM + """,
b AS (SELECT dz_ss_mean AS x, dz_soth_mean AS y FROM pm WHERE least(GeneAName, GeneBName) = 'Brand#1' AND greatest(GeneAName, GeneBName) = 'Brand#2'),
d AS (SELECT pair_id, sqrt(power(dz_ss_mean - x, 2) + power(dz_soth_mean - y, 2)) AS d FROM pm, b)""",
    f"SELECT pair_id, {r('1 - d / (SELECT max(d) FROM d)', 'baseline_similarity')} FROM d"))
def baseline_similarity(spark, sf):
    from rhopool.operators.scores import baseline_similarity as sim
    return rounded(sim(X.metrics(spark, sf), ("Brand#1", "Brand#2")).select("pair_id", "baseline_similarity"))


def _ratio(a, b):
    return f"CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN 1000 WHEN ({a}) < 0 THEN -1000 ELSE 0 END ELSE ({a}) / ({b}) END"


def _over(c, floor="1e-10"):
    return f"CASE WHEN {c} IS NOT NULL THEN greatest({c}, {floor}) END"


def _both(fn, a, b):
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {fn}({a}, {b}) END"


_P, _O = f"({_over('p_ss')})", f"({_over('p_soth')})"
_QS, _QO = f"({_over('q_ss')})", f"({_over('q_soth')})"
_FEATURES = {
    "effect_features": {"effect_size_ratio": _ratio("dz_ss_mean", "dz_soth_mean"), "effect_size_diff": "dz_ss_mean - dz_soth_mean",
                        "effect_size_sum": "dz_ss_mean + dz_soth_mean", "effect_size_product": "dz_ss_mean * dz_soth_mean"},
    "p_features": {"log_p_ss": f"-log10({_P})", "log_p_soth": f"-log10({_O})", "p_composite": f"coalesce({_P} * {_O}, 1)",
                   "p_harmonic_mean": f"2 / (1 / {_P} + 1 / {_O})"},
    "ci_features": {f"ci_{c}_{n}": e.replace("@", c) for c in ("ss", "soth") for n, e in (
        ("width", "dz_@_ci_high - dz_@_ci_low"), ("center", "(dz_@_ci_high + dz_@_ci_low) / 2"),
        ("relative_width", "(dz_@_ci_high - dz_@_ci_low) / (abs((dz_@_ci_high + dz_@_ci_low) / 2) + 1e-10)"))},
    "i2_features": {"i2_ratio": _ratio("dz_ss_I2", "dz_soth_I2"), "i2_max": _both("greatest", "dz_ss_I2", "dz_soth_I2"),
                    "i2_min": _both("least", "dz_ss_I2", "dz_soth_I2"), "i2_mean": "(dz_ss_I2 + dz_soth_I2) / 2"},
    "z_features": {"z_composite": "sqrt(dz_ss_z * dz_ss_z + dz_soth_z * dz_soth_z)", "z_ratio": _ratio("abs(dz_ss_z)", "abs(dz_soth_z)"),
                   "z_sum": "dz_ss_z + dz_soth_z", "z_product": "dz_ss_z * dz_soth_z"},
    "study_features": {"total_studies": "n_studies_ss + n_studies_soth", "study_ratio": _ratio("n_studies_ss", "n_studies_soth"),
                       "study_log_ratio": f"ln({_ratio('n_studies_ss', 'n_studies_soth')} + 1e-10)"},
    "q_features": {"log_q_ss": f"-log10({_QS})", "log_q_soth": f"-log10({_QO})", "q_composite": f"coalesce(2 / (1 / ({_QS} + 1e-10) + 1 / ({_QO} + 1e-10)), 1)",
                   "q_max": _both("greatest", _QS, _QO), "q_min": _both("least", _QS, _QO)},
}
# Over all pairs, with missing inputs: a feature of a missing input is missing, but for the two composites, which are 1.
for _name, _cols in _FEATURES.items():
    def _features(spark, sf, cols=tuple(_cols)):
        d = FE.derived_features(dirty(spark, sf), absolute=False)
        return rounded(d.select("pair_id", *[F.col(c).cast("double").alias(c) for c in cols]))
    query(_name, Q.with_(DIRTY, f"SELECT pair_id, {', '.join(r(e, n) for n, e in _cols.items())} FROM dirty"))(_features)


@query("absolute_block", Q.with_(DIRTY, f"""SELECT pair_id, {r('abs(coalesce(dz_ss_I2, (SELECT median(dz_ss_I2) FROM dirty)))', 'dz_ss_I2_abs')},
  {r('abs(dz_ss_mean)', 'dz_ss_mean_abs')}, {r('abs(dz_ss_mean - dz_soth_mean)', 'effect_size_diff_abs')} FROM dirty"""))
def absolute_block(spark, sf):
    return rounded(FE.derived_features(dirty(spark, sf)).select("pair_id", "dz_ss_I2_abs", "dz_ss_mean_abs", "effect_size_diff_abs"))


@query("safe_ratio", f"""SELECT l_orderkey, l_linenumber, {r(_ratio('l_quantity - 25', 'l_linenumber - 3'), 'ratio')} FROM lineitem""")
def safe_ratio(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", S.safe_ratio(F.col("l_quantity") - 25, F.col("l_linenumber") - 3).alias("ratio")))


@query("feature_selection", Q.with_(PM, """SELECT name AS feature FROM (SELECT unnest([
  {'name': 'dz_ss_mean', 'v': var_samp(dz_ss_mean)}, {'name': 'p_ss', 'v': var_samp(p_ss)}, {'name': 'flat', 'v': var_samp(1.0)},
  {'name': 'rank_score', 'v': var_samp(rank_score)}], recursive := true) FROM pm) WHERE v > 0"""))
def feature_selection(spark, sf):
    m = X.metrics(spark, sf).select("dz_ss_mean", "p_ss", "rank_score").withColumns(
        {"flat": F.lit(1.0), "hollow": F.when(F.col("p_ss") < -1, 1.0)})
    kept = SC.select_features(m, ["dz_ss_mean", "p_ss", "rank_score", "flat", "hollow"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


_CORR_COLS = ["p_ss", "q_ss", "kappa_ss", "abs_dz_ss", "dz_ss_se", "dz_ss_Q"]


@query("top_correlated_features", Q.with_(PM, "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'abs(corr({c}, rank_score))', 'abs_corr')} FROM pm" for c in _CORR_COLS) + ") ORDER BY abs_corr DESC LIMIT 4"))
def top_correlated_features(spark, sf):
    m = X.metrics(spark, sf)
    top = SC.top_correlated(m, _CORR_COLS, "rank_score", 4)
    return rounded(spark.createDataFrame([(c, float(v)) for c, v in top], "feature string, abs_corr double"))


# --- rules ------------------------------------------------------------------------

def _rule_sql(c: str) -> str:
    return c.replace(" is not None", " IS NOT NULL")


def _score_sql(rules, base):
    return "(" + " + ".join(f"CASE WHEN {_rule_sql(x.condition)} THEN {x.weight} ELSE 0 END" for x in rules) + f") / {base}"


@query("rules_count_normalised", Q.with_(PM, f"SELECT pair_id, {r(_score_sql(RU.AGENT_RULES, 5.0), 'rules_score')} FROM pm"))
def rules_count(spark, sf):
    return rounded(RU.rank_by_rules(X.metrics(spark, sf)).select("pair_id", "rules_score"))


@query("rules_weight_normalised", Q.with_(PM, f"SELECT pair_id, {r(_score_sql(RU.PROJECT_RULES, 1.0), 'rules_score')} FROM pm"))
def rules_weight(spark, sf):
    return rounded(RU.apply_rules(X.metrics(spark, sf), RU.PROJECT_RULES).select("pair_id", "rules_score"))


def _rule_text(x, hit):
    return f"'Rule ''{x.name}'' {'satisfied' if hit else 'not satisfied'} (+{x.weight if hit else 0:.2f}): {x.description}'"


@query("rule_explanations", Q.with_(PM, "SELECT pair_id, concat_ws(' | ', " + ", ".join(
    f"CASE WHEN {_rule_sql(x.condition)} THEN {_rule_text(x, True)} ELSE {_rule_text(x, False)} END"
    for x in RU.PROJECT_RULES) + ") AS explanations FROM pm"))
def rule_explanations(spark, sf):
    m = RU.apply_rules(X.metrics(spark, sf), RU.PROJECT_RULES, explain=True)
    return m.select("pair_id", F.concat_ws(" | ", "rule_explanations").alias("explanations"))


@query("rules_correlation_set", Q.with_(PM, f"""SELECT pair_id, {r('(CASE WHEN combined_effect_size > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN greatest(abs(geneA_log2fc), abs(geneB_log2fc)) > 1.0 THEN 0.1 ELSE 0 END) / 1.0', 'rules_score')} FROM pm"""))
def rules_correlation_set(spark, sf):
    # Three of the five rules name columns this table lacks: false, not an error.
    return rounded(RU.apply_rules(X.metrics(spark, sf), RU.CORRELATION_RULES).select("pair_id", "rules_score"))


@query("rules_sample_set", Q.with_(PM, f"SELECT pair_id, {r(_score_sql(RU.SAMPLE_RULES, 0.7), 'rules_score')} FROM pm"))
def rules_sample_set(spark, sf):
    return rounded(RU.apply_rules(X.metrics(spark, sf), RU.SAMPLE_RULES).select("pair_id", "rules_score"))


@query("rules_dry_run", Q.with_(PM, f"""SELECT pair_id, {r('s', 'rules_score')} FROM (SELECT pair_id, {_score_sql(RU.PROJECT_RULES, 1.0)} AS s
  FROM (SELECT * FROM pm ORDER BY pair_id LIMIT 10)) ORDER BY s DESC, pair_id LIMIT 5"""))
def rules_dry_run(spark, sf):
    return rounded(RU.dry_run(X.metrics(spark, sf), RU.PROJECT_RULES).select("pair_id", "rules_score"))


@query("control_percentile", Q.with_(PM + f""",
s AS (SELECT *, {_score_sql(RU.AGENT_RULES, 5.0)} AS sc FROM pm),
c AS (SELECT max(sc) AS cs FROM s WHERE least(GeneAName, GeneBName) = 'Brand#11' AND greatest(GeneAName, GeneBName) = 'Brand#7')""",
    f"""SELECT count(*) AS n, count(*) FILTER (sc > cs) AS better, {r('(count(*) - count(*) FILTER (sc > cs)) * 1.0 / count(*)', 'percentile')},
  (count(*) - count(*) FILTER (sc > cs)) * 1.0 / count(*) >= 0.8 AS validated FROM s, c"""))
def control_percentile(spark, sf):
    ranked = RU.apply_rules(X.metrics(spark, sf), RU.AGENT_RULES, "count")
    return rounded(RU.control_percentile(ranked, ("Brand#7", "Brand#11")).select("n", "better", "percentile", "validated"))


@query("feasibility_verdict", Q.with_(PM, """SELECT pair_id, CASE WHEN q_ss <= 0.05 AND abs(dz_ss_mean) >= 0.4 AND kappa_ss >= 0.7 AND dz_ss_I2 < 60 AND n_studies_ss >= 2 THEN 'GOOD'
  WHEN q_ss > 0.1 OR abs(dz_ss_mean) < 0.2 OR dz_ss_I2 >= 75 OR kappa_ss < 0.5 OR n_studies_ss < 2 OR q_ss IS NULL OR dz_ss_mean IS NULL OR kappa_ss IS NULL THEN 'NEGATIVE'
  ELSE 'MODERATE' END AS verdict,
  concat_ws('; ', CASE WHEN coalesce(q_ss > 0.05, true) THEN 'not significant' END, CASE WHEN coalesce(abs(dz_ss_mean) < 0.4, true) THEN 'small effect' END,
  CASE WHEN coalesce(kappa_ss < 0.7, true) THEN 'low consistency' END,
  CASE WHEN dz_ss_I2 >= 75 THEN 'very high heterogeneity' WHEN dz_ss_I2 >= 60 THEN 'moderate heterogeneity' END,
  CASE WHEN coalesce(n_studies_ss < 2, true) THEN 'too few studies' END) AS red_flags FROM pm"""))
def feasibility_verdict(spark, sf):
    v = X.metrics(spark, sf).withColumns(T.feasibility())
    return v.select("pair_id", "verdict", F.concat_ws("; ", "red_flags").alias("red_flags"))


# --- text -------------------------------------------------------------------------

@query("condition_from_title", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'control|ctrl|healthy|normal') THEN 'control'
  WHEN regexp_matches(lower(text), 'sepsis|infection|infected') THEN 'sepsis' ELSE 'unknown' END AS condition FROM documents""")
def condition_from_title(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.condition_of_title("text").alias("condition"))


@query("condition_description", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Control/Healthy sample' WHEN 'O' THEN 'Sepsis/Infected sample'
  ELSE 'Unknown sample type' END AS description, concat('Gene: ', o_orderpriority) AS gene_description FROM orders""")
def condition_description(spark, sf):
    o = X.table(spark, sf, "orders")
    lab = M.map_labels("o_orderstatus", {"F": "control", "O": "sepsis", "P": "other"})
    return o.select("o_orderkey", T.condition_description(lab).alias("description"), T.gene_description("o_orderpriority").alias("gene_description"))


@query("sample_number", """SELECT c_custkey, TRY_CAST(coalesce(nullif(regexp_extract(t, '(?i)Sample\\s*(\\d+)', 1), ''), nullif(regexp_extract(t, '(?i)S(\\d+)', 1), ''),
  nullif(regexp_extract(t, '(\\d+)', 1), '')) AS BIGINT) AS number
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'sample ' || c_custkey || ' of 9' WHEN 1 THEN 'x 5 s' || c_custkey WHEN 2 THEN c_name ELSE c_mktsegment END AS t FROM customer)""")
def sample_number(spark, sf):
    k = F.col("c_custkey")
    t = (F.when(k % 4 == 0, F.concat(F.lit("sample "), k, F.lit(" of 9"))).when(k % 4 == 1, F.concat(F.lit("x 5 s"), k))
         .when(k % 4 == 2, F.col("c_name")).otherwise(F.col("c_mktsegment")))
    return X.table(spark, sf, "customer").select("c_custkey", T.sample_number(t).alias("number"))


@query("gene_type", """SELECT p_partkey, CASE WHEN starts_with(upper(p_name), 'MIR') OR starts_with(upper(p_name), 'LET') THEN 'miRNA'
  WHEN contains(upper(p_name), 'LINC') OR starts_with(upper(p_name), 'LNC') THEN 'lncRNA' WHEN starts_with(upper(p_name), 'RPL') OR starts_with(upper(p_name), 'RPS') THEN 'rRNA'
  WHEN starts_with(upper(p_name), 'TRNA') THEN 'tRNA' WHEN ends_with(upper(p_name), 'P') THEN 'pseudogene' ELSE 'protein_coding' END AS gene_type FROM part""")
def gene_type(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", T.gene_type("p_name").alias("gene_type"))


@query("platform_and_technology", """SELECT page_id, CASE WHEN contains(upper(url), 'ILLUMINA') THEN 'ILLUMINA' WHEN contains(upper(url), 'AFFY') THEN 'AFFYMETRIX'
  WHEN contains(upper(url), 'AGILENT') THEN 'AGILENT' ELSE 'OTHER' END AS platform_type,
  CASE WHEN contains(upper(html), 'RNA-SEQ') OR contains(upper(html), 'RNA SEQ') THEN 'RNA-SEQ' WHEN contains(upper(html), 'ARRAY') THEN 'MICROARRAY' ELSE 'OTHER' END AS technology FROM pages""")
def platform_and_technology(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.platform_type("url").alias("platform_type"), T.technology("html").alias("technology"))


@query("pattern_validity", r"""SELECT p_partkey, regexp_matches(p_brand, '^[A-Za-z0-9_-]+$') AS brand_ok, regexp_matches(p_type, '^[A-Za-z0-9_-]+$') AS type_ok,
  regexp_matches(p_brand, '[A-Za-z]{2,3}-[A-Za-z]{3}-\d+|[A-Za-z]{3}\d+') AS study_ok FROM part""")
def pattern_validity(spark, sf):
    return X.table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").rlike(T.GENE_SYMBOL_PATTERN).alias("brand_ok"),
        F.col("p_type").rlike(T.GENE_SYMBOL_PATTERN).alias("type_ok"), F.col("p_brand").rlike(T.STUDY_PATTERN).alias("study_ok"))


@query("truncate_text", "SELECT doc_id, substr(text, 1, 500) AS title, substr(text, 1, 4000) AS description FROM documents")
def truncate_text(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.truncate("text", T.TITLE_LENGTH).alias("title"),
                                                  T.truncate("text", T.DESCRIPTION_LENGTH).alias("description"))


@query("date_parsing", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  WHEN 3 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m 00:00:00') ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END
  ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS parsed FROM orders""")
def date_parsing(spark, sf):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    t = F.when(k == 4, F.lit("soon")).when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss")) \
         .when(k == 2, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return X.table(spark, sf, "orders").select("o_orderkey", F.date_format(T.parse_date(t), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("label_keys", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 17 END AS label_key FROM orders""")
def label_keys(spark, sf):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.lit(" control ")).when(k == 1, F.lit("Septic_Shock")).when(k == 2, F.lit("17")).otherwise(F.lit("n/a"))
    return X.table(spark, sf, "orders").select("o_orderkey", T.label_key(t).alias("label_key"))


@query("metric_texts", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_value, value AS v_value,
  value - 1 AS low, value + 1 AS high FROM events""")
def metric_texts(spark, sf):
    e = X.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    items = F.array(F.concat(F.lit("k: about "), "k"), F.concat(F.lit(" v : "), F.col("value").cast("string")), F.lit("bare"),
                    F.concat(F.lit("ci: ["), (F.col("value") - 1).cast("string"), F.lit(", "), (F.col("value") + 1).cast("string"), F.lit("]")))
    e = e.withColumn("m", T.metrics_map(items))
    ci = T.map_interval("m", "ci")
    return e.select("event_id", T.map_float("m", "k").alias("k_value"), T.map_float("m", "v").alias("v_value"),
                    ci.getField("low").alias("low"), ci.getField("high").alias("high"))


@query("json_round_trip", """SELECT event_id, event_type AS verdict, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_round_trip(spark, sf):
    e = X.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("verdict"), F.array("event_type").alias("rationale"), "props")
    e = e.withColumn("doc", T.parse_verdict(T.row_payload(["verdict", "rationale"])))
    return e.select("event_id", "doc.verdict", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("hover_text", """SELECT c_custkey, printf('%s - %s | p_ss %.4f | p_soth %.4f', c_name, c_mktsegment, CAST(c_custkey AS DOUBLE) / 8, 0.5) AS label FROM customer""")
def hover_text(spark, sf):
    c = X.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("GeneAName"), F.col("c_mktsegment").alias("GeneBName"),
        (F.col("c_custkey").cast("double") / 8).alias("p_ss"), F.lit(0.5).alias("p_soth"))
    return c.select("c_custkey", T.hover_text().alias("label"))


# --- normal distribution -------------------------------------------------------------

@query("normal_two_sided_p", f"""SELECT l_orderkey, l_linenumber, {r(Q.two_sided('((l_extendedprice - 40000.0) / 7919.0)'), 'p', 9)} FROM lineitem""")
def normal_two_sided_p(spark, sf):
    li = X.table(spark, sf, "lineitem").withColumn("z", (F.col("l_extendedprice") - 40000.0) / 7919.0)
    return rounded(li.select("l_orderkey", "l_linenumber", S.two_sided_p("z").alias("p")), 9)


@query("normal_quantile", f"""SELECT l_orderkey, l_linenumber, {r('(l_extendedprice - 40000.0) / 7919.0', 'z')} FROM lineitem""")
def normal_quantile(spark, sf):
    # The quantile of the tail of z gives z back.
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_extendedprice") - 40000.0) / 7919.0).alias("z0"))
    li = S.add_signed_z(li.withColumn("p", S.two_sided_p("z0")), "p", "z0", "z")
    return rounded(li.select("l_orderkey", "l_linenumber", "z"))


# --- joins, sets, windows, keys --------------------------------------------------------

@query("surrogate_lookup", "SELECT l_orderkey, l_linenumber, rk AS part_key FROM lineitem JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rk FROM part WHERE p_size > 5) ON l_partkey = p_partkey")
def surrogate_lookup(spark, sf):
    dim = U.number_rows(X.table(spark, sf, "part").where("p_size > 5").select("p_partkey"), ["p_partkey"], "part_key")
    f = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return U.resolve_keys(f, dim, "p_partkey", "part_key")


@query("surrogate_keys", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders")
def surrogate_keys(spark, sf):
    return U.number_rows(X.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "k").select("o_orderkey", "k")


@query("extend_dimension", """SELECT p_brand, CASE WHEN k IS NOT NULL THEN k ELSE row_number() OVER (PARTITION BY k IS NULL ORDER BY p_brand) + 10 END AS k
FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS k FROM (SELECT DISTINCT p_brand FROM part) QUALIFY k <= 10) USING (p_brand)""")
def extend_dimension(spark, sf):
    brands = X.table(spark, sf, "part").select("p_brand").distinct()
    old = U.number_rows(brands, ["p_brand"], "k").where("k <= 10")
    return U.extend_dimension(old, brands, "p_brand", "k").withColumn("k", F.col("k").cast("long"))


@query("unmatched_keys", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def unmatched_keys(spark, sf):
    dim = X.table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return U.unmatched_keys(X.table(spark, sf, "lineitem"), dim, "l_partkey")


@query("optional_enrichment", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def optional_enrichment(spark, sf):
    c = X.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = X.table(spark, sf, "orders").join(c, "o_custkey", "left")
    return o.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("stage_key_resolution", """SELECT o_orderkey, p_partkey, max(l_shipdate)::VARCHAR AS processed_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def stage_key_resolution(spark, sf):
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    o = X.table(spark, sf, "orders").select("o_orderkey")
    p = X.table(spark, sf, "part").select("p_partkey")
    o, p = o.withColumn("l_orderkey", F.col("o_orderkey")), p.withColumn("l_partkey", F.col("p_partkey"))
    j = U.resolve_stage(li.withColumnRenamed("l_shipdate", "processed_at"), [(o, "l_orderkey", "o_orderkey"), (p, "l_partkey", "p_partkey")], "processed_at")
    return j.withColumn("processed_at", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss"))


@query("latest_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) = 1")
def latest_rows(spark, sf):
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return U.latest_rows(li, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


_UPS = """tgt AS (SELECT l_orderkey AS k, l_quantity AS v, 'old' AS src FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 <> 0),
s0 AS (SELECT l_orderkey AS k, l_quantity AS v, l_shipdate, l_partkey, l_linenumber, 'new' AS src FROM lineitem WHERE l_linenumber >= 3),
s AS (SELECT k, v, src FROM s0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY l_shipdate DESC, l_partkey DESC, v DESC) = 1),
t AS (SELECT k, v, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS rn FROM tgt) WHERE rn = 1)"""


@query("upsert", Q.with_(_UPS, "SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.v ELSE t.v END AS v, coalesce(t.src, s.src) AS src FROM t FULL JOIN s ON t.k = s.k"))
def upsert(spark, sf):
    li = X.table(spark, sf, "lineitem")
    t = li.where("l_linenumber = 1 and l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"), F.lit("old").alias("src"))
    t = U.latest_rows(t, ["k"], ["v"])
    s = li.where("l_linenumber >= 3").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"), F.lit("new").alias("src"), "l_shipdate", "l_partkey")
    return U.upsert(t, s, ["k"], ["v"], order=["l_shipdate", "l_partkey", "v"])


@query("retention", "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")
def retention(spark, sf):
    o = X.table(spark, sf, "orders")
    return U.retain(o, "o_orderdate", 90, o.agg(F.max("o_orderdate")).scalar()).select("o_orderkey")


@query("sample_sets", """SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'only_f', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def sample_sets(spark, sf):
    o = X.table(spark, sf, "orders")
    k = U.key_sets(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")
    c = k.agg(F.count_if(F.col("in_left") & F.col("in_right")).alias("both"), F.count_if(F.col("in_left") & ~F.col("in_right")).alias("only_f"), F.count(F.lit(1)).alias("either"))
    return c.unpivot([], ["both", "only_f", "either"], "part", "n")


@query("ragged_stack", "SELECT 'nation' AS \"table\", n_nationkey AS id, n_name AS name, NULL AS balance FROM nation UNION ALL SELECT 'supplier', CAST(s_suppkey AS INTEGER), NULL, s_acctbal FROM supplier")
def ragged_stack(spark, sf):
    n = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    s = X.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_acctbal").alias("balance"))
    return C.stack_ragged({"nation": n, "supplier": s})


@query("preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(10)


# --- reports -----------------------------------------------------------------------

_MX = ["dz_ss_mean", "dz_soth_mean", "p_ss", "kappa_ss"]


@query("correlation_matrix", Q.with_(PM, " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})', 'r')} FROM pm" for a in _MX for b in _MX)))
def correlation_matrix(spark, sf):
    return rounded(R.correlation_matrix(X.metrics(spark, sf), _MX))


def _box(src, c):
    return f"""SELECT '{c}' AS "column", count({c}) AS n, {r('q1')}, {r('median')}, {r('q3')},
  {r(f'min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))', 'whisker_low')},
  {r(f'max({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))', 'whisker_high')},
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1, median({c}) AS median, quantile_cont({c}, 0.75) AS q3 FROM {src}) GROUP BY q1, median, q3"""


@query("box_summary", Q.with_(PM, _box("pm", "dz_ss_mean") + " UNION ALL " + _box("pm", "dz_soth_mean")))
def box_summary(spark, sf):
    return rounded(R.box_summary(X.metrics(spark, sf), ["dz_ss_mean", "dz_soth_mean"]))


@query("rho_boxes", Q.with_(Q.CORR + ", w AS (SELECT CASE WHEN condition = 'sepsis' THEN rho_spearman END AS sepsis FROM corr)", _box("w", "sepsis")))
def rho_boxes(spark, sf):
    f = X.corr_facts(spark, sf).where("condition = 'sepsis'").select(F.col("rho_spearman").alias("sepsis"))
    return rounded(R.box_summary(f, ["sepsis"]))


@query("histogram", "SELECT least(CAST(floor((l_quantity - 1) * 7 / 49) AS BIGINT) + 1, 7) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf):
    return R.histogram(X.table(spark, sf, "lineitem"), "l_quantity", 7)


@query("scatter_rows", Q.with_(PM, f"""SELECT pair_id, GeneAName, GeneBName, {rs('dz_ss_mean', 'dz_soth_mean', 'p_ss', 'p_soth')},
  CASE WHEN p_ss < 0.05 AND p_soth < 0.01 THEN 'both' WHEN p_ss < 0.1 OR p_soth < 0.05 THEN 'one' ELSE 'none' END AS significance
  FROM pm WHERE dz_ss_mean IS NOT NULL AND dz_soth_mean IS NOT NULL"""))
def scatter_rows(spark, sf):
    return rounded(R.scatter_rows(X.metrics(spark, sf)))


@query("label_counts", "SELECT CAST(label AS BIGINT) AS label, count(*) AS size FROM embeddings GROUP BY 1")
def label_counts(spark, sf):
    return R.label_counts(X.table(spark, sf, "embeddings"), "label")


@query("cluster_summary", "SELECT count(DISTINCT CASE WHEN label <> 0 THEN label END) AS n_clusters, count(*) FILTER (label = 0) AS n_noise FROM embeddings")
def cluster_summary(spark, sf):
    e = X.table(spark, sf, "embeddings").select((F.col("label") - 1).alias("cluster_label"))
    return R.cluster_summary(e)


@query("percentile_columns", Q.with_(PM, f"""SELECT pair_id, row_number() OVER (ORDER BY pm.rank_score DESC, pair_id) AS rank,
  {r('row_number() OVER (ORDER BY pm.rank_score DESC, pair_id) * 100.0 / (SELECT count(*) FROM pm)', 'percentile_rank')},
  {r('pm.rank_score * 100.0 / (SELECT max(rank_score) FROM pm)', 'score_percentile')} FROM pm WHERE rank_score IS NOT NULL ORDER BY pm.rank_score DESC, pair_id LIMIT 15"""))
def percentile_columns(spark, sf):
    t = R.top_with_percentiles(X.metrics(spark, sf), 15, "rank_score")
    return rounded(t.select("pair_id", F.col("rank").cast("long").alias("rank"), "percentile_rank", "score_percentile"))


_EXE = """ex AS (SELECT o_orderkey AS execution_id, o_orderpriority AS study, CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  o_orderdate AS started, o_totalprice AS seconds, CAST(o_custkey AS BIGINT) AS records FROM orders),
qu AS (SELECT l_orderkey AS execution_id, CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'WARNING' ELSE 'PASS' END AS result, l_linenumber AS "check" FROM lineitem)"""


def _executions(spark, sf):
    return X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("execution_id"), F.col("o_orderpriority").alias("study"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("o_orderdate").alias("started"), F.col("o_totalprice").alias("seconds"), F.col("o_custkey").alias("records"))


def _quality(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("execution_id"),
        M.map_labels("l_returnflag", {"R": "FAIL", "A": "WARNING", "N": "PASS"}).alias("result"), F.col("l_linenumber").alias("check"))


@query("run_statistics", Q.with_(_EXE, """SELECT ex.execution_id, any_value(study) AS study, any_value(status) AS status, count(result) AS checks,
  count(*) FILTER (result = 'FAIL') AS errors, count(*) FILTER (result = 'WARNING') AS warnings, count(DISTINCT "check") AS distinct_checks
  FROM ex LEFT JOIN qu USING (execution_id) GROUP BY 1"""))
def run_statistics(spark, sf):
    return R.run_statistics(_executions(spark, sf).select("execution_id", "study", "status"), _quality(spark, sf))


@query("recent_performance", Q.with_(_EXE, f"""SELECT study, count(*) AS runs, count(*) FILTER (status = 'SUCCESS') AS successes,
  {r("count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*)", 'success_rate')}, {r('avg(records)', 'avg_records')}
  FROM ex WHERE started >= (SELECT max(started) FROM ex) - INTERVAL 7 DAY GROUP BY 1"""))
def recent_performance(spark, sf):
    e = _executions(spark, sf)
    return rounded(R.recent_performance(e, e.agg(F.max("started")).scalar()))


@query("pipeline_summary", Q.with_(_EXE, f"""SELECT count(*) AS studies, count(*) FILTER (status = 'SUCCESS') AS successful, count(*) FILTER (status <> 'SUCCESS') AS failed,
  {r("count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*)", 'success_rate')}, CAST(sum(records) AS BIGINT) AS total_records,
  {r('sum(records) / sum(seconds)', 'records_per_second')} FROM ex"""))
def pipeline_summary(spark, sf):
    return rounded(R.pipeline_summary(_executions(spark, sf)))


@query("gene_hubs", Q.with_(PM + """,
top AS (SELECT * FROM pm WHERE rank_score >= (SELECT quantile_cont(rank_score, 0.9) FROM pm)),
s AS (SELECT GeneAName AS gene, abs(dz_ss_mean) AS e FROM top UNION ALL SELECT GeneBName, abs(dz_ss_mean) FROM top)""",
    f"SELECT gene, count(*) AS degree, {r('count(*) * avg(e)', 'hub_score')} FROM s GROUP BY 1"))
def gene_hubs(spark, sf):
    return rounded(R.gene_hubs(X.metrics(spark, sf)))


@query("table_statistics", "SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_statistics(spark, sf):
    from rhopool.sources.tables import table_rows
    return table_rows({n: X.table(spark, sf, n) for n in ("orders", "part", "lineitem")})


@query("table_description", """SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(*) AS rows FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(*) FROM orders UNION ALL SELECT 'o_totalprice', 'double', count(*) FROM orders""")
def table_description(spark, sf):
    from rhopool.sources.tables import describe
    return describe(X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")).select("column", "type", "rows")


@query("filtered_fetch", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' ORDER BY o_orderkey LIMIT 40")
def filtered_fetch(spark, sf):
    from rhopool.sources.tables import fetch
    o = fetch(X.table(spark, sf, "orders"), 40, ["o_orderkey"], o_orderstatus="P", o_orderpriority="5-LOW", o_custkey=None)
    return o.select("o_orderkey", "o_totalprice")


@query("whole_column_coercion", """SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS good, CASE WHEN c_custkey % 50 = 3 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS bad FROM customer""")
def whole_column_coercion(spark, sf):
    k = F.col("c_custkey")
    c = X.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), k.cast("string")).alias("good"),
                                              F.when(k % 50 == 3, "x").otherwise(k.cast("string")).alias("bad"))
    return C.coerce_columns(c, ["good", "bad"])


@query("column_aliases", '''SELECT p_name AS GeneAName, p_type AS GeneBName, p_retailprice AS p_ss, p_brand AS brand, p_size AS "dz_ss_se", p_size + 1 AS kappa_ss,
  p_size + 2 AS "rank_score", p_size + 3 AS "Rank-Score" FROM part''')
def column_aliases(spark, sf):
    p = X.table(spark, sf, "part").select(F.col("p_name").alias("Gene A"), F.col("p_type").alias("gene_b_symbol"),
                                          F.col("p_retailprice").alias("P-Value SS"), F.col("p_brand").alias("brand"), F.col("p_size").alias("DZ SS SE"), (F.col("p_size") + 1).alias("Kappa-SS"),
                                          (F.col("p_size") + 2).alias("rank_score"), (F.col("p_size") + 3).alias("Rank-Score"))
    return C.rename_aliases(p)


@query("null_tokens", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def null_tokens(spark, sf):
    k = F.col("c_custkey")
    c = X.table(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, F.when(k % 2 == 0, "N/A").otherwise("nan"))
                                              .otherwise(F.col("c_mktsegment")).alias("segment"))
    return C.null_tokens(c, ["segment"])


@query("study_weights")
def study_weights(spark, sf):
    return rounded(R.study_weights(X.corr_facts(spark, sf)))


@query("orientation_free_pairs", "SELECT p_partkey FROM part WHERE least(p_brand, p_type) = least('Brand#1', 'ECONOMY') AND greatest(p_brand, p_type) = greatest('Brand#1', 'ECONOMY')")
def orientation_free_pairs(spark, sf):
    return X.table(spark, sf, "part").where(C.same_pair("p_brand", "p_type", "ECONOMY", "Brand#1")).select("p_partkey")


@query("chart_tables", Q.with_(Q.CORR + ", b AS (SELECT min(rho_spearman) AS lo, max(rho_spearman) AS hi FROM corr)",
    "SELECT least(CAST(floor((rho_spearman - lo) * 20 / (hi - lo)) AS BIGINT) + 1, 20) AS bin, count(*) AS n FROM corr, b WHERE rho_spearman IS NOT NULL GROUP BY 1"))
def chart_tables(spark, sf):
    return R.chart_tables(X.metrics(spark, sf), X.corr_facts(spark, sf))["rho_histogram"]
