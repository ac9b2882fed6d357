"""Summary tables behind charts, dashboards and run reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.operators.clean import finite_pairs, significance_class
from rhopool.operators.consensus import consensus_distribution
from rhopool.operators.scaling import exact_quantiles, safe_corr, scalars


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are present; one aggregation."""
    pairs = [(a, b) for a in cols for b in cols if a <= b]
    row = df.agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{min(a, b)}|{max(a, b)}").alias("r"))
             for a in cols for b in cols]
    return row.select(F.inline(F.array(*cells)))


def box_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme inside values), outlier count per column."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    parts = []
    for c in cols:
        a, m, b = q[c]
        if m is None:
            continue
        lo, hi = a - 1.5 * (b - a), b + 1.5 * (b - a)
        x = F.col(c)
        inside = (x >= F.lit(float(lo))) & (x <= F.lit(float(hi)))
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"), F.lit(float(a)).alias("q1"), F.lit(float(m)).alias("median"),
            F.lit(float(b)).alias("q3"), F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("outliers")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width counts between the column's minimum and maximum."""
    s = scalars(df, lo=F.min(col), hi=F.max(col))
    b = F.width_bucket(F.col(col).cast("double"), s["lo"].cast("double"), s["hi"].cast("double") , F.lit(bins))
    b = F.when(s["lo"] == s["hi"], F.lit(1)).otherwise(F.least(b, F.lit(bins)))
    return df.where(F.col(col).isNotNull()).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scatter_rows(df: DataFrame) -> DataFrame:
    """Finite effect pairs with their significance class."""
    return finite_pairs(df).select("pair_id", "GeneAName", "GeneBName", "dz_ss_mean", "dz_soth_mean", "p_ss", "p_soth",
                                   significance_class().alias("significance"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("size"))


def label_sizes(df: DataFrame, labels: list[str]) -> DataFrame:
    """(method, label, size) of several labelings in one pass; a row without a label isn't counted."""
    return (df.unpivot([], [F.col(c).cast("long").alias(c) for c in labels], "method", "label").where("label is not null")
            .groupBy("method", "label").agg(F.count(F.lit(1)).alias("size")))


def ranking_rows(recs: DataFrame, n: int = 20) -> DataFrame:
    """The first n recommendations by rank with what a ranking chart shows."""
    return recs.orderBy("rank").limit(n).select(
        "rank", F.concat_ws("-", "gene_a", "gene_b").alias("pair"), "combined_score", "rules_score", "ml_confidence")


def cluster_summary(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    lab = F.col(label)
    return df.agg(F.countDistinct(F.when(lab != -1, lab)).alias("n_clusters"), F.count_if(lab == -1).alias("n_noise"))


def recommendation_metrics(recs: DataFrame) -> DataFrame:
    return recs.agg(
        F.count(F.lit(1)).alias("total_recommendations"), F.count_if("is_high_confidence").alias("high_confidence_pairs"),
        F.count_if("is_outlier").alias("outlier_pairs"), F.avg("combined_score").alias("avg_combined_score"),
        F.avg("rules_score").alias("avg_rules_score"), F.avg("ml_confidence").alias("avg_ml_confidence"))


def top_with_percentiles(recs: DataFrame, n: int = 20, score: str = "combined_score") -> DataFrame:
    """Best n rows with rank, rank percentage of all rows and score percentage of the best score."""
    s = scalars(recs, total=F.count(F.lit(1)), best=F.max(score))
    top = recs.orderBy(F.desc(score), "pair_id").limit(n)
    top = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), "pair_id")))
    return top.withColumns({
        "percentile_rank": S.div(F.col("rank"), s["total"]) * 100.0,
        "score_percentile": S.div(F.col(score), s["best"]) * 100.0})


# The names of the exported columns.
def flat_recommendations(recs: DataFrame) -> DataFrame:
    m = "statistical_measures."
    return recs.select(
        F.col("rank").alias("Rank"), F.col("gene_a").alias("Gene_A"), F.col("gene_b").alias("Gene_B"),
        F.col("combined_score").alias("Combined_Score"), F.col("rules_score").alias("Rules_Score"),
        F.col("ml_confidence").alias("ML_Confidence"), F.col("is_high_confidence").alias("High_Confidence"),
        F.col("is_outlier").alias("Outlier"), F.col(m + "p_ss").alias("P_Value_SS"), F.col(m + "p_soth").alias("P_Value_SOTH"),
        F.col(m + "dz_ss_mean").alias("Effect_Size_SS"), F.col(m + "dz_soth_mean").alias("Effect_Size_SOTH"))


# The limits of the checks.
def result_checks(summary: DataFrame, n_recommendations: DataFrame) -> DataFrame:
    """Dashboard validation of a one-row summary(total_pairs, outliers_detected, silhouette_score,
    positive_control_validated) and a one-row (n) recommendation count."""
    s = summary.withColumn("recommendations", n_recommendations.select("n").scalar())
    rate = F.coalesce(S.div("outliers_detected", "total_pairs"), F.lit(0.0))
    sil = F.coalesce("silhouette_score", F.lit(-1.0))
    valid = F.coalesce("positive_control_validated", F.lit(False))
    return s.select(
        F.when(F.col("recommendations") == 0, "FAILED").when(~valid, "WARNING").otherwise("PASSED").alias("overall_status"),
        (F.col("recommendations") == 0).alias("no_recommendations"), (~valid).alias("control_failed"),
        F.when(rate > 0.3, "high").when(rate < 0.01, "very low").otherwise("normal").alias("outlier_rate_class"),
        rate.alias("outlier_rate"),
        F.when(sil < 0, "none").when(sil < 0.3, "low").when(sil > 0.7, "good").otherwise("fair").alias("clustering_class"),
        F.col("recommendations").cast("long").alias("recommendations_count"))


# --- study and gene summaries ---------------------------------------------------

def study_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("study_key", "condition").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("n_samples").alias("avg_samples"),
        F.min("n_samples").alias("min_samples"), F.max("n_samples").alias("max_samples"))


def gene_list(facts: DataFrame) -> DataFrame:
    return (facts.select(F.col("gene_a_name").alias("gene")).union(facts.select("gene_b_name"))
            .distinct().orderBy("gene"))


def gene_statistics(facts: DataFrame, gene: str | None = None) -> DataFrame:
    """Per gene (either side) and condition: rows, mean rho, mean p, significant rows."""
    if gene is not None:
        facts = facts.where((F.col("gene_a_name") == gene) | (F.col("gene_b_name") == gene))
    sides = facts.withColumn("gene", F.explode(F.array("gene_a_name", "gene_b_name")))
    if gene is not None:
        sides = sides.where(F.col("gene") == gene)
    return sides.groupBy("gene", "condition").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("rho_spearman").alias("avg_rho"), F.avg("p_value").alias("avg_p"),
        F.count_if(F.col("p_value") < 0.05).alias("significant"))


def rho_distribution(facts: DataFrame, limit: int | None = None, **equals) -> DataFrame:
    """Facts filtered by equality and ordered by rho (equal to 12 digits counts as equal); an optional positive limit."""
    for c, v in equals.items():
        facts = facts.where(F.col(c) == v)
    out = facts.where("rho_spearman is not null").orderBy(
        F.round("rho_spearman", 12), "gene_a_key", "gene_b_key", "study_key", "condition")
    return out.limit(limit) if limit and limit > 0 else out


def pair_samples(expression: DataFrame, a: int, b: int) -> DataFrame:
    """Both genes' values per sample; one aggregation over the two genes' rows."""
    side = lambda g: F.max(F.when(F.col("gene_key") == g, F.col("value")))
    return (expression.where(F.col("gene_key").isin(a, b)).groupBy("study_key", "sample", "condition")
            .agg(side(a).alias("expr_a"), side(b).alias("expr_b")))


def pair_values(facts: DataFrame, samples: DataFrame, a: int, b: int) -> DataFrame:
    """Both genes' values for each sample that the sample dimension knows, with its study and classification.

    The two genes' facts are aggregated by sample first, so one row for each sample meets the dimension.
    """
    side = lambda g: F.max(F.when(F.col("gene_key") == g, F.col("expression_value")))
    own = facts.where(F.col("gene_key").isin(a, b)).groupBy("sample_key").agg(side(a).alias("expr_a"), side(b).alias("expr_b"))
    return own.join(samples.select("sample_key", "study", "sample_classification"), "sample_key").select(
        "study", "sample_key", "sample_classification", "expr_a", "expr_b")


# --- run statistics -----------------------------------------------------------

def run_statistics(executions: DataFrame, quality: DataFrame) -> DataFrame:
    """Per execution: quality checks, errors, warnings; executions without quality rows stay."""
    q = quality.groupBy("execution_id").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("result") == "FAIL").alias("errors"),
        F.count_if(F.col("result") == "WARNING").alias("warnings"), F.countDistinct("check").alias("distinct_checks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = ("checks", "errors", "warnings", "distinct_checks")
    own = executions.drop(*counts)
    return own.join(q, "execution_id", "left").select(*own.columns, *[zero(c) for c in counts])


def recent_performance(executions: DataFrame, now, days: int = 7) -> DataFrame:
    """Executions of the last days: counts, success share and average records per study."""
    e = executions.where(F.col("started") >= now - F.make_dt_interval(days=F.lit(days)))
    return e.groupBy("study").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "SUCCESS").alias("successes"),
        (S.div(F.count_if(F.col("status") == "SUCCESS"), F.count(F.lit(1))) * 100.0).alias("success_rate"),
        F.avg("records").alias("avg_records"))


def pipeline_summary(executions: DataFrame) -> DataFrame:
    ok = F.col("status") == "SUCCESS"
    return executions.agg(
        F.count(F.lit(1)).alias("studies"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        (S.div(F.count_if(ok), F.count(F.lit(1))) * 100.0).alias("success_rate"), F.sum("records").alias("total_records"),
        S.div(F.sum("records"), F.sum("seconds")).alias("records_per_second"))


# --- agreement and network summaries ----------------------------------------------

def gene_hubs(m: DataFrame, top_share: float = 0.1, score: str = "rank_score") -> DataFrame:
    """Degree of a gene among the top share of pairs, and degree times mean absolute effect."""
    cut = exact_quantiles(m, [score], [1.0 - top_share])[score][0]
    top = m.where(F.col(score) >= F.lit(float(cut)))
    return (top.select(F.explode(F.array("GeneAName", "GeneBName")).alias("gene"), F.abs("dz_ss_mean").alias("e"))
            .groupBy("gene").agg(F.count(F.lit(1)).alias("degree"), (F.count(F.lit(1)) * F.avg("e")).alias("hub_score")))


def study_weights(facts: DataFrame, penalty: float = 10.0) -> DataFrame:
    """Share of marginal p-values in [0.04, 0.06] and a size-based reliability weight per study."""
    per = facts.groupBy("study_key").agg(
        F.avg("n_samples").alias("n"), S.div(F.count_if(F.col("p_value").between(0.04, 0.06)),
                                             F.count("p_value")).alias("marginal_share"))
    med = exact_quantiles(per, ["n"], [0.5])["n"][0]
    eff = F.col("n") * F.least(F.lit(1.0), S.div("n", F.lit(float(med or 1.0)))) * (1.0 - F.coalesce("marginal_share", F.lit(0.0)))
    return per.select("study_key", "marginal_share", eff.alias("effective_n"),
                      S.div(eff, eff + F.lit(penalty)).alias("study_weight"))


def _beside(row: DataFrame, other: DataFrame) -> DataFrame:
    """A one-row frame with the columns of another one-row frame."""
    both = other.select(F.struct(*other.columns).alias("s")).scalar()
    return row.withColumn("_s", both).select(*row.columns, *[F.col(f"_s.{c}").alias(c) for c in other.columns if c not in row.columns])


METHODS = ["anomaly_label", "cluster_label", "gmm_label"]


def report_tables(m: DataFrame, recs: DataFrame, summary: DataFrame, session: str, charts: dict[str, DataFrame] | None = None,
                  top_n: int = 20) -> dict[str, DataFrame]:
    """What a report of one analysis holds, by name: metadata, summary, top recommendations, export records and columns, charts.

    ``summary`` has one row. A ``top_n`` that isn't positive means 20. Charts are named chart_<name>; every table is one
    aggregation or projection of its input, and nothing is gathered.
    """
    top_n = top_n if top_n > 0 else 20
    metadata = recs.agg(F.count(F.lit(1)).alias("n_recommendations")).select(
        F.lit(session).alias("session_id"), F.current_timestamp().alias("created_at"),
        m.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_pairs"), "n_recommendations", F.lit(top_n).alias("top_n"))
    columns = m.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(m.schema)],
                                             "position int, column string, type string")
    return {"metadata": metadata, "summary": _beside(summary, recommendation_metrics(recs)),
            "top_recommendations": top_with_percentiles(recs.drop("rank"), top_n), "export_records": flat_recommendations(recs),
            "export_columns": columns, **{f"chart_{name}": t for name, t in (charts or {}).items()}}


def chart_tables(m: DataFrame, facts: DataFrame, labels: DataFrame | None = None, recs: DataFrame | None = None,
                 loadings: DataFrame | None = None, top_n: int = 20) -> dict[str, DataFrame]:
    """The data behind every chart, keyed by chart.

    ``labels`` (the methods' labels of each pair) adds cluster sizes and the distribution of agreement, ``recs`` the
    ranking, ``loadings`` (feature, component, loading) the features by their weight on the first component.
    """
    more = {}
    if labels is not None:
        more = {"cluster_sizes": label_sizes(labels, METHODS), "agreement": consensus_distribution(labels, METHODS)}
    if recs is not None:
        more["ranking"] = ranking_rows(recs, top_n)
    if loadings is not None:
        more["loadings"] = loadings.where("component = 1").select("feature", F.abs("loading").alias("importance")).orderBy(F.desc("importance"), "feature")
    effects = ["dz_ss_mean", "dz_soth_mean"]
    return {"effect_boxes": box_summary(m, effects), "effect_scatter": scatter_rows(m),
            "rho_boxes": reduce(DataFrame.unionByName, [
                box_summary(facts.where(F.col("condition") == c).select(F.col("rho_spearman").alias(c)), [c])
                for c in ("control", "sepsis", "septic shock")]),
            "rho_histogram": histogram(facts, "rho_spearman"),
            "correlations": correlation_matrix(m, effects + ["p_ss", "p_soth", "kappa_ss", "kappa_soth"]), **more}
