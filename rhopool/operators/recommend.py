"""Ranked recommendations: the scoring path over raw features and the fitted analyzer path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rhopool.functions.features import derived_features, two_condition_features
from rhopool.operators import rules as RU
from rhopool.operators.clean import same_pair
from rhopool.operators.consensus import consensus, consensus_summary, ml_score
from rhopool.operators.density import dbscan
from rhopool.operators.forest import IsolationForest, flag_outliers
from rhopool.operators.mixture import PrincipalComponents, kmeans_distance, mixture
from rhopool.operators.neighbours import calinski_harabasz, local_outlier_factor, silhouette
from rhopool.operators.points import to_points
from rhopool.operators.scaling import (column_stats, exact_quantiles, fill_median, fill_zero, minmax, num, numeric_columns, select_features,
                                       standard_scale)
from rhopool.operators.scores import baseline_similarity, metrics_score, new_rank_score, unsupervised_score
from rhopool.session import materialize

# The positive control, score weights and confidence levels.
CONTROL_PAIR = ("MS4A4A", "CD86")
WEIGHTS = {"ml_score": 0.35, "rules_score": 0.35, "baseline_similarity": 0.20, "stat_bonus": 0.10}
RULE_SHARE, ML_SHARE, HIGH_LEVEL, OUTLIER_LEVEL = 0.7, 0.3, 0.8, 0.6
DEFAULT_TOP, MAX_TOP = 20, 50


def _top(n: int | None, most: int | None = None) -> int:
    n = n if n and n > 0 else DEFAULT_TOP
    return n if most is None else min(n, most)


def _measures():
    return F.struct(*[F.col(c) for c in ("p_ss", "p_soth", "dz_ss_mean", "dz_soth_mean", "q_ss", "q_soth")])


def _ranked(df: DataFrame, n: int) -> DataFrame:
    """Top n by combined score with a rank; the window sees n rows."""
    top = df.orderBy(F.desc("combined_score"), "pair_id").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("combined_score"), "pair_id")))


def combine_scores(df: DataFrame, strength: str = "combined_effect_size") -> DataFrame:
    """Weighted score and high-confidence flag from ml_score, rules_score, baseline_similarity and the effect strength."""
    d = minmax(df.withColumn("_s", F.abs(strength)), {"_s": "stat_bonus"}, eps=None)
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    high = (F.col("ml_score") > 0.6) & (F.col("rules_score") > 0.5) & (F.col("baseline_similarity") > 0.7)
    return d.withColumns({"combined_score": score, "is_high_confidence": F.coalesce(high, F.lit(False))}).drop("_s")


def ensemble_scores(df: DataFrame, cols: list[str], eps: float = 0.5, seed: int = 42) -> DataFrame:
    """(pair_id, isolation_score, is_outlier, cluster_label, gmm_label, gmm_confidence) on standardised features."""
    scaled = standard_scale(fill_zero(df.select("pair_id", *[F.col(c).cast("double").alias(c) for c in cols]), cols), cols)
    points = materialize(to_points(scaled, cols), "scaled")
    n = points.count()
    iso = flag_outliers(IsolationForest(seed=seed).fit(points).score(points), "auto")
    clusters = dbscan(points, eps, max(5, int(0.005 * n)))
    return (iso.join(clusters.select("id", "cluster_label"), "id").join(mixture(points, seed=seed), "id")
            .withColumnRenamed("id", "pair_id"))


def recommendations(pairs: DataFrame, baseline: tuple[str, str], rules: list[RU.Rule] = RU.PROJECT_RULES,
                    top_n: int | None = None, variant: str = "current") -> tuple[DataFrame, DataFrame]:
    """(recommendations, one-row summary) of the scoring path.

    ``variant="earlier"`` scores without the mixture and takes strength from the effect difference.
    """
    f = two_condition_features(pairs)
    # Nullable inputs stay visible to the rules; the models see zeros.
    scored = materialize(baseline_similarity(f, baseline), "features")
    cols = numeric_columns(scored, ("GeneAKey", "GeneBKey"))
    ens = materialize(ensemble_scores(scored, cols), "ensemble")
    d = ml_score(scored.join(ens, "pair_id"), variant=variant)
    d = RU.apply_rules(d, rules, "weight", explain=True)
    d = materialize(combine_scores(d, "abs_delta_effect_size" if variant == "earlier" else "combined_effect_size"), "scored")
    recs = _ranked(d, _top(top_n)).select(
        "pair_id", F.col("GeneAName").alias("gene_a"), F.col("GeneBName").alias("gene_b"), "rules_score",
        F.col("ml_score").alias("ml_confidence"), "baseline_similarity", "combined_score", "is_high_confidence", "is_outlier",
        "cluster_label", "rank", _measures().alias("statistical_measures"), "rule_explanations")
    found = recs.where(same_pair("gene_a", "gene_b", *baseline)).agg(F.count(F.lit(1)) > 0).scalar()
    summary = d.agg(
        F.count(F.lit(1)).alias("total_pairs"), F.count_if("is_outlier").alias("outliers_detected"),
        F.countDistinct(F.when(F.col("cluster_label") != -1, F.col("cluster_label"))).alias("clusters_found")
    ).withColumn("positive_control_validated", found)
    return recs, summary


class PairAnalyzer:
    """Fit on one pair table, predict on another: features -> scaling -> PCA -> ensemble -> rules."""

    def __init__(self, components: int = 5, contamination: float = 0.1, seed: int = 42,
                 rules: list[RU.Rule] = RU.AGENT_RULES, control: tuple[str, str] = CONTROL_PAIR,
                 rescale: bool = True, min_variance: float | None = None):
        self.components, self.contamination, self.seed = components, contamination, seed
        self.rules, self.control, self.rescale, self.min_variance = rules, control, rescale, min_variance
        self.pca: PrincipalComponents | None = None

    def _scaled(self, df: DataFrame) -> DataFrame:
        """Robust-scaled selected features with the fitted medians and ranges; missing values become 0."""
        have = set(df.columns)
        return df.selectExpr("pair_id", *[
            (f"coalesce((cast(`{c}` as double) - {num(m)}) / {num(s)}, 0D)" if c in have else "0D") + f" as `{c}`"
            for c, (m, s) in self.robust.items()])

    def _points(self, df: DataFrame) -> DataFrame:
        if df is self.fitted[0]:
            return self.fitted[1]
        return self._project(self._scaled(derived_features(df)))

    def _project(self, scaled: DataFrame) -> DataFrame:
        pcs = self.pca.transform(scaled)
        names = list(self.centre)
        if self.rescale:
            pcs = pcs.select("pair_id", *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in self.centre.items()])
        return materialize(to_points(pcs, names), "pcs")

    def fit(self, df: DataFrame) -> "PairAnalyzer":
        feats = materialize(derived_features(df), "derived")
        wide = numeric_columns(feats, ("GeneAKey", "GeneBKey"))
        stats = column_stats(feats, wide)
        cols = select_features(feats, wide, self.min_variance, stats=stats)
        feats = fill_median(feats, cols, stats=stats)
        q = exact_quantiles(feats, cols, [0.25, 0.5, 0.75], stats={c: {"n": stats[c]["rows"]} for c in cols})
        self.robust = {c: (float(q[c][1]), float(q[c][2] - q[c][0]) or 1.0) for c in cols}
        scaled = materialize(self._scaled(feats), "robust")
        self.pca = PrincipalComponents(self.components).fit(scaled, cols)
        pcs = self.pca.transform(scaled.select("pair_id", *cols))
        names = [f"pc_{i + 1}" for i in range(self.pca.components.shape[1])]
        row = pcs.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
        self.centre = {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"]) or 1.0) for c in names}
        points = self._project(scaled)
        self.fitted = (df, points)
        self.forest = IsolationForest(seed=self.seed).fit(points)
        scores = self.forest.score(points)
        self.cut = exact_quantiles(scores, ["isolation_score"], [1.0 - self.contamination])["isolation_score"][0]
        return self

    def ensemble(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(points, labels): labels carry isolation_score, anomaly_label, cluster_label, gmm_label, gmm_confidence."""
        if self.pca is None:
            raise ValueError("fit the analyzer first")
        points = self._points(df)
        iso = self.forest.score(points).withColumn(
            "anomaly_label", F.when(F.col("isolation_score") > F.lit(float(self.cut)), -1).otherwise(1))
        clusters = dbscan(points, 0.3, 5, "cosine").select("id", "cluster_label")
        labels = iso.join(clusters, "id").join(mixture(points, seed=self.seed), "id")
        return points, materialize(labels, "labels")

    def predict(self, df: DataFrame, top_n: int | None = None, min_methods: int = 3) -> tuple[DataFrame, DataFrame]:
        """(recommendations, one-row summary); the described analyzer returns ``MAX_TOP`` rows at most.

        Silhouette and Calinski-Harabasz are -1 unless there is more than one cluster besides noise.
        """
        points, labels = self.ensemble(df)
        flagged = consensus(labels, ["anomaly_label", "cluster_label", "gmm_label"], min_methods)
        d = RU.apply_rules(df, self.rules, "count").join(
            flagged.withColumnRenamed("id", "pair_id").select("pair_id", "is_high_confidence", "anomaly_label"), "pair_id")
        level = (F.when(F.col("is_high_confidence"), F.lit(HIGH_LEVEL))
                 .when(F.col("anomaly_label") == -1, F.lit(OUTLIER_LEVEL)).otherwise(F.lit(0.0)))
        d = d.withColumns({"ml_confidence": level, "is_outlier": F.col("anomaly_label") == -1})
        d = materialize(d.withColumn("combined_score", RULE_SHARE * F.col("rules_score") + ML_SHARE * F.col("ml_confidence")), "scored")
        # The best rule scores are the candidates; the combined score orders them.
        best = d.orderBy(F.desc("rules_score"), "pair_id").limit(_top(top_n, MAX_TOP))
        recs = _ranked(best, _top(top_n, MAX_TOP)).select(
            "pair_id", F.col("GeneAName").alias("gene_a"), F.col("GeneBName").alias("gene_b"), "rules_score", "ml_confidence",
            "combined_score", "is_high_confidence", "is_outlier", "rank", _measures().alias("statistical_measures"))
        control = RU.control_percentile(d, self.control).select("validated").scalar()
        clusters = labels.agg(F.countDistinct(F.when(F.col("cluster_label") != -1, F.col("cluster_label")))).first()[0]
        if clusters > 1:
            quality = {"silhouette_score": silhouette(points, labels).select("silhouette").scalar(),
                       "calinski_harabasz": calinski_harabasz(points, labels).select("calinski_harabasz").scalar()}
        else:
            quality = {"silhouette_score": F.lit(-1.0), "calinski_harabasz": F.lit(-1.0)}
        summary = d.agg(
            F.count(F.lit(1)).alias("total_pairs"), F.count_if("is_outlier").alias("outliers_detected"),
            F.count_if(F.col("p_ss") < 0.05).alias("significant_pairs_ss"), F.count_if(F.col("p_soth") < 0.01).alias("significant_pairs_soth"),
            F.count_if((F.abs("dz_ss_mean") > 0.5) & (F.abs("dz_soth_mean") > 1.0)).alias("large_effect_pairs"))
        summary = summary.withColumns({
            "clusters_found": F.lit(clusters).cast("bigint"), **quality,
            "mean_consensus": consensus_summary(labels, ["anomaly_label", "cluster_label", "gmm_label"]).scalar(),
            "positive_control_validated": control})
        return recs, summary


def unsupervised_ranking(metrics: DataFrame, seed: int = 42) -> DataFrame:
    """Pair metrics with unsupervised_score, metrics_score and their average as new_rank_score."""
    cols = numeric_columns(metrics, ("rank_score",))
    base = materialize(fill_zero(metrics, numeric_columns(metrics)), "filled")
    n = base.count()
    if n < 2:
        scored = base.withColumns({c: F.lit(0.0) for c in ("isolation_score", "lof", "center_distance")})
    else:
        points = materialize(to_points(standard_scale(base.select("pair_id", *cols), cols), cols), "scaled")
        iso = IsolationForest(seed=seed).fit(points).score(points)
        lof = local_outlier_factor(points, min(20, n - 1))
        km = kmeans_distance(points, min(5, n), seed).select("id", "center_distance")
        parts = materialize(iso.join(lof, "id").join(km, "id").withColumnRenamed("id", "pair_id"), "anomaly")
        scored = base.join(parts, "pair_id")
    return new_rank_score(metrics_score(unsupervised_score(scored))).drop("isolation_score", "lof", "center_distance")
