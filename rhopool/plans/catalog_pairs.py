"""Queries of the correlation and pooling layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.operators import meta as M
from rhopool.operators import reports as R
from rhopool.operators.fdr import adjust
from rhopool.operators.spearman import gene_directions, pair_correlations, with_study_q
from rhopool.plans import fixtures as X
from rhopool.plans import sqltext as Q
from rhopool.plans.registry import query, r, rounded, rs

_KEYS = "gene_a_key, gene_b_key, study_key, condition"


@query("spearman_pairs", Q.with_(Q.CORR, f"SELECT {_KEYS}, {r('rho_spearman')}, n_samples FROM corr"))
def spearman_pairs(spark, sf):
    out = pair_correlations(X.expression_long(spark, sf))
    return rounded(out.select("gene_a_key", "gene_b_key", "study_key", "condition", "rho_spearman", "n_samples"))


@query("spearman_study_q")
def spearman_study_q(spark, sf):
    return rounded(with_study_q(X.corr_facts(spark, sf)).select(
        "gene_a_key", "gene_b_key", "study_key", "condition", "p_value", "q_value"))


@query("gene_direction", Q.with_(Q.CORR, f"SELECT gene_key, gene, {r('xcase', 'expr_case')}, {r('xctrl', 'expr_ctrl')}, d AS direction FROM dir"))
def gene_direction(spark, sf):
    return rounded(gene_directions(X.expression_long(spark, sf)))


@query("corr_scan", Q.with_(Q.CORR, f"SELECT {_KEYS}, pair_id, {r('rho_spearman')} FROM corr WHERE gene_a_direction <> gene_b_direction"))
def corr_scan(spark, sf):
    f = M.opposite_directions(X.corr_facts(spark, sf)).withColumn("pair_id", M.pair_id())
    return rounded(f.select("gene_a_key", "gene_b_key", "study_key", "condition", "pair_id", "rho_spearman"))


@query("corr_scan_all", Q.with_(Q.CORR, f"SELECT {_KEYS}, pair_id, {r('rho_spearman')} FROM corr"))
def corr_scan_all(spark, sf):
    f = X.corr_facts(spark, sf).withColumn("pair_id", M.pair_id())
    return rounded(f.select("gene_a_key", "gene_b_key", "study_key", "condition", "pair_id", "rho_spearman"))


@query("label_map", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'septic shock' WHEN 'O' THEN 'control' END AS label
FROM orders""")
def label_map(spark, sf):
    return X.table(spark, sf, "orders").select(
        "o_orderkey", M.map_labels("o_orderstatus", {"F": "septic_shock", "O": "control"}).alias("label"))


@query("fisher_z", Q.with_(Q.ZROWS, f"SELECT {_KEYS}, {r('z')}, ne AS n_eff FROM zr"))
def fisher_z(spark, sf):
    return rounded(M.label_rows(X.corr_facts(spark, sf)).select(
        "gene_a_key", "gene_b_key", "study_key", "condition", "z", "n_eff"))


_PS = "pair_id, study_key, " + rs("dz_ss", "se_ss", "dz_soth", "se_soth")


@query("study_contrasts", Q.with_(Q.contrasts(), f"SELECT {_PS} FROM ps"))
def study_contrasts(spark, sf):
    c = M.study_contrasts(M.label_rows(X.corr_facts(spark, sf)))
    return rounded(c.select("pair_id", "study_key", "dz_ss", "se_ss", "dz_soth", "se_soth"))


@query("study_contrasts_zero_fill", Q.with_(Q.contrasts("zero"), f"SELECT {_PS} FROM ps"))
def study_contrasts_zero(spark, sf):
    c = M.study_contrasts(M.label_rows(X.corr_facts(spark, sf)), missing="zero")
    return rounded(c.select("pair_id", "study_key", "dz_ss", "se_ss", "dz_soth", "se_soth"))


@query("pivot_first", Q.with_(Q.contrasts(), "SELECT pair_id, study_key, " + rs("z_shock", "z_sepsis", "z_control", "ne_shock", "ne_sepsis", "ne_control") + " FROM ps"))
def pivot_first(spark, sf):
    c = M.study_contrasts(M.label_rows(X.corr_facts(spark, sf)))
    return rounded(c.select("pair_id", "study_key", "z_shock", "z_sepsis", "z_control", "ne_shock", "ne_sepsis", "ne_control"))


_RE = ["mean", "se", "ci_low", "ci_high", "Q", "I2", "tau2", "z", "p", "kappa"]


@query("random_effects", Q.with_(Q.pooled(), f"SELECT pair_id, series, k, {', '.join(r(c.lower(), c) for c in _RE)} FROM re"))
def random_effects(spark, sf):
    c = M.study_contrasts(M.label_rows(X.corr_facts(spark, sf)))
    dl = M.random_effects(M.study_series(c), ["pair_id", "series"], "x", "se")
    return rounded(dl.withColumn("kappa", M.sign_agreement()).select("pair_id", "series", "k", *_RE))


_NUMERIC = [c for c in M.METRIC_COLUMNS if c not in ("pair_id", "GeneAName", "GeneBName", "GeneAKey", "GeneBKey",
                                                     "n_studies_ss", "n_studies_soth", "total_samples",
                                                     "control_n_samples", "sepsis_n_samples", "septic_shock_n_samples")]
_EXACT = [c for c in M.METRIC_COLUMNS if c not in _NUMERIC]
_PM = f"SELECT {', '.join(_EXACT)}, {rs(*_NUMERIC)} FROM pm"


@query("pair_metrics", Q.with_(Q.metrics(), _PM))
def pair_metrics(spark, sf):
    return rounded(X.metrics(spark, sf))


@query("pair_metrics_zero_fill", Q.with_(Q.metrics("zero", "reference"), _PM))
def pair_metrics_zero(spark, sf):
    return rounded(M.pair_metrics(X.corr_facts(spark, sf), missing="zero", fdr="reference"))


@query("pair_metrics_opposite_directions", Q.with_(
    Q.metrics().replace("FROM rho JOIN dir a ON a.gene_key = ka JOIN dir b ON b.gene_key = kb)",
                        "FROM rho JOIN dir a ON a.gene_key = ka JOIN dir b ON b.gene_key = kb WHERE a.d <> b.d)"),
    f"SELECT pair_id, {rs('dz_ss_mean', 'p_ss', 'q_ss', 'rank_score')} FROM pm"))
def pair_metrics_opposite(spark, sf):
    m = M.pair_metrics(M.opposite_directions(X.corr_facts(spark, sf)))
    return rounded(m.select("pair_id", "dz_ss_mean", "p_ss", "q_ss", "rank_score"))


@query("top_pairs", Q.with_(Q.metrics(), f"SELECT pair_id, {r('rank_score')} FROM pm ORDER BY pm.rank_score DESC NULLS LAST, pair_id LIMIT 20"))
def top_pairs(spark, sf):
    return rounded(X.metrics(spark, sf).orderBy(F.desc_nulls_last("rank_score"), "pair_id").limit(20)
                   .select("pair_id", "rank_score"))


@query("ranked_pairs", Q.with_(Q.metrics(), f"SELECT pair_id, {r('rank_score')} FROM pm"))
def ranked_pairs(spark, sf):
    return rounded(X.metrics(spark, sf).orderBy(F.desc_nulls_last("rank_score"), "pair_id").select("pair_id", "rank_score"))


_FDR_IN = "src AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_tax > 0.07 THEN NULL ELSE (l_extendedprice * (l_discount + 0.001)) / 20000.0 END AS p FROM lineitem)"


def _fdr_in(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.when(F.col("l_tax") <= 0.07, F.col("l_extendedprice") * (F.col("l_discount") + 0.001) / F.lit(20000.0)).alias("p"))


for _mode in ("standard", "reference"):
    def _fdr(spark, sf, mode=_mode):
        return rounded(adjust(_fdr_in(spark, sf), "p", "q", mode=mode).select("l_orderkey", "l_linenumber", "q"))
    query(f"fdr_{_mode}", Q.with_(_FDR_IN + f", a AS ({Q.bh('src', 'p', 'q', _mode)})",
                                  f"SELECT l_orderkey, l_linenumber, {r('q')} FROM a"))(_fdr)


@query("fdr_by_group", Q.with_(_FDR_IN + f", a AS ({Q.bh('src', 'p', 'q', keys='l_returnflag')})",
                               f"SELECT l_orderkey, l_linenumber, {r('q')} FROM a"))
def fdr_by_group(spark, sf):
    return rounded(adjust(_fdr_in(spark, sf), "p", "q", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "q"))


# --- the simple variant -----------------------------------------------------------

_SIMPLE = Q.ZROWS + f""",
p1 AS (SELECT pair_id, study_key, max(z) FILTER (condition = 'septic shock') AS sh, max(z) FILTER (condition = 'sepsis') AS se,
              max(z) FILTER (condition = 'control') AS co FROM zr GROUP BY 1, 2),
p2 AS (SELECT *, sh - se AS d1, sh - CASE WHEN co IS NULL THEN se WHEN se IS NULL THEN co ELSE (co + se) / 2 END AS d2 FROM p1),
oth AS (SELECT pair_id, co AS v FROM p1 UNION ALL SELECT pair_id, se FROM p1),
om AS (SELECT pair_id, count(v) AS n, avg(v) AS m, var_samp(v) AS s2 FROM oth GROUP BY 1),
ag AS (SELECT pair_id, count(DISTINCT study_key) AS n_studies, avg(d1) AS mean_dz_ss, avg(d2) AS mean_dz_sothers,
              count(d1) AS k1, count(d2) AS k2, stddev_samp(d1) AS sd1, stddev_samp(d2) AS sd2,
              count(sh) AS nh, avg(sh) AS mh, CASE WHEN count(sh) > 1 THEN var_samp(sh) END AS vh,
              count(se) AS ns, avg(se) AS ms, CASE WHEN count(se) > 1 THEN var_samp(se) END AS vs FROM p2 GROUP BY 1),
sg AS (SELECT p2.pair_id, avg(CASE WHEN d1 IS NOT NULL AND abs(mean_dz_ss) > 1e-12 THEN CASE WHEN sign(round(d1, 12)) = sign(round(mean_dz_ss, 12)) THEN 1.0 ELSE 0.0 END END) AS kappa_ss,
              avg(CASE WHEN d2 IS NOT NULL AND abs(mean_dz_sothers) > 1e-12 THEN CASE WHEN sign(round(d2, 12)) = sign(round(mean_dz_sothers, 12)) THEN 1.0 ELSE 0.0 END END) AS kappa_sothers
       FROM p2 JOIN ag USING (pair_id) GROUP BY 1),
sm AS (SELECT ag.*, kappa_ss, kappa_sothers, om.n AS no, om.m AS mo, CASE WHEN om.n > 1 THEN om.s2 END AS vo,
              CASE WHEN nh >= 2 AND ns >= 2 THEN (mh - ms) / nullif(sqrt(vh / nh + vs / ns), 0) END AS t_ss,
              CASE WHEN nh >= 2 AND ns >= 2 THEN power(vh / nh + vs / ns, 2) / nullif(power(vh / nh, 2) / (nh - 1) + power(vs / ns, 2) / (ns - 1), 0) END AS df_ss,
              CASE WHEN nh >= 2 AND om.n >= 2 THEN (mh - om.m) / nullif(sqrt(vh / nh + om.s2 / om.n), 0) END AS t_sothers,
              CASE WHEN nh >= 2 AND om.n >= 2 THEN power(vh / nh + om.s2 / om.n, 2) / nullif(power(vh / nh, 2) / (nh - 1) + power(om.s2 / om.n, 2) / (om.n - 1), 0) END AS df_sothers,
              CASE WHEN k1 >= 2 AND sd1 > 0 THEN mean_dz_ss - {S.Z_975} * sd1 / sqrt(k1) * sqrt(2.0 / k1) END AS low0
       FROM ag JOIN om USING (pair_id) JOIN sg USING (pair_id))"""


@query("simple_pair_metrics", Q.with_(_SIMPLE, "SELECT pair_id, n_studies, " + rs(
    "mean_dz_ss", "mean_dz_sothers", "t_ss", "df_ss", "t_sothers", "df_sothers", "kappa_ss", "kappa_sothers") + " FROM sm"))
def simple_pair_metrics(spark, sf):
    m = M.simple_pair_metrics(X.corr_facts(spark, sf), with_p=False)
    return rounded(m.select("pair_id", "n_studies", "mean_dz_ss", "mean_dz_sothers", "t_ss", "df_ss", "t_sothers",
                            "df_sothers", "kappa_ss", "kappa_sothers"))


def _simple_effects(c: str, k: str, sd: str, mu: str, dev: str) -> str:
    """One contrast's Q, I2 and interval from the deviations themselves; missing below two effects or without spread."""
    ok, v = f"{k} >= 2 AND {sd} > 0", f"({sd} * {sd} / {k})"
    q = f"({dev} / {v})"
    half = f"{S.Z_975} * sqrt(({v} + greatest(0, ({q} - ({k} - 1)) / (({k} - 1) / {v}))) / {k})"
    parts = {"Q": q, "I2": f"greatest(0, ({q} - ({k} - 1)) / {q}) * 100", "ci_low": f"{mu} - {half}", "ci_high": f"{mu} + {half}"}
    return ", ".join(r(f"CASE WHEN {ok} THEN {e} END", f"dz_{c}_{n}") for n, e in parts.items())


@query("simple_random_effects", Q.with_(_SIMPLE + """,
dl AS (SELECT p2.pair_id, k1, k2, sd1, sd2, mean_dz_ss, mean_dz_sothers, sum(power(d1 - mean_dz_ss, 2)) AS dev1, sum(power(d2 - mean_dz_sothers, 2)) AS dev2
       FROM p2 JOIN ag USING (pair_id) GROUP BY ALL)""",
    f"SELECT pair_id, {_simple_effects('ss', 'k1', 'sd1', 'mean_dz_ss', 'dev1')}, {_simple_effects('sothers', 'k2', 'sd2', 'mean_dz_sothers', 'dev2')} FROM dl"))
def simple_random_effects(spark, sf):
    """Both contrasts of all pairs."""
    m = M.simple_pair_metrics(X.corr_facts(spark, sf), with_p=False)
    return rounded(m.select("pair_id", *[f"dz_{c}_{s}" for c in ("ss", "sothers") for s in ("Q", "I2", "ci_low", "ci_high")]))


@query("simple_ranked")
def simple_ranked(spark, sf):
    m = M.simple_pair_metrics(X.corr_facts(spark, sf))
    m = m.withColumns({"pass_gates": M.pass_gates(), "score": M.composite_score(m.columns)})
    return rounded(m.orderBy(F.desc_nulls_last("score"), "pair_id"))


@query("gate_filter", Q.with_(Q.metrics(), """SELECT pair_id, coalesce(q_ss <= 0.9 AND q_soth <= 0.9 AND abs_dz_ss >= 0.05
  AND abs_dz_soth >= 0.05 AND kappa_ss >= 0.6 AND kappa_soth >= 0.6, false) AS pass_gates FROM pm"""))
def gate_filter(spark, sf):
    th = {"q_max": 0.9, "abs_dz_min": 0.05, "kappa_min": 0.6}
    return X.metrics(spark, sf).select("pair_id", M.pass_gates(th, "soth").alias("pass_gates"))


@query("composite_score", Q.with_(Q.metrics(), f"""SELECT pair_id, {r('abs_dz_ss * log10(1 / CASE WHEN q_ss IS NOT NULL THEN greatest(q_ss, 1e-300) END + 1) * coalesce(kappa_ss, 0) * sqrt(0.5)', 'score')}
  FROM pm"""))
def composite_score(spark, sf):
    m = X.metrics(spark, sf)
    return rounded(m.select("pair_id", M.composite_score(m.columns).alias("score")))


@query("pair_names", Q.with_(Q.CORR, """SELECT pair_id, min(gene_a_name) AS gene_a_name, min(gene_b_name) AS gene_b_name,
  CAST(sum(n_samples) FILTER (condition = 'control') AS BIGINT) AS control_n FROM corr GROUP BY pair_id"""))
def pair_names(spark, sf):
    pf = M.pair_facts(M.label_rows(X.corr_facts(spark, sf)))
    return pf.select("pair_id", "gene_a_name", "gene_b_name",
                                                     F.col("control_n_samples").cast("long").alias("control_n"))


@query("pair_samples", Q.with_(Q.EXPR, f"""SELECT study_key, sample, condition, {r('max(value) FILTER (gene_key = 1)', 'expr_a')},
  {r('max(value) FILTER (gene_key = 2)', 'expr_b')} FROM expr WHERE gene_key IN (1, 2) GROUP BY 1, 2, 3"""))
def pair_samples(spark, sf):
    return rounded(R.pair_samples(X.expression_long(spark, sf), 1, 2))


@query("study_summary", Q.with_(Q.CORR, f"""SELECT study_key, condition, count(*) AS pairs, {r('avg(n_samples)', 'avg_samples')},
  min(n_samples) AS min_samples, max(n_samples) AS max_samples FROM corr GROUP BY 1, 2"""))
def study_summary(spark, sf):
    return rounded(R.study_summary(X.corr_facts(spark, sf)))


@query("study_counts", Q.with_(Q.contrasts(), """SELECT pair_id, count(DISTINCT study_key) AS n_studies,
  count(DISTINCT CASE WHEN dz_ss IS NOT NULL THEN study_key END) AS n_studies_ss FROM ps GROUP BY 1"""))
def study_counts(spark, sf):
    c = M.study_contrasts(M.label_rows(X.corr_facts(spark, sf)))
    return c.groupBy("pair_id").agg(F.countDistinct("study_key").alias("n_studies"),
                                    F.countDistinct(F.when(F.col("dz_ss").isNotNull(), F.col("study_key"))).alias("n_studies_ss"))


@query("gene_list", Q.with_(Q.CORR, "SELECT gene_a_name AS gene FROM corr UNION SELECT gene_b_name FROM corr"))
def gene_list(spark, sf):
    return R.gene_list(X.corr_facts(spark, sf))


@query("gene_statistics", Q.with_(Q.CORR + """,
sides AS (SELECT gene_a_name AS gene, condition, rho_spearman FROM corr UNION ALL SELECT gene_b_name, condition, rho_spearman FROM corr)""",
    f"SELECT gene, condition, count(*) AS n_pairs, {r('avg(rho_spearman)', 'avg_rho')} FROM sides GROUP BY 1, 2"))
def gene_statistics(spark, sf):
    return rounded(R.gene_statistics(X.corr_facts(spark, sf)).select("gene", "condition", "n_pairs", "avg_rho"))


@query("rho_distribution", Q.with_(Q.CORR, f"""SELECT pair_id, study_key, {r('rho_spearman')} FROM corr
  WHERE condition = 'sepsis' AND rho_spearman IS NOT NULL ORDER BY round(corr.rho_spearman, 12), gene_a_key, gene_b_key, study_key LIMIT 25"""))
def rho_distribution(spark, sf):
    d = R.rho_distribution(X.corr_facts(spark, sf), 25, condition="sepsis").withColumn("pair_id", M.pair_id())
    return rounded(d.select("pair_id", "study_key", "rho_spearman"))


@query("pair_fetch", Q.with_(Q.CORR, f"""SELECT {_KEYS}, {r('rho_spearman')} FROM corr
  WHERE least(gene_a_name, gene_b_name) = 'Brand#11' AND greatest(gene_a_name, gene_b_name) = 'Brand#2'"""))
def pair_fetch(spark, sf):
    from rhopool.operators.clean import same_pair
    f = X.corr_facts(spark, sf).where(same_pair("gene_a_name", "gene_b_name", "Brand#2", "Brand#11"))
    return rounded(f.select("gene_a_key", "gene_b_key", "study_key", "condition", "rho_spearman"))


@query("pair_batch_fetch", Q.with_(Q.CORR, f"""SELECT {_KEYS}, {r('rho_spearman')} FROM corr
  WHERE (gene_a_key, gene_b_key) IN (VALUES (1, 2), (3, 7), (4, 20))"""))
def pair_batch_fetch(spark, sf):
    from rhopool.sources.tables import fetch_pairs
    f = fetch_pairs(X.corr_facts(spark, sf), spark.createDataFrame([(1, 2), (7, 3), (4, 20)], "x long, y long"))
    return rounded(f.select("gene_a_key", "gene_b_key", "study_key", "condition", "rho_spearman"))


@query("parameterised_query", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 GROUP BY 1""")
def parameterised_query(spark, sf):
    return spark.sql("""SELECT o_orderpriority, count(*) AS n FROM {orders}
                        WHERE o_orderstatus = :status AND o_totalprice > :floor GROUP BY 1""",
                     args={"status": "F", "floor": 50000}, orders=X.table(spark, sf, "orders"))
