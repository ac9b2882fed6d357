"""Queries of the anomaly, clustering, scoring and recommendation operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rhopool.operators import consensus as CO
from rhopool.operators import density as D
from rhopool.operators import forest as FO
from rhopool.operators import mixture as MX
from rhopool.operators import neighbours as N
from rhopool.operators import recommend as RC
from rhopool.operators import ranking as RK
from rhopool.operators import reports as R
from rhopool.operators.points import to_points
from rhopool.operators.scaling import fill_zero, numeric_columns, standard_scale
from rhopool.operators.scores import unsupervised_score
from rhopool.plans import fixtures as X
from rhopool.plans import sqltext as Q
from rhopool.plans.registry import query, r, rounded
from rhopool.session import materialize, materialize_once


def embedding_points(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def metric_points(spark, sf):
    def make():
        m = X.metrics(spark, sf)
        cols = numeric_columns(m, ("rank_score", "GeneAKey", "GeneBKey"))
        return to_points(standard_scale(fill_zero(m.select("pair_id", *cols), cols), cols), cols)
    return materialize_once(spark, (sf,), "metric_points", make)


# The same points and squared distances in SQL; only for small whole tables.
_EMB = """pt AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
un AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM pt)"""
_NEAR_EPS = 0.3


@query("isolation_scores")
def isolation_scores(spark, sf):
    p = embedding_points(spark, sf)
    return rounded(FO.flag_outliers(FO.IsolationForest().fit(p).score(p), 0.1))


@query("local_outlier_factor", Q.with_(_EMB + """,
pr AS (SELECT a.id AS p, b.id AS o, list_distance(a.v, b.v) AS d FROM pt a JOIN pt b ON a.id <> b.id),
nn AS (SELECT p, o, d FROM pr QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, o) <= 20),
kd AS (SELECT p, max(d) AS kd FROM nn GROUP BY 1),
lr AS (SELECT nn.p, 1 / (avg(greatest(kd.kd, nn.d)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.p = nn.o GROUP BY 1)""",
    f"SELECT nn.p AS id, {r('avg(o.lrd) / any_value(s.lrd)', 'lof')} FROM nn JOIN lr o ON o.p = nn.o JOIN lr s ON s.p = nn.p GROUP BY nn.p"))
def local_outlier_factor(spark, sf):
    return rounded(N.local_outlier_factor(embedding_points(spark, sf), 20))


def _dbscan_sql(points: str, eps: str, min_samples: int, distance: str = "list_distance(a.v, b.v)") -> str:
    return f"""
nb AS (SELECT a.id AS p, b.id AS o FROM {points} a JOIN {points} b ON {distance} <= {eps}),
core AS (SELECT p FROM nb GROUP BY p HAVING count(*) >= {min_samples}),
ce AS (SELECT p, o FROM nb WHERE p IN (SELECT p FROM core) AND o IN (SELECT p FROM core)),
reach AS (SELECT p, o FROM ce UNION SELECT reach.p, ce.o FROM reach JOIN ce ON reach.o = ce.p),
comp AS (SELECT p, min(o) AS label FROM reach GROUP BY p),
num AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS c FROM (SELECT DISTINCT label FROM comp)),
bord AS (SELECT nb.p, min(label) AS label FROM nb JOIN comp ON comp.p = nb.o WHERE nb.p NOT IN (SELECT p FROM core) GROUP BY nb.p),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM bord)"""


@query("dbscan_cosine", "WITH RECURSIVE " + _EMB + "," + _dbscan_sql("un", f"{math.sqrt(2 * _NEAR_EPS)!r}", 5) + """
SELECT un.id, CAST(coalesce(c, -1) AS INTEGER) AS cluster_label, un.id IN (SELECT p FROM core) AS is_core
FROM un LEFT JOIN lab ON lab.p = un.id LEFT JOIN num USING (label)""")
def dbscan_cosine(spark, sf):
    return D.dbscan(embedding_points(spark, sf), _NEAR_EPS, 5, "cosine")


_EV = "ev AS (SELECT CAST(p_partkey AS VARCHAR) AS id, [p_size / 10.0, p_retailprice / 20.0] AS v FROM part)"


@query("dbscan_euclidean", "WITH RECURSIVE " + _EV + "," + _dbscan_sql("ev", "0.5", 8) + """
SELECT ev.id, CAST(coalesce(c, -1) AS INTEGER) AS cluster_label, ev.id IN (SELECT p FROM core) AS is_core
FROM ev LEFT JOIN lab ON lab.p = ev.id LEFT JOIN num USING (label)""")
def dbscan_euclidean(spark, sf):
    p = X.table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 20.0).alias("b"))
    return D.dbscan(to_points(p, ["a", "b"], "p_partkey"), 0.5, 8)


def _part_points(spark, sf):
    p = X.table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 20.0).alias("b"))
    return to_points(p, ["a", "b"], "p_partkey")


_LABELLED = """SELECT ev.id, CAST(coalesce(c, -1) AS INTEGER) AS cluster_label, ev.id IN (SELECT p FROM core) AS is_core
FROM ev LEFT JOIN lab ON lab.p = ev.id LEFT JOIN num USING (label)"""


@query("dbscan_manhattan", "WITH RECURSIVE " + _EV + "," + _dbscan_sql("ev", "0.4", 6, "0.5 * abs(a.v[1] - b.v[1]) + 2 * abs(a.v[2] - b.v[2])") + _LABELLED)
def dbscan_manhattan(spark, sf):
    return D.dbscan(_part_points(spark, sf), 0.4, 6, "manhattan", weights=[0.5, 2.0])


_COV = """ev AS (SELECT CAST(p_partkey AS VARCHAR) AS id, [p_size / 10.0, p_retailprice / 20.0] AS v FROM part),
cv AS (SELECT var_pop(v[1]) AS s, var_pop(v[2]) AS t, covar_pop(v[1], v[2]) AS u FROM ev)"""
_MAHALANOBIS = """(SELECT sqrt((t * (a.v[1] - b.v[1]) ** 2 - 2 * u * (a.v[1] - b.v[1]) * (a.v[2] - b.v[2]) + s * (a.v[2] - b.v[2]) ** 2) / (s * t - u * u)) FROM cv)"""


@query("dbscan_mahalanobis", "WITH RECURSIVE " + _COV + "," + _dbscan_sql("ev", "0.1201", 6, _MAHALANOBIS) + _LABELLED)
def dbscan_mahalanobis(spark, sf):
    return D.dbscan(_part_points(spark, sf), 0.1201, 6, "mahalanobis")


@query("outlier_factor_manhattan", Q.with_(_EMB + """,
pr AS (SELECT a.id AS p, b.id AS o, list_sum([abs(a.v[i] - b.v[i]) / i FOR i IN range(1, 65)]) AS d FROM pt a JOIN pt b ON a.id <> b.id),
nn AS (SELECT p, o, d FROM pr QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, o) <= 20),
kd AS (SELECT p, max(d) AS kd FROM nn GROUP BY 1),
lr AS (SELECT nn.p, 1 / (avg(greatest(kd.kd, nn.d)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.p = nn.o GROUP BY 1)""",
    f"SELECT nn.p AS id, {r('avg(o.lrd) / any_value(s.lrd)', 'lof')} FROM nn JOIN lr o ON o.p = nn.o JOIN lr s ON s.p = nn.p GROUP BY nn.p"))
def outlier_factor_manhattan(spark, sf):
    return rounded(N.local_outlier_factor(embedding_points(spark, sf), 20, metric="manhattan", weights=[1 / i for i in range(1, 65)]))


_RANKED = "o AS (SELECT o_orderkey AS k, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, round(o_totalprice / 500) AS b, o_totalprice AS s, o_orderpriority AS p FROM orders)"


def _ranked_orders(spark, sf):
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("a"), F.round(F.col("o_totalprice") / 500).alias("b"),
                                               F.col("o_totalprice").alias("s"), F.col("o_orderpriority").alias("p"))


@query("kendall_tau", Q.with_(_RANKED + """,
g AS (SELECT a, b, count(*) AS w FROM o GROUP BY 1, 2),
t AS (SELECT sum(x.w * y.w) FILTER ((x.a < y.a AND x.b < y.b)) AS c, sum(x.w * y.w) FILTER (x.a < y.a AND x.b > y.b) AS d FROM g x JOIN g y ON x.a < y.a),
n AS (SELECT count(*)::BIGINT AS n FROM o), ta AS (SELECT sum(m * (m - 1) // 2) AS v FROM (SELECT count(*) AS m FROM o GROUP BY a)),
tb AS (SELECT sum(m * (m - 1) // 2) AS v FROM (SELECT count(*) AS m FROM o GROUP BY b)), tc AS (SELECT sum(w * (w - 1) // 2) AS v FROM g)""",
    f"""SELECT n, c::DOUBLE AS concordant, d::DOUBLE AS discordant, ta.v::DOUBLE AS ties_a, tb.v::DOUBLE AS ties_b, tc.v::DOUBLE AS ties_both,
  {r("(c - d) / (sqrt(n * (n - 1) / 2 - ta.v) * sqrt(n * (n - 1) / 2 - tb.v))", "tau_b")} FROM t, n, ta, tb, tc"""))
def kendall_tau(spark, sf):
    return rounded(RK.kendall_tau(_ranked_orders(spark, sf), "a", "b", range_rows=4000))


@query("ranking_quality", Q.with_(_RANKED + """, q AS (SELECT *, row_number() OVER (ORDER BY s DESC, k) AS i, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM o)""",
    f"""SELECT 'precision@' || n AS metric, {r("(SELECT avg(CASE WHEN p = '1-URGENT' THEN 1.0 ELSE 0 END) FROM q WHERE i <= n)", "value")} FROM (VALUES (10), (100), (1000)) v(n)
UNION ALL SELECT 'reciprocal rank', {r("1.0 / min(i)", "value")} FROM q WHERE k % 997 = 3 UNION ALL SELECT 'rank correlation', {r("corr(ra, rb)", "value")} FROM q"""))
def ranking_quality(spark, sf):
    o = _ranked_orders(spark, sf)
    p = RK.precision_at(o, "s", F.col("p") == "1-URGENT", [10, 100, 1000], "k").select(F.concat(F.lit("precision@"), "k").alias("metric"), F.col("precision").alias("value"))
    first = RK.reciprocal_rank(o, "s", F.col("k") % 997 == 3, "k").select(F.lit("reciprocal rank").alias("metric"), F.col("reciprocal_rank").alias("value"))
    rho = RK.rank_correlation(o, "a", "b").select(F.lit("rank correlation").alias("metric"), F.col("rank_correlation").alias("value"))
    return rounded(p.unionByName(first).unionByName(rho))


@query("kmeans_distance")
def kmeans_distance(spark, sf):
    return rounded(MX.kmeans_distance(embedding_points(spark, sf)))


@query("gaussian_mixture")
def gaussian_mixture(spark, sf):
    return rounded(MX.mixture(embedding_points(spark, sf)))


@query("cosine_distance", Q.with_(_EMB + ", c AS (SELECT v AS w FROM pt WHERE id = '0')",
                                  f"SELECT id, {r('least(greatest(1 - list_cosine_similarity(v, w), 0), 2)', 'd')} FROM pt, c"))
def cosine_distance(spark, sf):
    p = embedding_points(spark, sf)
    return rounded(p.withColumn("w", p.where("id = '0'").select("v").scalar()).select("id", D.cosine_distance("v", "w").alias("d")))


def _labels(spark, sf):
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("int").alias("cluster_label"))


@query("silhouette", Q.with_(_EMB + """, lb AS (SELECT CAST(vec_id AS VARCHAR) AS id, label FROM embeddings),
sz AS (SELECT label, count(*) AS n FROM lb GROUP BY 1),
sm AS (SELECT a.id, la.label AS own, lo.label AS other, sum(list_distance(a.v, b.v)) AS s FROM pt a JOIN lb la USING (id), pt b JOIN lb lo USING (id) GROUP BY 1, 2, 3),
ab AS (SELECT id, own, max(n) FILTER (own = other) AS n, max(s / nullif(n - 1, 0)) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b
       FROM sm JOIN sz ON sz.label = other GROUP BY 1, 2)""",
    f"SELECT count(DISTINCT own) AS n_labels, {r('avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)', 'silhouette')} FROM ab"))
def silhouette(spark, sf):
    return rounded(N.silhouette(embedding_points(spark, sf), _labels(spark, sf)))


@query("calinski_harabasz", Q.with_(_EMB + """, x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS val, generate_subscripts(embedding, 1) AS pos FROM embeddings),
g AS (SELECT pos, avg(val) AS gm FROM x GROUP BY 1), c AS (SELECT label, pos, avg(val) AS cm, count(*) AS n FROM x GROUP BY 1, 2),
bw AS (SELECT sum(n * (cm - gm) * (cm - gm)) AS b FROM c JOIN g USING (pos)), wt AS (SELECT sum((val - cm) * (val - cm)) AS w FROM x JOIN c USING (label, pos)),
k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings)""", f"SELECT k AS n_labels, {r('(b / (k - 1)) / (w / (n - k))', 'calinski_harabasz')} FROM bw, wt, k"))
def calinski_harabasz(spark, sf):
    return rounded(N.calinski_harabasz(embedding_points(spark, sf), _labels(spark, sf)))


@query("principal_components")
def principal_components(spark, sf):
    m = X.metrics(spark, sf)
    cols = ["dz_ss_mean", "dz_soth_mean", "p_ss", "p_soth", "kappa_ss", "kappa_soth", "dz_ss_Q", "dz_soth_Q"]
    scaled = standard_scale(fill_zero(m.select("pair_id", *cols), cols), cols)
    pc = MX.PrincipalComponents(3).fit(scaled, cols)
    return rounded(pc.transform(scaled).select("pair_id", "pc_1", "pc_2", "pc_3"))


@query("component_loadings")
def component_loadings(spark, sf):
    m = X.metrics(spark, sf)
    cols = ["dz_ss_mean", "dz_soth_mean", "p_ss", "p_soth", "kappa_ss", "kappa_soth"]
    scaled = standard_scale(fill_zero(m.select("pair_id", *cols), cols), cols)
    return rounded(MX.PrincipalComponents(2).fit(scaled, cols).loadings(spark))


# Three labelings with noise over one table, for the label-only operators.
_LAB = """lb AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE 1 END AS a, CASE WHEN label % 5 = 4 THEN -1 ELSE label END AS c, CAST(vec_id % 3 AS INTEGER) AS g,
  CAST(embedding[1] AS DOUBLE) AS s, CAST(embedding[2] AS DOUBLE) AS q FROM embeddings)"""


def _label_rows(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, -1).otherwise(1).alias("a"), F.when(F.col("label") % 5 == 4, -1).otherwise(F.col("label")).alias("c"),
        (F.col("vec_id") % 3).cast("int").alias("g"), F.col("embedding")[0].cast("double").alias("s"), F.col("embedding")[1].cast("double").alias("q"))


@query("ensemble_consensus", Q.with_(_LAB, "SELECT vec_id, a <> -1 AND c <> -1 AND g <> -1 AND count(*) OVER (PARTITION BY a, c, g) > 1 AS is_high_confidence FROM lb"))
def ensemble_consensus(spark, sf):
    return CO.consensus(_label_rows(spark, sf), ["a", "c", "g"]).select("vec_id", "is_high_confidence")


@query("ensemble_consensus_two", Q.with_(_LAB, """SELECT vec_id, (a <> -1 AND c <> -1 AND count(*) OVER (PARTITION BY a, c) > 1) OR (a <> -1 AND g <> -1 AND count(*) OVER (PARTITION BY a, g) > 1)
  OR (c <> -1 AND g <> -1 AND count(*) OVER (PARTITION BY c, g) > 1) AS is_high_confidence FROM lb"""))
def ensemble_consensus_two(spark, sf):
    return CO.consensus(_label_rows(spark, sf), ["a", "c", "g"], 2).select("vec_id", "is_high_confidence")


@query("consensus_distribution", Q.with_(_LAB + """, m AS (SELECT CASE WHEN x.vec_id = y.vec_id THEN 0 ELSE CASE WHEN x.a = y.a AND x.a <> -1 THEN 1 ELSE 0 END
  + CASE WHEN x.c = y.c AND x.c <> -1 THEN 1 ELSE 0 END + CASE WHEN x.g = y.g AND x.g <> -1 THEN 1 ELSE 0 END END AS k FROM lb x, lb y)""",
    "SELECT CAST(v.k AS INTEGER) AS agreement, CAST(count(m.k) AS DOUBLE) AS cells FROM (VALUES (0), (1), (2), (3)) v(k) LEFT JOIN m ON m.k = v.k GROUP BY v.k"))
def consensus_distribution(spark, sf):
    return rounded(CO.consensus_distribution(_label_rows(spark, sf), ["a", "c", "g"]))


@query("consensus_mean", Q.with_(_LAB, f"""SELECT {r('(SELECT sum((CASE WHEN x.a = y.a AND x.a <> -1 THEN 1 ELSE 0 END + CASE WHEN x.c = y.c AND x.c <> -1 THEN 1 ELSE 0 END + CASE WHEN x.g = y.g AND x.g <> -1 THEN 1 ELSE 0 END) / 3.0) FROM lb x, lb y WHERE x.vec_id <> y.vec_id) / ((SELECT count(*) FROM lb) * (SELECT count(*) FROM lb))', 'mean_consensus')}"""))
def consensus_mean(spark, sf):
    return rounded(CO.consensus_summary(_label_rows(spark, sf), ["a", "c", "g"]))


_MM = "(CASE WHEN {x} IS NOT NULL THEN ({x} - (SELECT min({x}) FROM lb)) / (SELECT max({x}) - min({x}) FROM lb) END)"
_DENS = "(CASE WHEN c = -1 THEN 0 ELSE 1.0 / count(*) OVER (PARTITION BY c) END)"


@query("ml_score", Q.with_(_LAB, f"SELECT vec_id, {r(f'least(greatest(({_MM.format(x=chr(115))} + {_DENS} + {_MM.format(x=chr(113))}) / 3, 0), 1)', 'ml_score')} FROM lb"))
def ml_score(spark, sf):
    return rounded(CO.ml_score(_label_rows(spark, sf), "s", "q", "c").select("vec_id", "ml_score"))


@query("ml_score_earlier", Q.with_(_LAB, f"SELECT vec_id, {r(f'least(greatest(0.7 * {_MM.format(x=chr(115))} + 0.3 * {_DENS}, 0), 1)', 'ml_score')} FROM lb"))
def ml_score_earlier(spark, sf):
    return rounded(CO.ml_score(_label_rows(spark, sf), "s", "q", "c", variant="earlier").select("vec_id", "ml_score"))


_MME = "({x} - (SELECT min({x}) FROM o)) / ((SELECT max({x}) - min({x}) FROM o) + 1e-12)"


@query("unsupervised_score", Q.with_("o AS (SELECT o_orderkey, o_totalprice AS a, o_custkey AS b, o_orderkey % 100 AS c FROM orders)",
    f"SELECT o_orderkey, {r('(' + ' + '.join(_MME.format(x=x) for x in 'abc') + ') / 3', 'unsupervised_score')} FROM o"))
def unsupervised(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"), (F.col("o_orderkey") % 100).alias("c"))
    return rounded(unsupervised_score(o, ("a", "b", "c")).select("o_orderkey", "unsupervised_score"))


@query("unsupervised_ranking")
def unsupervised_ranking(spark, sf):
    return rounded(RC.unsupervised_ranking(X.metrics(spark, sf)).select("pair_id", "unsupervised_score", "metrics_score", "new_rank_score"))


BASELINE = ("Brand#1", "Brand#2")


def _recommended(spark, sf):
    key = ("recs", sf, spark.sparkContext.applicationId)
    if key not in _kept:
        recs, summary = RC.recommendations(X.metrics(spark, sf), BASELINE)
        _kept[key] = materialize(recs, "recs"), materialize(summary, "summary")
    return _kept[key]


_kept: dict = {}


@query("recommendations")
def recommended(spark, sf):
    return rounded(R.flat_recommendations(_recommended(spark, sf)[0]))


@query("recommendation_summary")
def recommendation_summary(spark, sf):
    return _recommended(spark, sf)[1]


@query("recommendations_earlier")
def recommendations_earlier(spark, sf):
    return rounded(R.flat_recommendations(RC.recommendations(X.metrics(spark, sf), BASELINE, variant="earlier")[0]))


@query("recommendation_metrics")
def recommendation_metrics(spark, sf):
    return rounded(R.recommendation_metrics(_recommended(spark, sf)[0]))


def _analyzed(spark, sf):
    key = ("analyzed", sf, spark.sparkContext.applicationId)
    if key not in _kept:
        m = X.metrics(spark, sf)
        recs, summary = RC.PairAnalyzer(control=BASELINE).fit(m).predict(m)
        _kept[key] = materialize(recs, "recs"), materialize(summary, "summary")
    return _kept[key]


@query("analyzer_recommendations")
def analyzer_recommendations(spark, sf):
    return rounded(R.flat_recommendations(_analyzed(spark, sf)[0]))


@query("analyzer_summary")
def analyzer_summary(spark, sf):
    return rounded(_analyzed(spark, sf)[1])


@query("result_checks")
def result_checks(spark, sf):
    recs, summary = _analyzed(spark, sf)
    return rounded(R.result_checks(summary, recs.agg(F.count(F.lit(1)).alias("n"))))


@query("combined_score", Q.with_("""o AS (SELECT o_orderkey AS k, o_totalprice AS e, (o_orderkey % 97) / 97.0 AS m, (o_custkey % 89) / 89.0 AS u, (o_orderkey % 83) / 83.0 AS b FROM orders)""",
    f"SELECT k AS pair_id, {r('0.35 * m + 0.35 * u + 0.2 * b + 0.1 * (e - (SELECT min(e) FROM o)) / (SELECT max(e) - min(e) FROM o)', 'combined_score')}, m > 0.6 AND u > 0.5 AND b > 0.7 AS is_high_confidence FROM o"))
def combined_score(spark, sf):
    o = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pair_id"), F.col("o_totalprice").alias("e"), (F.col("o_orderkey") % 97 / 97.0).alias("ml_score"),
        (F.col("o_custkey") % 89 / 89.0).alias("rules_score"), (F.col("o_orderkey") % 83 / 83.0).alias("baseline_similarity"))
    return rounded(RC.combine_scores(o, "e").select("pair_id", "combined_score", "is_high_confidence"))
