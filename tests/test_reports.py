import pytest
from pyspark.sql import functions as F

from rhopool.operators import clean as C
from rhopool.operators import reports as R
from rhopool.operators import upsert as U
from rhopool.sources import files as FI
from rhopool.sources import tables as TB

MEASURES = "struct<p_ss double, p_soth double, dz_ss_mean double, dz_soth_mean double>"
RECS = f"pair_id string, gene_a string, gene_b string, combined_score double, rules_score double, ml_confidence double, is_high_confidence boolean, is_outlier boolean, rank int, statistical_measures {MEASURES}"


def _recs(spark, n):
    return spark.createDataFrame([(f"{i:02d}", "A", f"B{i}", 1.0 / (i + 1), 0.5, 0.25, i % 2 == 0, i % 3 == 0, i + 1, (0.1, 0.2, 0.3, 0.4)) for i in range(n)], RECS)


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(f"{i:02d}", "A", f"B{i}", float(i), 1.0, 0.01, 0.2, 1.0, None) for i in range(30)],
                                 "pair_id string, GeneAName string, GeneBName string, dz_ss_mean double, dz_soth_mean double, p_ss double, p_soth double, kappa_ss double, kappa_soth double")


@pytest.mark.parametrize("n, top, want", [(25, 3, 3), (25, 0, 20), (25, -4, 20), (0, 20, 0)])
def test_report_tables(spark, pairs, tmp_path, n, top, want):
    recs = _recs(spark, n)
    summary = spark.createDataFrame([(30, True)], "total_pairs long, positive_control_validated boolean")
    t = R.report_tables(pairs, recs, summary, "s", {"ranking": R.ranking_rows(recs)}, top)
    meta = t["metadata"].first()
    assert (meta.session_id, meta.total_pairs, meta.n_recommendations, meta.top_n) == ("s", 30, n, top if top > 0 else 20)
    one = t["summary"].collect()
    assert len(one) == 1 and one[0].total_recommendations == n and one[0].high_confidence_pairs == (n + 1) // 2 and one[0].positive_control_validated
    assert [r["rank"] for r in t["top_recommendations"].orderBy("rank").collect()] == list(range(1, want + 1))
    assert t["export_records"].count() == n and t["export_columns"].count() == len(pairs.columns) and t["chart_ranking"].count() == min(n, 20)
    for fmt in ("json", "csv"):
        FI.write_bundle(t, f"{tmp_path}/{fmt}", fmt)
        back = FI.read_bundle(spark, f"{tmp_path}/{fmt}", fmt)
        assert set(back) == {k for k, d in t.items() if d.count()} and back["export_columns"].count() == len(pairs.columns)


def test_chart_tables_with_everything(spark, pairs):
    labels = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 0, 1), ("c", -1, -1, None), ("d", 1, 2, 1)], "pair_id string, anomaly_label int, cluster_label int, gmm_label int")
    loadings = spark.createDataFrame([("x", 1, -0.9), ("y", 1, 0.3), ("x", 2, 5.0)], "feature string, component int, loading double")
    facts = spark.createDataFrame([("control", 0.5), ("sepsis", 0.1), ("septic shock", -0.2)], "condition string, rho_spearman double")
    t = R.chart_tables(pairs, facts, labels, _recs(spark, 4), loadings, 2)
    assert {(r.method, r.label): r["size"] for r in t["cluster_sizes"].collect()} == {
        ("anomaly_label", 1): 3, ("anomaly_label", -1): 1, ("cluster_label", 0): 2, ("cluster_label", 2): 1, ("cluster_label", -1): 1, ("gmm_label", 0): 1, ("gmm_label", 1): 2}
    assert sum(int(r.cells) for r in t["agreement"].collect()) == 16
    assert [r.pair for r in t["ranking"].orderBy("rank").collect()] == ["A-B0", "A-B1"]
    assert [(r.feature, r.importance) for r in t["loadings"].collect()] == [("x", 0.9), ("y", 0.3)]
    assert {"effect_boxes", "effect_scatter", "rho_boxes", "rho_histogram", "correlations"} <= set(t)


def test_key_sets_and_stage(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert {r.k: (r.in_left, r.in_right) for r in U.key_sets(left, right, "k").collect()} == {1: (True, False), 2: (True, True), 3: (False, True), None: (True, True)}
    stage = spark.createDataFrame([("s", "g", 1), ("s", "g", 5), ("s", "no", 9), ("t", "g", 2), (None, "g", 7)], "sample string, gene string, at int")
    dims = [(spark.createDataFrame([("s", 10), ("t", 20)], "sample string, sample_key int"), "sample", "sample_key"), (spark.createDataFrame([("g", 7)], "gene string, gene_key int"), "gene", "gene_key")]
    assert sorted(map(tuple, U.resolve_stage(stage, dims, "at").collect())) == [(10, 7, 5), (20, 7, 2)]


def test_source_of_rows(spark, tmp_path):
    for k in ("a", "b"):
        (tmp_path / f"{k}.json").write_text('{"id": {"v": 1}}\n')
    d = C.with_source(FI.flatten(FI.read_table(spark, f"{tmp_path}/*.json", "json")))
    assert sorted(r.data_source[-6:] for r in d.collect()) == ["a.json", "b.json"]
    assert C.with_source(spark.range(1)).first().data_source == "unknown" and C.with_source(spark.range(1), "lab").first().data_source == "lab"


def test_pair_values_and_rows_by(spark):
    facts = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.7), (2, 5, 0.1), (3, 6, 9.0), (1, 8, 3.0)], "sample_key int, gene_key int, expression_value double")
    samples = spark.createDataFrame([(1, "X", "sepsis"), (2, "Y", "control"), (4, "Y", "control")], "sample_key int, study string, sample_classification string")
    assert sorted(map(tuple, R.pair_values(facts, samples, 5, 6).collect())) == [("X", 1, "sepsis", 0.5, 0.7), ("Y", 2, "control", 0.1, None)]
    rows = TB.table_rows_by({"facts": facts, "samples": samples.unionByName(samples)}, "study").collect()
    assert sorted(map(tuple, rows), key=repr) == [("facts", None, 5), ("samples", "X", 2), ("samples", "Y", 4)]


def test_ranking_rows_are_the_first_by_rank(spark):
    recs = _recs(spark, 30).withColumn("rank", 31 - F.col("rank"))
    assert [r["rank"] for r in R.ranking_rows(recs, 5).collect()] == [1, 2, 3, 4, 5]
