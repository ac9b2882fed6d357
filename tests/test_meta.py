import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhopool.operators import meta as M
from rhopool.operators.fdr import adjust


def brute(x, se):
    x, se = np.asarray(x, float), np.asarray(se, float)
    w = 1 / se**2
    mu = (w * x).sum() / w.sum()
    q = (w * (x - mu) ** 2).sum()
    k = len(x)
    c = w.sum() - (w**2).sum() / w.sum()
    tau2 = max(0.0, (q - (k - 1)) / c) if k > 1 else 0.0
    wr = 1 / (se**2 + tau2)
    return (wr * x).sum() / wr.sum(), math.sqrt(1 / wr.sum()), q, max(0, (q - k + 1) / q) * 100 if k > 1 and q > 0 else 0.0


def test_random_effects(spark):
    rng = np.random.default_rng(1)
    groups = {g: (rng.normal(0.3, 0.4, k), rng.uniform(0.05, 0.4, k)) for g, k in zip("abcdef", (1, 2, 3, 5, 40, 7))}
    # Nearly equal effects with tiny standard errors: sums of squares would cancel completely.
    base = np.array([0.5, 0.5 + 1e-9, 0.5 - 1e-9])
    groups["tight"] = (base, np.full(3, base.std(ddof=1) / math.sqrt(3)))
    rows = [(g, float(x), float(s)) for g, (xs, ss) in groups.items() for x, s in zip(xs, ss)]
    rows += [("a", None, 0.1), ("a", float("nan"), 0.1), ("a", 9.0, 0.0), ("none", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, s double")
    got = {r.g: r for r in M.random_effects(df, ["g"], "x", "s").collect()}
    for g, (x, s) in groups.items():
        mean, se, q, i2 = brute(x, s)
        r = got[g]
        assert r["mean"] == pytest.approx(mean, rel=1e-9) and r["se"] == pytest.approx(se, rel=1e-6)
        assert r["Q"] == pytest.approx(q, rel=1e-4, abs=1e-9) and r["I2"] == pytest.approx(i2, rel=1e-4, abs=1e-2)
        assert min(x) - 1e-12 <= r["mean"] <= max(x) + 1e-12 and 0 <= r["I2"] <= 100
    assert got["none"]["k"] == 0 and got["none"]["mean"] is None and got["none"]["p"] is None
    assert got["a"]["n_effects"] == 2


@pytest.mark.parametrize("mode", ["standard", "reference"])
def test_fdr(spark, mode):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.uniform(0, 1, 300), np.full(150, 1.0), np.zeros(40), rng.uniform(0, 1e-6, 50), np.repeat(0.2, 60)])
    rows = [(i, "g%d" % (i % 2), float(v)) for i, v in enumerate(p)] + [(9999, "g0", None)]
    df = spark.createDataFrame(rows, "i long, g string, p double")
    for keys in ([], ["g"]):
        got = {r.i: r.q for r in adjust(df, "p", "q", keys, mode).collect()}
        assert got[9999] is None and len(got) == len(rows)
        for part in ([range(len(p))] if not keys else [range(0, len(p), 2), range(1, len(p), 2)]):
            idx = np.array(list(part))
            v, m = p[idx], len(idx)
            rank = np.array([(v <= x).sum() for x in v])
            raw = v * m / rank
            for j, i in enumerate(idx):
                scope = raw[v >= v[j]] if mode == "standard" else raw[v <= v[j]]
                assert got[i] == pytest.approx(min(1.0, scope.min()), rel=1e-12)
                if mode == "standard":
                    assert got[i] >= p[i] - 1e-15


FACT = ("gene_a_key long, gene_b_key long, gene_a_name string, gene_b_name string, gene_a_direction string, gene_b_direction string, "
        "expr_a_case double, expr_b_case double, expr_a_ctrl double, expr_b_ctrl double, condition string, study_key long, "
        "rho_spearman double, n_samples long")


def facts(spark, rows):
    return spark.createDataFrame([(1, 2, "A", "B", "Up", "Down", 4.0, 1.0, 2.0, 2.0, c, s, r, n) for c, s, r, n in rows], FACT)


def test_missing_conditions(spark):
    df = facts(spark, [("septic shock", 1, 0.5, 23), ("sepsis", 1, 0.1, 13), ("septic shock", 2, 0.4, 23), ("control", 2, 0.0, 13),
                       ("septic shock", 3, 0.3, 3), ("sepsis", 3, 0.3, 30)])
    drop = {r.study_key: r for r in M.study_contrasts(M.label_rows(df)).collect()}
    assert drop[1].dz_ss == pytest.approx(math.atanh(0.5) - math.atanh(0.1)) and drop[1].se_ss == pytest.approx(math.sqrt(1 / 20 + 1 / 10))
    assert drop[2].dz_ss is None and drop[2].dz_soth == pytest.approx(math.atanh(0.4))
    assert drop[3].dz_ss is None and drop[3].dz_soth is None
    zero = {r.study_key: r for r in M.study_contrasts(M.label_rows(df), missing="zero").collect()}
    assert zero[2].dz_ss == pytest.approx(math.atanh(0.4)) and zero[2].se_ss == pytest.approx(math.sqrt(1 / 20))
    m = M.pair_metrics(df).first()
    assert (m.n_studies_ss, m.n_studies_soth) == (1, 2) and m.GeneAName == "A" and m.total_samples == 23 + 13 + 23 + 13 + 3 + 30
    assert m.geneA_log2fc == pytest.approx(1.0) and m.geneB_log2fc == pytest.approx(-1.0) and m.expression_asymmetry == pytest.approx(1.0)
    assert M.METRIC_COLUMNS == M.pair_metrics(df).columns and len(M.METRIC_COLUMNS) == 72


def test_combined_columns_by_hand(spark):
    # Three pooled correlations and their statistics, combined by hand.
    r, z, i2, p = (0.3, -0.7, -0.6), (2.0, -1.9, -12.0), (50.0, 90.0, 0.0), (0.03, 0.06, 1e-9)
    row = {}
    for g, a, b, c, d in zip(("control", "sepsis", "septic_shock"), r, z, i2, p):
        row |= {f"{g}_weighted_r": a, f"{g}_z_stat": b, f"{g}_I2": c, f"{g}_p_value": d, f"{g}_se_r": 0.1}
    row["total_samples"] = 564.0
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    out = M.add_contrasts(df.withColumns(M.combined_columns())).first()
    assert out.combined_p_value == pytest.approx(math.sqrt(0.03 * 0.06 * 1e-9))
    assert out.combined_effect_size == pytest.approx(math.sqrt(0.3 * 0.7 * 0.6))
    cz = math.sqrt(4 + 1.9**2 + 144)
    assert out.combined_z_score == pytest.approx(cz) and out.power_score == pytest.approx(cz**2 / (cz**2 + 564))
    assert out.consistency_score == pytest.approx(1 / (1 + 140 / 300)) and out.direction_consistency == 0.0
    a = np.abs(r)
    assert out.magnitude_consistency == pytest.approx(1 - a.std() / (a.mean() + 1e-10))
    assert out.delta_r_shock_control == pytest.approx(-0.9) and out.z_diff_shock_control == pytest.approx(-0.9 / math.sqrt(0.02))


def test_simple_variant_others_moments(spark):
    df = facts(spark, [(c, s, r, 20) for s, (a, b, d) in enumerate([(0.5, 0.1, 0.0), (0.6, 0.3, 0.2), (0.1, None, 0.4)])
                       for c, r in (("septic shock", a), ("sepsis", b), ("control", d)) if r is not None])
    m = M.simple_pair_metrics(df).first()
    sh, oth = np.arctanh([0.5, 0.6, 0.1]), np.arctanh([0.0, 0.2, 0.4, 0.1, 0.3])
    va, vb = sh.var(ddof=1) / 3, oth.var(ddof=1) / 5
    assert m.t_sothers == pytest.approx((sh.mean() - oth.mean()) / math.sqrt(va + vb))
    assert m.df_sothers == pytest.approx((va + vb) ** 2 / (va**2 / 2 + vb**2 / 4))
    assert 0 < m.p_sothers < 1 and m.n_studies == 3


def test_gates_and_labels(spark):
    df = spark.createDataFrame([(0.01, 0.01, 0.5, 0.5, 0.8, 0.8), (0.01, None, 0.5, 0.5, 0.8, 0.8)],
                               "q_ss double, q_sothers double, abs_dz_ss double, abs_dz_sothers double, kappa_ss double, kappa_sothers double")
    assert [r[0] for r in df.select(M.pass_gates()).collect()] == [True, False]
    lab = spark.createDataFrame([(1,), (2,), (9,)], "c int").select(M.map_labels("c", M.LABEL_CODES)).collect()
    assert [r[0] for r in lab] == ["septic shock", "control", None]
