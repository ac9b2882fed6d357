"""Meta-analysis of per-study effects and the pair metrics table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.operators.fdr import adjust
from rhopool.session import materialize

# Differences this small are rounding of equal values, not a direction.
SIGN_NOISE = 1e-12
CONDITIONS = ["control", "sepsis", "septic shock"]

# Published column order of the pair metrics table.
METRIC_COLUMNS = [
    "pair_id", "n_studies_ss", "n_studies_soth", "dz_ss_mean", "dz_ss_se", "dz_ss_ci_low", "dz_ss_ci_high", "dz_ss_Q",
    "dz_ss_I2", "dz_ss_z", "p_ss", "dz_soth_mean", "dz_soth_se", "dz_soth_ci_low", "dz_soth_ci_high", "dz_soth_Q",
    "dz_soth_I2", "dz_soth_z", "p_soth", "kappa_ss", "kappa_soth", "abs_dz_ss", "abs_dz_soth", "control_weighted_r",
    "control_se_r", "control_I2", "control_z_stat", "control_p_value", "control_n_samples", "sepsis_weighted_r",
    "sepsis_se_r", "sepsis_I2", "sepsis_z_stat", "sepsis_p_value", "sepsis_n_samples", "septic_shock_weighted_r",
    "septic_shock_se_r", "septic_shock_I2", "septic_shock_z_stat", "septic_shock_p_value", "septic_shock_n_samples",
    "delta_r_shock_control", "se_diff_shock_control", "z_diff_shock_control", "p_diff_shock_control",
    "delta_r_shock_sepsis", "se_diff_shock_sepsis", "z_diff_shock_sepsis", "p_diff_shock_sepsis",
    "delta_r_sepsis_control", "se_diff_sepsis_control", "z_diff_sepsis_control", "p_diff_sepsis_control",
    "combined_p_value", "combined_effect_size", "combined_z_score", "power_score", "consistency_score",
    "direction_consistency", "magnitude_consistency", "geneA_log2fc", "geneB_log2fc", "expression_change_magnitude",
    "expression_asymmetry", "total_samples", "q_ss", "q_soth", "rank_score", "GeneAName", "GeneBName", "GeneAKey",
    "GeneBKey",
]

# Numeric codes of the condition labels.
LABEL_CODES = {2: "control", 1: "septic shock", 3: "sepsis"}


def pair_id(a="gene_a_key", b="gene_b_key") -> Column:
    """min_max of the two numeric keys."""
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    return F.concat_ws("_", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def map_labels(label: Column | str, mapping: dict) -> Column:
    """Look a label up in ``mapping``; unmapped gives NULL; underscores become blanks."""
    c = F.col(label) if isinstance(label, str) else label
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.replace(F.try_element_at(F.create_map(*pairs), c), F.lit("_"), F.lit(" "))


# --- random effects ---------------------------------------------------------

def random_effects(df: DataFrame, keys: list[str], effect: str, se: str) -> DataFrame:
    """DerSimonian-Laird pooling of ``effect`` with standard error ``se`` per ``keys``.

    Two mergeable aggregations and one join on ``keys``; no group is ever
    gathered, so a key holding a large share of the rows stays splittable.
    Q comes from covariance accumulators, which do not cancel the way
    sum-of-squares does:  Q = k*cov(wx, x) - mu * k*cov(w, x).

    Columns: k, mean, se, ci_low, ci_high, Q, I2, tau2, z, p, plus
    n_effects, n_pos, n_neg over all non-null effects (valid se or not).
    """
    x, s = S.finite(effect), S.finite(se)
    # Kept flat so both passes below read the same exchange.
    rows = df.select(*keys, x.alias("_x"), F.when(x.isNotNull() & (s > 0), S.div(F.lit(1.0), s * s)).alias("_w"))
    valid = F.when(F.col("_w").isNotNull(), F.col("_x"))
    w = F.col("_w")
    first = rows.groupBy(*keys).agg(
        F.count("_w").alias("k"), F.sum(w).alias("_sw"), F.sum(w * w).alias("_sw2"),
        F.sum(w * valid).alias("_swx"),
        F.covar_pop(w * valid, valid).alias("_cwxx"), F.covar_pop(w, valid).alias("_cwx"),
        F.count("_x").alias("n_effects"),
        F.count_if(F.col("_x") > SIGN_NOISE).alias("n_pos"), F.count_if(F.col("_x") < -SIGN_NOISE).alias("n_neg"),
    )
    k = F.col("k").cast("double")
    mu = S.div("_swx", "_sw")
    q = F.when(F.col("k") > 1, F.greatest(k * F.col("_cwxx") - mu * k * F.col("_cwx"), F.lit(0.0))) \
         .when(F.col("k") == 1, F.lit(0.0))
    c = F.col("_sw") - S.div("_sw2", "_sw")
    dof = k - 1.0
    tau2 = F.when(F.col("k") > 1, F.coalesce(F.greatest(S.div(F.col("Q") - dof, c), F.lit(0.0)), F.lit(0.0))) \
            .when(F.col("k") == 1, F.lit(0.0))
    first = first.withColumn("Q", q).withColumn("tau2", tau2).select(
        *keys, "k", "Q", "tau2", "n_effects", "n_pos", "n_neg",
        F.when((F.col("Q") > 0) & (F.col("k") > 1),
               F.greatest(S.div(F.col("Q") - dof, "Q"), F.lit(0.0)) * 100.0)
         .when(F.col("k") >= 1, F.lit(0.0)).alias("I2"))

    weight = S.div(F.lit(1.0), S.div(F.lit(1.0), "_w") + F.col("tau2"))
    second = (rows.where("_w is not null")
              .join(first.select(*keys, "tau2"), keys)
              .withColumn("_wr", weight)
              .groupBy(*keys).agg(F.sum("_wr").alias("_sr"), F.sum(F.col("_wr") * F.col("_x")).alias("_srx")))
    out = first.join(second, keys, "left")
    out = out.withColumn("mean", S.div("_srx", "_sr")).withColumn("se", F.sqrt(S.div(F.lit(1.0), "_sr")))
    out = out.withColumn("z", S.div("mean", "se"))
    return out.select(
        *keys, "k", "mean", "se",
        (F.col("mean") - F.lit(S.Z_975) * F.col("se")).alias("ci_low"),
        (F.col("mean") + F.lit(S.Z_975) * F.col("se")).alias("ci_high"),
        "Q", "I2", "tau2", "z", S.two_sided_p("z").alias("p"), "n_effects", "n_pos", "n_neg")


def sign_agreement(mean="mean", n="n_effects", pos="n_pos", neg="n_neg") -> Column:
    """Share of effects whose sign equals that of the pooled mean; NULL for a zero or missing mean."""
    same = F.when(F.col(mean) > SIGN_NOISE, F.col(pos)).when(F.col(mean) < -SIGN_NOISE, F.col(neg))
    return S.div(same, n)


# --- per-study contrasts ------------------------------------------------------

def label_rows(facts: DataFrame) -> DataFrame:
    """Pair id, Fisher z and effective n on the long fact."""
    return facts.withColumns({
        "pair_id": pair_id(), "z": S.fisher_z("rho_spearman"), "n_eff": S.effective_n("n_samples")})


def opposite_directions(facts: DataFrame) -> DataFrame:
    """Rows whose genes move in different directions (NULL directions drop)."""
    return facts.where(F.col("gene_a_direction") != F.col("gene_b_direction"))


def pivot_conditions(rows: DataFrame, values: dict[str, str], order: str = "gene_a_key") -> DataFrame:
    """First non-null value per (pair, study) and condition; ``order`` makes "first" well defined.

    One numeric order column keeps every buffer primitive, hence a hash aggregation.
    """
    ordering = F.col(order)
    aggs = []
    for cond in CONDITIONS:
        short = cond.split()[-1]
        for col, prefix in values.items():
            pick = F.when((F.col("condition") == cond) & F.col(col).isNotNull(), ordering)
            aggs.append(F.min_by(F.col(col), pick).alias(f"{prefix}_{short}"))
    return rows.groupBy("pair_id", "study_key").agg(*aggs)


def study_contrasts(rows: DataFrame, missing: str = "drop", order: str = "gene_a_key") -> DataFrame:
    """Per-study shock-sepsis and shock-others deltas with standard errors.

    ``missing="drop"``: a contrast needs its conditions; "others" uses whichever
    of control and sepsis exist.  ``missing="zero"``: an absent condition counts
    as z = 0 with no variance.
    """
    if missing not in ("drop", "zero"):
        raise ValueError(f"unknown missing mode {missing!r}")
    if missing == "drop":
        rows = rows.withColumn("z", F.when(F.col("n_eff").isNotNull(), F.col("z"))) \
                   .withColumn("n_eff", F.when(F.col("z").isNotNull(), F.col("n_eff")))
    p = pivot_conditions(rows, {"z": "z", "n_eff": "ne"}, order)
    cols = [f"{a}_{b}" for a in ("z", "ne") for b in ("shock", "sepsis", "control")]
    if missing == "zero":
        p = p.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})
    n_sh, n_se, n_co = F.col("ne_shock"), F.col("ne_sepsis"), F.col("ne_control")
    w_se, w_co = F.coalesce(n_se, F.lit(0.0)), F.coalesce(n_co, F.lit(0.0))
    total = w_se + w_co
    others = S.div(w_co * F.coalesce("z_control", F.lit(0.0)) + w_se * F.coalesce("z_sepsis", F.lit(0.0)), total)
    inv_others = S.div(F.lit(1.0), total)
    if missing == "zero":
        others, inv_others = F.coalesce(others, F.lit(0.0)), F.coalesce(inv_others, F.lit(0.0))
        inv_sh, inv_se = S.inverse_or_zero(n_sh), S.inverse_or_zero(n_se)
    else:
        inv_sh, inv_se = S.div(F.lit(1.0), n_sh), S.div(F.lit(1.0), n_se)
    return p.select(
        "pair_id", "study_key", *cols,
        (F.col("z_shock") - F.col("z_sepsis")).alias("dz_ss"), F.sqrt(inv_sh + inv_se).alias("se_ss"),
        (F.col("z_shock") - others).alias("dz_soth"), F.sqrt(inv_sh + inv_others).alias("se_soth"))


def study_series(per_study: DataFrame) -> DataFrame:
    """One row per (pair, study, series): the two contrasts and the three conditions."""
    se = lambda n: F.when(F.col(n) > 0, F.sqrt(S.div(F.lit(1.0), n)))
    series = F.array(
        *[F.struct(F.lit(c).alias("series"), F.col(f"dz_{c}").alias("x"), F.col(f"se_{c}").alias("se"))
          for c in ("ss", "soth")],
        *[F.struct(F.lit(g).alias("series"), F.col(f"z_{g.split()[-1]}").alias("x"),
                   se(f"ne_{g.split()[-1]}").alias("se")) for g in CONDITIONS])
    return per_study.select("pair_id", F.inline(series)).where("x is not null")


# --- combined statistics on the pivoted pair row -------------------------------

CONTRASTS = {"shock_control": ("septic_shock", "control"), "shock_sepsis": ("septic_shock", "sepsis"),
             "sepsis_control": ("sepsis", "control")}


def add_contrasts(m: DataFrame) -> DataFrame:
    """Difference of pooled correlations per condition pair, with se, z and p (staged: p uses z many times)."""
    diff, z, p = {}, {}, {}
    for tag, (a, b) in CONTRASTS.items():
        ra, rb, sa, sb = (F.col(c) for c in (f"{a}_weighted_r", f"{b}_weighted_r", f"{a}_se_r", f"{b}_se_r"))
        usable = ra.isNotNull() & rb.isNotNull() & (sa + sb > 0)
        diff[f"delta_r_{tag}"] = F.when(usable, ra - rb)
        diff[f"se_diff_{tag}"] = F.when(usable, F.sqrt(sa * sa + sb * sb))
        z[f"z_diff_{tag}"] = S.div(f"delta_r_{tag}", f"se_diff_{tag}")
        p[f"p_diff_{tag}"] = S.two_sided_p(f"z_diff_{tag}")
    return m.withColumns(diff).withColumns(z).withColumns(p)


def combined_columns() -> dict[str, Column]:
    """Three-condition combinations; NULL unless all three conditions are present.

    The published p and effect columns are the square root (not the cube root) of the product.
    """
    g = ["control", "sepsis", "septic_shock"]
    col = lambda suffix: [F.col(f"{x}_{suffix}") for x in g]
    p, r, z, i2 = col("p_value"), col("weighted_r"), col("z_stat"), col("I2")
    a = [F.abs(x) for x in r]
    cz2 = z[0] * z[0] + z[1] * z[1] + z[2] * z[2]
    mean = (a[0] + a[1] + a[2]) / 3.0
    var = sum(((x - mean) * (x - mean) for x in a), F.lit(0.0)) / 3.0
    neg = [(F.when(x.isNotNull(), (x < -SIGN_NOISE).cast("int"))) for x in r]  # a pooled zero is rounding, not a direction
    n_neg = neg[0] + neg[1] + neg[2]
    return {
        "combined_p_value": F.sqrt(p[0] * p[1] * p[2]),
        "combined_effect_size": F.sqrt(a[0] * a[1] * a[2]),
        "combined_z_score": F.sqrt(cz2),
        "power_score": F.when(F.col("total_samples") > 0, S.div(cz2, cz2 + F.col("total_samples"))),
        "consistency_score": S.div(F.lit(1.0), 1.0 + (i2[0] + i2[1] + i2[2]) / 300.0),
        "direction_consistency": F.when(n_neg.isNotNull(), n_neg.isin(0, 3).cast("double")),
        "magnitude_consistency": F.when(mean > 0, F.greatest(F.lit(0.0), 1.0 - S.div(F.sqrt(var), mean + 1e-10))),
    }


def expression_columns() -> dict[str, Column]:
    def lfc(s):
        return F.log2(S.div(F.abs(F.col(f"expr_{s}_case")) + 1e-10, F.abs(F.col(f"expr_{s}_ctrl")) + 1e-10))
    a, b = lfc("a"), lfc("b")
    both = a.isNotNull() & b.isNotNull()
    return {"geneA_log2fc": a, "geneB_log2fc": b, "expression_change_magnitude": F.sqrt(a * a + b * b),
            "expression_asymmetry": F.when(both, F.greatest(F.abs(a), F.abs(b)))}


def rank_score() -> Column:
    def part(c):
        q = S.clip(f"q_{c}", 1e-300, 1.0)
        return (F.coalesce(f"abs_dz_{c}", F.lit(0.0)) * F.log10(S.div(F.lit(1.0), q) + 1.0)
                * F.coalesce(f"kappa_{c}", F.lit(0.0)))
    return part("ss") + 0.25 * part("soth")


def pair_metrics(facts: DataFrame, missing: str = "drop", fdr: str = "standard",
                 order: str = "gene_a_key") -> DataFrame:
    """The pair metrics table: contrasts and conditions pooled over studies, combined scores, FDR, rank score.

    ``facts`` holds one row per (pair, study, condition); a repeated one counts
    once, chosen by ``order``.  All five series of a pair (two contrasts, three conditions) go through one
    random-effects pass as rows keyed by (pair, series).
    """
    rows = label_rows(facts)
    per_study = study_contrasts(rows, missing, order)
    dl = random_effects(study_series(per_study), ["pair_id", "series"], "x", "se")
    dl = dl.withColumn("kappa", sign_agreement())
    pick = lambda series, col, name: F.max(F.when(F.col("series") == series, F.col(col))).alias(name)
    aggs = []
    for c in ("ss", "soth"):
        for src, name in (("n_effects", f"n_studies_{c}"), ("mean", f"dz_{c}_mean"), ("se", f"dz_{c}_se"),
                          ("ci_low", f"dz_{c}_ci_low"), ("ci_high", f"dz_{c}_ci_high"), ("Q", f"dz_{c}_Q"),
                          ("I2", f"dz_{c}_I2"), ("z", f"dz_{c}_z"), ("p", f"p_{c}"), ("kappa", f"kappa_{c}")):
            aggs.append(pick(c, src, name))
    for g in CONDITIONS:
        u = g.replace(" ", "_")
        for src, name in (("mean", f"_m_{u}"), ("se", f"_s_{u}"), ("I2", f"{u}_I2"),
                          ("z", f"{u}_z_stat"), ("p", f"{u}_p_value")):
            aggs.append(pick(g, src, name))
    wide = dl.groupBy("pair_id").agg(*aggs)

    m = wide.join(pair_facts(rows, order), "pair_id")
    m = m.withColumns({
        "abs_dz_ss": F.abs("dz_ss_mean"), "abs_dz_soth": F.abs("dz_soth_mean"),
        "total_samples": F.col("control_n_samples") + F.col("sepsis_n_samples") + F.col("septic_shock_n_samples"),
        **{f"{u}_weighted_r": S.tanh_back(f"_m_{u}") for u in ("control", "sepsis", "septic_shock")}})
    m = m.withColumns({f"{u}_se_r": S.se_of_r(f"_s_{u}", f"{u}_weighted_r")
                       for u in ("control", "sepsis", "septic_shock")})
    m = add_contrasts(m).withColumns({**combined_columns(), **expression_columns()})
    m = m.withColumnsRenamed({"gene_a_name": "GeneAName", "gene_b_name": "GeneBName",
                              "gene_a_key": "GeneAKey", "gene_b_key": "GeneBKey"})
    # FDR reads the pair table several times; store it once instead of recomputing the pooling.
    m = add_fdr(materialize(m, "pooled"), {"p_ss": "q_ss", "p_soth": "q_soth"}, fdr)
    return m.withColumn("rank_score", rank_score()).select(*METRIC_COLUMNS)


def add_fdr(m: DataFrame, columns: dict[str, str], mode: str, key: str = "pair_id") -> DataFrame:
    """BH for several p columns over one narrow (series, p) table, joined back by pair once."""
    long = m.select(key, *columns).unpivot([key], list(columns), "series", "p")
    qs = adjust(long, "p", "q", ["series"], mode)
    wide = qs.groupBy(key).agg(*[F.max(F.when(F.col("series") == p, F.col("q"))).alias(q) for p, q in columns.items()])
    return m.join(wide, key)


def pair_facts(rows: DataFrame, order: str = "gene_a_key") -> DataFrame:
    """Names, keys, first expression values and sample totals per pair.

    The bulk of the rows is reduced with primitive buffers; the names ride along
    as grouping keys and are chosen from the few oriented rows left per pair.
    """
    names = ["gene_a_key", "gene_b_key", "gene_a_name", "gene_b_name"]
    exprs = ["expr_a_case", "expr_a_ctrl", "expr_b_case", "expr_b_ctrl"]
    totals = [f"{g.replace(' ', '_')}_n_samples" for g in CONDITIONS]
    oriented = rows.groupBy("pair_id", *names).agg(
        F.min(order).alias("_ord"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in exprs],
        *[F.coalesce(F.sum(F.when(F.col("condition") == g, F.col("n_samples"))), F.lit(0)).alias(t)
          for g, t in zip(CONDITIONS, totals)])
    ordering = F.struct("_ord", "gene_a_key", "gene_b_key")
    return oriented.groupBy("pair_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), ordering)).alias(c) for c in names + exprs],
        *[F.sum(t).alias(t) for t in totals])


# --- the simple variant ---------------------------------------------------------

def welch(prefix_a: str, prefix_b: str) -> dict[str, Column]:
    """t and Welch-Satterthwaite df from (n, mean, var) columns; NULL when a side has n < 2."""
    na, nb = F.col(f"n_{prefix_a}").cast("double"), F.col(f"n_{prefix_b}").cast("double")
    va, vb = S.div(f"var_{prefix_a}", na), S.div(f"var_{prefix_b}", nb)
    ok = (na >= 2) & (nb >= 2)
    t = F.when(ok, S.div(F.col(f"mean_{prefix_a}") - F.col(f"mean_{prefix_b}"), F.sqrt(va + vb)))
    df = F.when(ok, S.div((va + vb) * (va + vb), S.div(va * va, na - 1.0) + S.div(vb * vb, nb - 1.0)))
    return {"t": t, "df": df}


def simple_pair_metrics(facts: DataFrame, fdr: str = "standard", order: str = "gene_a_key",
                        with_p: bool = True) -> DataFrame:
    """Unweighted pair metrics: mean deltas, Welch tests, sd/sqrt(k) random effects, sign agreement."""
    rows = facts.withColumns({"pair_id": pair_id(), "z": S.fisher_z("rho_spearman")})
    p = pivot_conditions(rows, {"z": "z"}, order)
    others = S.div(F.coalesce("z_control", F.lit(0.0)) + F.coalesce("z_sepsis", F.lit(0.0)),
                   F.col("z_control").isNotNull().cast("int") + F.col("z_sepsis").isNotNull().cast("int"))
    p = p.withColumns({"dz_ss": F.col("z_shock") - F.col("z_sepsis"), "dz_sothers": F.col("z_shock") - others})
    co, se = F.col("z_control"), F.col("z_sepsis")
    # Others pools control and sepsis values: moments come from both columns' sums.
    moments = lambda c, n: [F.count(c).alias(f"n_{n}"), F.avg(c).alias(f"mean_{n}"), F.var_samp(c).alias(f"var_{n}")]
    base = p.groupBy("pair_id").agg(
        F.countDistinct("study_key").alias("n_studies"),
        *moments("z_shock", "shock"), *moments("z_sepsis", "sepsis"),
        F.count(co).alias("_nc"), F.avg(co).alias("_mc"), F.var_pop(co).alias("_vc"), F.var_pop(se).alias("_vs"),
        *[f for c in ("ss", "sothers") for f in (
            F.avg(f"dz_{c}").alias(f"mean_dz_{c}"), F.stddev_samp(f"dz_{c}").alias(f"_sd_{c}"),
            F.count(f"dz_{c}").alias(f"_k_{c}"), F.count_if(F.col(f"dz_{c}") > SIGN_NOISE).alias(f"_pos_{c}"),
            F.count_if(F.col(f"dz_{c}") < -SIGN_NOISE).alias(f"_neg_{c}"))])
    n0, n1 = F.col("_nc").cast("double"), F.col("n_sepsis").cast("double")
    z0 = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    m = base.withColumn("n_others", F.col("_nc") + F.col("n_sepsis"))
    m = m.withColumn("mean_others", S.div(n0 * z0("_mc") + n1 * z0("mean_sepsis"), "n_others"))
    d0, d1 = z0("_mc") - F.col("mean_others"), z0("mean_sepsis") - F.col("mean_others")
    m = m.withColumn("var_others", S.div(
        n0 * (z0("_vc") + d0 * d0) + n1 * (z0("_vs") + d1 * d1),
        F.when(F.col("n_others") > 1, F.col("n_others") - 1)))
    for c, other in (("ss", "sepsis"), ("sothers", "others")):
        wt = welch("shock", other)
        m = m.withColumns({f"t_{c}": wt["t"], f"df_{c}": wt["df"]})
        if with_p:
            m = m.withColumn(f"p_{c}", S.student_p(f"t_{c}", f"df_{c}"))
        k, sd, mean = F.col(f"_k_{c}").cast("double"), F.col(f"_sd_{c}"), F.col(f"mean_dz_{c}")
        # Equal standard errors sd/sqrt(k): weights w = k/sd^2, so Q = w*(k-1)*sd^2 = k(k-1),
        # tau^2 = (Q-(k-1))/((k-1)w) and the pooled mean is the plain mean.
        ok = (k >= 2) & (sd > 0)
        se2 = S.div(sd * sd, k)
        q = k * (k - 1.0)
        tau2 = se2 * F.greatest(S.div(q - (k - 1.0), k - 1.0), F.lit(0.0))
        half = F.lit(S.Z_975) * F.sqrt(S.div(se2 + tau2, k))
        m = m.withColumns({
            f"abs_dz_{c}": F.abs(mean), f"kappa_{c}": sign_agreement(f"mean_dz_{c}", f"_k_{c}", f"_pos_{c}", f"_neg_{c}"),
            f"dz_{c}_ci_low": F.when(ok, mean - half), f"dz_{c}_ci_high": F.when(ok, mean + half),
            f"dz_{c}_I2": F.when(ok, F.greatest(S.div(q - (k - 1.0), q), F.lit(0.0)) * 100.0),
            f"dz_{c}_Q": F.when(ok, q)})
    cols = (["pair_id", "n_studies", "mean_dz_ss", "abs_dz_ss", "mean_dz_sothers", "abs_dz_sothers",
             "t_ss", "df_ss", "t_sothers", "df_sothers", "kappa_ss", "kappa_sothers"]
            + [f"dz_{c}_{s}" for c in ("ss", "sothers") for s in ("ci_low", "ci_high", "I2", "Q")])
    if not with_p:
        return m.select(*cols)
    m = m.select(*cols, "p_ss", "p_sothers")
    return add_fdr(materialize(m, "pooled"), {"p_ss": "q_ss", "p_sothers": "q_sothers"}, fdr)


# Default gate thresholds.
GATES = {"q_max": 0.05, "abs_dz_min": 0.40, "kappa_min": 0.7}


def pass_gates(th: dict | None = None, other: str = "sothers") -> Column:
    """All six gates hold; a missing value fails its gate."""
    th = {**GATES, **(th or {})}
    ok = F.lit(True)
    for c in ("ss", other):
        ok = (ok & (F.col(f"q_{c}") <= th["q_max"]) & (F.col(f"abs_dz_{c}") >= th["abs_dz_min"])
              & (F.col(f"kappa_{c}") >= th["kappa_min"]))
    return F.coalesce(ok, F.lit(False))


def composite_score(columns: list[str]) -> Column:
    """|dz| * log10(1/q + 1) * kappa * sqrt(auroc), auroc defaulting to 0.5."""
    auroc = F.coalesce("auroc", F.lit(0.5)) if "auroc" in columns else F.lit(0.5)
    q = S.at_least("q_ss", 1e-300)
    return (F.col("abs_dz_ss") * F.log10(S.div(F.lit(1.0), q) + 1.0)
            * F.coalesce("kappa_ss", F.lit(0.0)) * F.sqrt(auroc))
