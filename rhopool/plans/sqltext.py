"""SQL statements of the shared inputs, written independently of the DataFrame code.

Heterogeneity uses squared deviations, FDR uses plain global windows, ranks use
a sample-level self-join: the textbook forms, fine at check scale.
"""

from __future__ import annotations

from rhopool.functions.stats import SQRT_2PI, TAIL_DEN, TAIL_NUM, TAIL_SPLIT, TAIL_ZERO, Z_975


def _poly(coef, x):
    acc = repr(coef[0])
    for c in coef[1:]:
        acc = f"({acc})*{x}+{c!r}"
    return f"({acc})"


def tail(a: str) -> str:
    """Upper normal tail for a >= 0."""
    cf = f"({a}+1/({a}+2/({a}+3/({a}+4/({a}+0.65)))))"
    return (f"CASE WHEN {a} > {TAIL_ZERO} THEN 0.0 WHEN {a} < {TAIL_SPLIT} THEN "
            f"exp(-{a}*{a}/2)*{_poly(TAIL_NUM, a)}/{_poly(TAIL_DEN, a)} "
            f"ELSE exp(-{a}*{a}/2)/{cf}/{SQRT_2PI} END")


def two_sided(z: str) -> str:
    return f"2*({tail(f'abs({z})')})"


EXPR = """
expr AS MATERIALIZED (
  SELECT CAST(substr(p_brand, 7) AS BIGINT) AS gene_key, p_brand AS gene, CAST(n_regionkey AS BIGINT) AS study_key,
         CASE l_returnflag WHEN 'R' THEN 'septic shock' WHEN 'N' THEN 'sepsis' ELSE 'control' END AS condition,
         strftime(l_shipdate, '%Y-%m') AS sample, avg(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3, 4, 5)"""

CORR = EXPR + """,
common AS (
  SELECT a.gene_key AS ka, b.gene_key AS kb, a.study_key, a.condition, a.value AS va, b.value AS vb
  FROM expr a JOIN expr b ON a.study_key = b.study_key AND a.condition = b.condition AND a.sample = b.sample
       AND a.gene_key < b.gene_key),
ranked AS (
  SELECT ka, kb, study_key, condition,
         rank() OVER (PARTITION BY ka, kb, study_key, condition ORDER BY va)
           + (count(*) OVER (PARTITION BY ka, kb, study_key, condition, va) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY ka, kb, study_key, condition ORDER BY vb)
           + (count(*) OVER (PARTITION BY ka, kb, study_key, condition, vb) - 1) / 2.0 AS rb
  FROM common),
direction AS (
  SELECT gene_key, min(gene) AS gene, avg(value) FILTER (condition = 'sepsis') AS xcase,
         avg(value) FILTER (condition = 'control') AS xctrl FROM expr GROUP BY gene_key),
dir AS (SELECT *, CASE WHEN xcase > xctrl THEN 'Up' WHEN xcase IS NOT NULL AND xctrl IS NOT NULL THEN 'Down' END AS d
        FROM direction),
rho AS (
  SELECT ka, kb, study_key, condition, count(*) AS n_samples,
         covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS rho_spearman
  FROM ranked GROUP BY 1, 2, 3, 4),
corr AS MATERIALIZED (
  SELECT ka AS gene_a_key, kb AS gene_b_key, a.gene AS gene_a_name, b.gene AS gene_b_name,
         a.d AS gene_a_direction, b.d AS gene_b_direction, a.xcase AS expr_a_case, b.xcase AS expr_b_case,
         a.xctrl AS expr_a_ctrl, b.xctrl AS expr_b_ctrl, condition, study_key, rho_spearman, n_samples,
         concat(ka, '_', kb) AS pair_id
  FROM rho JOIN dir a ON a.gene_key = ka JOIN dir b ON b.gene_key = kb)"""

ZROWS = CORR + """,
zr AS MATERIALIZED (
  SELECT *, CASE WHEN rho_spearman IS NOT NULL THEN 0.5 * ln((1 + least(greatest(rho_spearman, -0.999999), 0.999999))
                     / (1 - least(greatest(rho_spearman, -0.999999), 0.999999))) END AS z,
         CASE WHEN n_samples > 3 THEN CAST(n_samples - 3 AS DOUBLE) END AS ne FROM corr)"""


def contrasts(missing: str = "drop") -> str:
    """per-study contrasts CTE ``ps``."""
    base = ZROWS + """,
usable AS (SELECT pair_id, study_key, condition, %s AS z, %s AS ne FROM zr),
pv AS (
  SELECT pair_id, study_key,
         max(z) FILTER (condition = 'septic shock') AS z_shock, max(z) FILTER (condition = 'sepsis') AS z_sepsis,
         max(z) FILTER (condition = 'control') AS z_control,
         max(ne) FILTER (condition = 'septic shock') AS ne_shock, max(ne) FILTER (condition = 'sepsis') AS ne_sepsis,
         max(ne) FILTER (condition = 'control') AS ne_control
  FROM usable GROUP BY 1, 2)""" % (("CASE WHEN ne IS NOT NULL THEN z END", "CASE WHEN z IS NOT NULL THEN ne END")
                                   if missing == "drop" else ("z", "ne"))
    if missing == "drop":
        return base + """,
ps AS MATERIALIZED (
  SELECT *, z_shock - z_sepsis AS dz_ss, sqrt(1 / ne_shock + 1 / ne_sepsis) AS se_ss,
         z_shock - (coalesce(ne_control, 0) * coalesce(z_control, 0) + coalesce(ne_sepsis, 0) * coalesce(z_sepsis, 0))
                   / nullif(coalesce(ne_control, 0) + coalesce(ne_sepsis, 0), 0) AS dz_soth,
         sqrt(1 / ne_shock + 1 / nullif(coalesce(ne_control, 0) + coalesce(ne_sepsis, 0), 0)) AS se_soth
  FROM pv)"""
    return base + """,
pz AS (SELECT pair_id, study_key, coalesce(z_shock, 0) AS z_shock, coalesce(z_sepsis, 0) AS z_sepsis,
              coalesce(z_control, 0) AS z_control, coalesce(ne_shock, 0) AS ne_shock,
              coalesce(ne_sepsis, 0) AS ne_sepsis, coalesce(ne_control, 0) AS ne_control FROM pv),
ps AS MATERIALIZED (
  SELECT *, z_shock - z_sepsis AS dz_ss,
         sqrt(coalesce(1 / nullif(ne_shock, 0), 0) + coalesce(1 / nullif(ne_sepsis, 0), 0)) AS se_ss,
         z_shock - coalesce((ne_control * z_control + ne_sepsis * z_sepsis) / nullif(ne_control + ne_sepsis, 0), 0) AS dz_soth,
         sqrt(coalesce(1 / nullif(ne_shock, 0), 0) + coalesce(1 / nullif(ne_control + ne_sepsis, 0), 0)) AS se_soth
  FROM pz)"""


def pooled(missing: str = "drop") -> str:
    """random-effects CTE ``re`` per (pair, series)."""
    return contrasts(missing) + f""",
series AS (
  SELECT pair_id, 'ss' AS series, dz_ss AS x, se_ss AS se FROM ps UNION ALL
  SELECT pair_id, 'soth', dz_soth, se_soth FROM ps UNION ALL
  SELECT pair_id, 'control', z_control, 1 / sqrt(nullif(ne_control, 0)) FROM ps UNION ALL
  SELECT pair_id, 'sepsis', z_sepsis, 1 / sqrt(nullif(ne_sepsis, 0)) FROM ps UNION ALL
  SELECT pair_id, 'septic shock', z_shock, 1 / sqrt(nullif(ne_shock, 0)) FROM ps),
wx AS (SELECT *, CASE WHEN se > 0 THEN 1 / (se * se) END AS w FROM series WHERE x IS NOT NULL),
fixed AS (SELECT pair_id, series, count(w) AS k, sum(w) AS sw, sum(w * w) AS sw2,
                 sum(w * x) / sum(w) AS mu, count(x) AS n_effects FROM wx GROUP BY 1, 2),
het AS (SELECT wx.pair_id, wx.series, sum(w * (x - mu) * (x - mu)) AS q
        FROM wx JOIN fixed USING (pair_id, series) GROUP BY 1, 2),
tau AS (SELECT f.*, q, CASE WHEN k > 1 THEN coalesce(greatest(0, (q - (k - 1)) / nullif(sw - sw2 / sw, 0)), 0)
                            WHEN k = 1 THEN 0 END AS tau2
        FROM fixed f JOIN het USING (pair_id, series)),
rand AS (SELECT wx.pair_id, wx.series, sum(x / (1 / w + tau2)) / sum(1 / (1 / w + tau2)) AS mean,
                sqrt(1 / sum(1 / (1 / w + tau2))) AS se
         FROM wx JOIN tau USING (pair_id, series) WHERE w IS NOT NULL GROUP BY 1, 2),
signs AS (SELECT wx.pair_id, wx.series, CASE WHEN max(abs(mean)) > 1e-12 THEN avg(CASE WHEN sign(round(x, 12)) = sign(mean) THEN 1.0 ELSE 0.0 END) END AS kappa
          FROM wx JOIN rand USING (pair_id, series) GROUP BY 1, 2),
re0 AS (SELECT t.pair_id, t.series, k, n_effects, mean, se, mean - {Z_975} * se AS ci_low, mean + {Z_975} * se AS ci_high,
               CASE WHEN k >= 1 THEN q END AS q,
               CASE WHEN q > 0 AND k > 1 THEN greatest(0, (q - (k - 1)) / q) * 100 WHEN k >= 1 THEN 0 END AS i2,
               tau2, mean / nullif(se, 0) AS z, kappa
        FROM tau t LEFT JOIN rand USING (pair_id, series) LEFT JOIN signs USING (pair_id, series)),
re AS MATERIALIZED (SELECT *, {two_sided('z')} AS p FROM re0)"""


def bh(source: str, p: str, q: str, mode: str = "standard", keys: str = "") -> str:
    """SELECT adding BH q for p; ties take the last rank."""
    part = f"PARTITION BY {keys}" if keys else ""
    v = (f"SELECT *, {p} * count({p}) OVER ({part}) / count({p}) OVER ({part} ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS _v "
         f"FROM {source}")
    frame = (f"ORDER BY {p} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING" if mode == "standard"
             else f"ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    nn = f"{p} IS NOT NULL"
    sep = ", " if keys else ""
    part2 = f"PARTITION BY {keys}{sep}{nn}"
    return (f"SELECT * EXCLUDE (_v), CASE WHEN {nn} THEN least(1.0, min(_v) OVER ({part2} {frame})) END AS {q} "
            f"FROM ({v})")


def _pick(series, col, name):
    return f"max({col}) FILTER (series = '{series}') AS {name}"


def metrics(missing: str = "drop", fdr: str = "standard") -> str:
    """the pair metrics CTE ``pm``."""
    picks = []
    for c in ("ss", "soth"):
        for src, name in (("n_effects", f"n_studies_{c}"), ("mean", f"dz_{c}_mean"), ("se", f"dz_{c}_se"),
                          ("ci_low", f"dz_{c}_ci_low"), ("ci_high", f"dz_{c}_ci_high"), ("q", f"dz_{c}_Q"),
                          ("i2", f"dz_{c}_I2"), ("z", f"dz_{c}_z"), ("p", f"p_{c}"), ("kappa", f"kappa_{c}")):
            picks.append(_pick(c, src, name))
    groups = [("control", "control"), ("sepsis", "sepsis"), ("septic shock", "septic_shock")]
    for g, u in groups:
        picks += [_pick(g, "tanh(mean)", f"{u}_weighted_r"), _pick(g, "se * (1 - tanh(mean) * tanh(mean))", f"{u}_se_r"),
                  _pick(g, "i2", f"{u}_I2"), _pick(g, "z", f"{u}_z_stat"), _pick(g, "p", f"{u}_p_value")]
    deltas = []
    for tag, a, b in (("shock_control", "septic_shock", "control"), ("shock_sepsis", "septic_shock", "sepsis"),
                      ("sepsis_control", "sepsis", "control")):
        se = f"sqrt({a}_se_r * {a}_se_r + {b}_se_r * {b}_se_r)"
        d = f"({a}_weighted_r - {b}_weighted_r)"
        deltas += [f"{d} AS delta_r_{tag}", f"{se} AS se_diff_{tag}", f"{d} / nullif({se}, 0) AS z_diff_{tag}"]
    r3 = [f"{u}_weighted_r" for _, u in groups]
    a3 = [f"abs({x})" for x in r3]
    mean3 = f"(({' + '.join(a3)}) / 3)"
    sd3 = f"sqrt(({' + '.join(f'({x} - {mean3}) * ({x} - {mean3})' for x in a3)}) / 3)"
    cz2 = " + ".join(f"{u}_z_stat * {u}_z_stat" for _, u in groups)
    i2sum = " + ".join(f"{u}_I2" for _, u in groups)
    return pooled(missing) + f""",
wide AS (SELECT pair_id, {', '.join(picks)} FROM re GROUP BY pair_id),
pairs AS (SELECT pair_id, min(gene_a_name) AS GeneAName, min(gene_b_name) AS GeneBName, min(gene_a_key) AS GeneAKey,
                 min(gene_b_key) AS GeneBKey, min(expr_a_case) AS ac, min(expr_a_ctrl) AS aq, min(expr_b_case) AS bc,
                 min(expr_b_ctrl) AS bq,
                 CAST(coalesce(sum(n_samples) FILTER (condition = 'control'), 0) AS BIGINT) AS control_n_samples,
                 CAST(coalesce(sum(n_samples) FILTER (condition = 'sepsis'), 0) AS BIGINT) AS sepsis_n_samples,
                 CAST(coalesce(sum(n_samples) FILTER (condition = 'septic shock'), 0) AS BIGINT) AS septic_shock_n_samples
          FROM corr GROUP BY pair_id),
m1 AS (SELECT wide.*, pairs.* EXCLUDE (pair_id, ac, aq, bc, bq), abs(dz_ss_mean) AS abs_dz_ss, abs(dz_soth_mean) AS abs_dz_soth,
              control_n_samples + sepsis_n_samples + septic_shock_n_samples AS total_samples,
              {', '.join(deltas)},
              log2((abs(ac) + 1e-10) / (abs(aq) + 1e-10)) AS geneA_log2fc,
              log2((abs(bc) + 1e-10) / (abs(bq) + 1e-10)) AS geneB_log2fc,
              sqrt({' * '.join(f'{u}_p_value' for _, u in groups)}) AS combined_p_value,
              sqrt({' * '.join(a3)}) AS combined_effect_size, sqrt({cz2}) AS combined_z_score,
              1 / (1 + ({i2sum}) / 300) AS consistency_score,
              CASE WHEN {' + '.join(r3)} IS NOT NULL THEN CASE WHEN {' AND '.join(f'{x} < -1e-12' for x in r3)} OR {' AND '.join(f'{x} >= -1e-12' for x in r3)}
                   THEN 1.0 ELSE 0.0 END END AS direction_consistency,
              CASE WHEN {mean3} > 0 THEN greatest(0, 1 - {sd3} / ({mean3} + 1e-10)) END AS magnitude_consistency
       FROM wide JOIN pairs USING (pair_id)),
m2 AS (SELECT *, {', '.join(f"{two_sided(f'z_diff_{t}')} AS p_diff_{t}" for t in ('shock_control', 'shock_sepsis', 'sepsis_control'))},
              CASE WHEN total_samples > 0 THEN combined_z_score * combined_z_score
                   / (combined_z_score * combined_z_score + total_samples) END AS power_score,
              sqrt(geneA_log2fc * geneA_log2fc + geneB_log2fc * geneB_log2fc) AS expression_change_magnitude,
              CASE WHEN geneA_log2fc + geneB_log2fc IS NOT NULL THEN greatest(abs(geneA_log2fc), abs(geneB_log2fc)) END AS expression_asymmetry
       FROM m1),
m3 AS ({bh('m2', 'p_ss', 'q_ss', fdr)}),
m4 AS ({bh('m3', 'p_soth', 'q_soth', fdr)}),
pm AS MATERIALIZED (
  SELECT *, coalesce(abs_dz_ss, 0) * log10(1 / CASE WHEN q_ss IS NOT NULL THEN least(greatest(q_ss, 1e-300), 1) END + 1) * coalesce(kappa_ss, 0)
     + 0.25 * (coalesce(abs_dz_soth, 0) * log10(1 / CASE WHEN q_soth IS NOT NULL THEN least(greatest(q_soth, 1e-300), 1) END + 1) * coalesce(kappa_soth, 0)) AS rank_score
  FROM m4)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
