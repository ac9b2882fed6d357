"""Study-wise Spearman correlation of every measured pair.

Values become one vector per (study, condition, gene).  Vectors are hashed
into blocks and each vector is replicated once per partner *block*, so the
shuffle carries genes x samples x blocks values instead of one row per
(pair, sample).  Block width shrinks as vectors get longer, which keeps a
task's input bounded for studies with very many samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.functions import stats as S
from rhopool.functions.stats import student_two_sided
from rhopool.operators.fdr import adjust
from rhopool.operators.ranks import grouped_ranks
from rhopool.session import materialize

CELLS_PER_BLOCK = 4_000_000
MAX_BLOCK_GENES = 128
# Groups with more samples than this are cut along the samples as well.
LONGEST_VECTOR = 4_000_000

_OUT = ("study_key long, condition string, gene_a_key long, gene_b_key long, "
        "rho_spearman double, p_value double, n_samples long")


def average_ranks(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Row-wise average ranks over the masked-in cells; masked-out cells get 0."""
    n = x.shape[1]
    filled = np.where(mask, x, np.inf)
    order = np.argsort(filled, axis=1, kind="stable")
    s = np.take_along_axis(filled, order, axis=1)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    idx = np.arange(n)
    start = np.maximum.accumulate(np.where(new, idx, 0), axis=1)
    last = np.ones(s.shape, bool)
    last[:, :-1] = new[:, 1:]
    end = np.minimum.accumulate(np.where(last, idx, n)[:, ::-1], axis=1)[:, ::-1]
    ranks = np.empty(s.shape)
    np.put_along_axis(ranks, order, (start + end) / 2.0 + 1.0, axis=1)
    return np.where(mask, ranks, 0.0)


def _corr_rows(ra: np.ndarray, rb: np.ndarray, mask: np.ndarray, n: np.ndarray) -> np.ndarray:
    nn = np.maximum(n, 1)[:, None]
    da = np.where(mask, ra - ra.sum(1, keepdims=True) / nn, 0.0)
    db = np.where(mask, rb - rb.sum(1, keepdims=True) / nn, 0.0)
    den = np.sqrt((da * da).sum(1) * (db * db).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((den > 0) & (n > 1), (da * db).sum(1) / den, np.nan)


def _block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    samples = pd.factorize(np.concatenate([np.asarray(s) for s in pdf["samples"]]))
    codes, n_samples = samples[0], len(samples[1])
    genes = pdf["gene_key"].to_numpy()
    blocks = pdf["block"].to_numpy()
    x = np.full((len(pdf), n_samples), np.nan)
    lengths = [len(s) for s in pdf["samples"]]
    x[np.repeat(np.arange(len(pdf)), lengths), codes] = np.concatenate(
        [np.asarray(v, float) for v in pdf["vals"]])
    mask = ~np.isnan(x)
    complete = bool(mask.all())
    full = average_ranks(x, mask) if complete else None
    lo, hi = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    out = []
    for i in np.flatnonzero(blocks == lo):
        # Within one block take each unordered pair once.
        js = np.flatnonzero(blocks == hi) if lo != hi else np.flatnonzero(genes > genes[i])
        if len(js) == 0:
            continue
        m = mask[js] & mask[i]
        n = m.sum(1)
        if complete:
            ra = np.broadcast_to(full[i], (len(js), n_samples))
            rb = full[js]
        else:
            ra = average_ranks(np.broadcast_to(x[i], m.shape), m)
            rb = average_ranks(x[js], m)
        out.append(pd.DataFrame({
            "gene_a_key": np.minimum(genes[i], genes[js]),
            "gene_b_key": np.maximum(genes[i], genes[js]),
            "rho_spearman": _corr_rows(ra, rb, m, n), "n_samples": n}))
    if not out:
        return pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])
    r = pd.concat(out, ignore_index=True)
    r = r[r["n_samples"] > 0]
    rho = np.clip(r["rho_spearman"].to_numpy(float), -1.0, 1.0)
    df = r["n_samples"].to_numpy(float) - 2.0
    with np.errstate(invalid="ignore", divide="ignore"):
        t = rho * np.sqrt(df / ((1.0 - rho) * (1.0 + rho)))
    r["rho_spearman"] = rho
    r["p_value"] = student_two_sided(t, df)
    r["study_key"] = pdf["study_key"].iloc[0]
    r["condition"] = pdf["condition"].iloc[0]
    return r[[c.split()[0] for c in _OUT.split(", ")]]


def pair_correlations(expression: DataFrame, *, cells_per_block: int = CELLS_PER_BLOCK,
                      max_block_genes: int = MAX_BLOCK_GENES, longest_vector: int = LONGEST_VECTOR) -> DataFrame:
    """(gene_key, study_key, condition, sample, value) -> one row per pair, study and condition.

    A cell given more than once counts once, as the mean of its values.
    Ranks are taken over the samples common to the pair.  rho is NULL when the
    pair has fewer than two common samples or one side is constant.  Groups
    with very many samples take a path that also cuts along the samples.
    """
    cells = expression.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "study_key", "condition", "gene_key", "sample", "value")
    # Stored once: group sizes, vectors and blocks read it, not the plan behind it.
    cells = materialize(cells.groupBy("study_key", "condition", "gene_key", "sample").agg(F.avg("value").alias("value")), "cells")
    sizes = (cells.groupBy("study_key", "condition", "gene_key").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("study_key", "condition").agg(F.max("n").alias("longest")))
    if (sizes.agg(F.max("longest")).first()[0] or 0) <= longest_vector:
        return _vector_correlations(cells, cells_per_block, max_block_genes)
    big = sizes.where(F.col("longest") > longest_vector).select("study_key", "condition", "longest")
    keys = ["study_key", "condition"]
    short = _vector_correlations(cells.join(big, keys, "left_anti"), cells_per_block, max_block_genes)
    return short.unionByName(_sampled_groups(cells.join(big, keys), max_block_genes, longest_vector))


def _rank_products(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of centred rank products for the gene pairs of two blocks over one slice of samples."""
    x = np.vstack([np.asarray(v, float) for v in pdf["ranks"]])
    genes, blocks = pdf["gene_key"].to_numpy(), pdf["block"].to_numpy()
    lo, hi = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    a, b = np.flatnonzero(blocks == lo), np.flatnonzero(blocks == hi)
    prod = x[a] @ x[b].T
    i, j = np.nonzero(genes[a][:, None] < genes[b][None, :]) if lo == hi else np.nonzero(np.ones(prod.shape, bool))
    return pd.DataFrame({"study_key": pdf["study_key"].iloc[0], "condition": pdf["condition"].iloc[0],
                         "gene_a_key": np.minimum(genes[a][i], genes[b][j]), "gene_b_key": np.maximum(genes[a][i], genes[b][j]),
                         "s": prod[i, j]})


def _sampled_groups(cells: DataFrame, max_block_genes: int, longest_vector: int) -> DataFrame:
    """Exact correlations for groups whose vectors are too long for one task.

    Genes present in every sample of the group share one ranking per gene, so
    rank products add up over slices of samples.  A pair with a gene that
    misses samples is ranked on its common samples through a join on the sample.
    """
    keys = ["study_key", "condition"]
    cells = materialize(cells, "long_cells")
    total = cells.groupBy(*keys, "sample").agg(F.max(F.lit(1)).alias("x")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    genes = cells.groupBy(*keys, "gene_key").agg(F.count(F.lit(1)).alias("k")).join(total, keys)
    genes = materialize(genes.withColumn("full", F.col("k") == F.col("n")), "long_genes")

    full = cells.join(genes.where("full").select(*keys, "gene_key", "n"), [*keys, "gene_key"])
    ranked = materialize(grouped_ranks(full, [*keys, "gene_key"], "value", "rank")
                         .withColumn("rank", F.col("rank") - (F.col("n") + 1) / 2.0), "long_ranks")
    slices = F.ceil(F.col("n") / F.lit(longest_vector)).cast("int")
    vectors = (ranked.withColumn("slice", F.pmod(F.xxhash64("sample"), slices)).groupBy(*keys, "gene_key", "slice")
               .agg(F.array_sort(F.collect_list(F.struct("sample", "rank"))).alias("c"))
               .select(*keys, "gene_key", "slice", F.col("c.rank").alias("ranks")))
    blocks = genes.where("full").groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(max_block_genes)).cast("int").alias("nblocks"))
    placed = (vectors.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("gene_key"), F.col("nblocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nblocks") - 1)))
              .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}))
    sums = (placed.groupBy(*keys, "bi", "bj", "slice").applyInPandas(
        _rank_products, "study_key long, condition string, gene_a_key long, gene_b_key long, s double")
        .groupBy(*keys, "gene_a_key", "gene_b_key").agg(F.sum("s").alias("s")))
    spread = ranked.groupBy(*keys, "gene_key").agg(F.sum(F.col("rank") * F.col("rank")).alias("q"), F.max("n").alias("n_samples"))
    side = lambda s: spread.select(*keys, F.col("gene_key").alias(f"gene_{s}_key"), F.col("q").alias(f"q{s}"),
                                   *(["n_samples"] if s == "a" else []))
    whole = sums.join(side("a"), [*keys, "gene_a_key"]).join(side("b"), [*keys, "gene_b_key"]).select(
        *keys, "gene_a_key", "gene_b_key", S.div("s", F.sqrt(F.col("qa")) * F.sqrt(F.col("qb"))).alias("rho_spearman"), "n_samples")

    tagged = cells.drop("longest").join(genes.select(*keys, "gene_key", "full"), [*keys, "gene_key"])
    a = tagged.select(*keys, "sample", F.col("gene_key").alias("gene_a_key"), F.col("value").alias("va"), F.col("full").alias("fa"))
    b = tagged.select(*keys, "sample", F.col("gene_key").alias("gene_b_key"), F.col("value").alias("vb"), F.col("full").alias("fb"))
    pair = [*keys, "gene_a_key", "gene_b_key"]
    common = a.join(b, [*keys, "sample"]).where("gene_a_key < gene_b_key and not (fa and fb)").select(*pair, "va", "vb")
    common = materialize(common, "long_pairs")
    r = grouped_ranks(grouped_ranks(common, pair, "va", "ra"), pair, "vb", "rb")
    gappy = r.groupBy(*pair).agg(
        S.div(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("rho_spearman"), F.count(F.lit(1)).alias("n_samples"))
    out = whole.unionByName(gappy)
    rho, dof = S.clip("rho_spearman", -1.0, 1.0), (F.col("n_samples") - 2).cast("double")
    t = rho * F.sqrt(S.div(dof, (F.lit(1.0) - rho) * (F.lit(1.0) + rho)))
    t = F.when(F.abs(rho) == 1.0, rho * F.lit(float("inf"))).otherwise(t)
    t = F.when(F.col("n_samples") > 2, t)
    return out.select("study_key", "condition", "gene_a_key", "gene_b_key", rho.alias("rho_spearman"),
                      S.student_p(t, dof).alias("p_value"), F.col("n_samples").cast("long").alias("n_samples"))


def _vector_correlations(expression: DataFrame, cells_per_block: int, max_block_genes: int) -> DataFrame:
    """Correlations from whole vectors, block by block."""
    vectors = (expression.groupBy("study_key", "condition", "gene_key")
               .agg(F.collect_list(F.struct("sample", "value")).alias("cells")))
    vectors = vectors.select("study_key", "condition", "gene_key",
                             F.col("cells.sample").alias("samples"), F.col("cells.value").alias("vals"))
    shape = (expression.groupBy("study_key", "condition", "gene_key").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("study_key", "condition")
             .agg(F.count(F.lit(1)).alias("genes"), F.max("n").alias("longest")))
    width = F.greatest(F.lit(1), F.least(F.lit(max_block_genes),
                                         F.floor(F.lit(cells_per_block) / F.col("longest"))))
    shape = shape.select("study_key", "condition",
                         F.ceil(F.col("genes") / width).cast("int").alias("nblocks"))
    placed = (vectors.join(shape, ["study_key", "condition"])
              .withColumn("block", F.pmod(F.xxhash64("gene_key"), F.col("nblocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nblocks") - 1)))
              .select("study_key", "condition", "gene_key", "samples", "vals", "block",
                      F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")))
    raw = placed.groupBy("study_key", "condition", "bi", "bj").applyInPandas(_block_pair, _OUT)
    nan_to_null = {c: F.when(~F.isnan(c), F.col(c)) for c in ("rho_spearman", "p_value")}
    return raw.withColumns(nan_to_null)


def gene_directions(expression: DataFrame, case: str = "sepsis", control: str = "control") -> DataFrame:
    """Mean value per gene in case and control, and Up/Down by which is larger."""
    side = lambda cond: F.avg(F.when(F.col("condition") == cond, F.col("value")))
    g = expression.groupBy("gene_key").agg(
        F.min("gene").alias("gene"), side(case).alias("expr_case"), side(control).alias("expr_ctrl"))
    return g.withColumn("direction", F.when(F.col("expr_case") > F.col("expr_ctrl"), "Up")
                        .when(F.col("expr_case").isNotNull() & F.col("expr_ctrl").isNotNull(), "Down"))


def correlation_facts(expression: DataFrame, **kw) -> DataFrame:
    """The long pair fact: correlations with names, mean expression and direction of both genes."""
    rho = pair_correlations(expression, **kw)
    g = gene_directions(expression)
    side = lambda s: g.select(F.col("gene_key").alias(f"gene_{s}_key"), F.col("gene").alias(f"gene_{s}_name"),
                              F.col("direction").alias(f"gene_{s}_direction"),
                              F.col("expr_case").alias(f"expr_{s}_case"), F.col("expr_ctrl").alias(f"expr_{s}_ctrl"))
    return rho.join(side("a"), "gene_a_key").join(side("b"), "gene_b_key").select(
        "gene_a_key", "gene_b_key", "gene_a_name", "gene_b_name", "gene_a_direction", "gene_b_direction",
        "expr_a_case", "expr_b_case", "expr_a_ctrl", "expr_b_ctrl", "condition", "study_key",
        "rho_spearman", "p_value", "n_samples")


def with_study_q(facts: DataFrame) -> DataFrame:
    """Add q_value: BH over the pairs of one study and condition."""
    return adjust(facts, "p_value", "q_value", ["study_key", "condition"])
