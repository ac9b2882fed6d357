import numpy as np
import pandas as pd
import pytest

from rhopool.operators.spearman import average_ranks, gene_directions, pair_correlations


def test_average_ranks():
    x = np.array([[3.0, 1.0, 3.0, 2.0, 9.0]])
    assert average_ranks(x, np.array([[True, True, True, True, False]])).tolist() == [[3.5, 1.0, 3.5, 2.0, 0.0]]


@pytest.mark.parametrize("cells,missing,longest", [(4_000_000, 0.0, 4_000_000), (4_000_000, 0.3, 4_000_000), (60, 0.3, 4_000_000),
                                                   (60, 0.0, 10), (60, 0.02, 10)])
def test_against_pandas(spark, cells, missing, longest):
    rng = np.random.default_rng(3)
    rows = []
    for study in (1, 2):
        for g in range(9):
            for s in range(30):
                if rng.uniform() >= missing:
                    rows.append((g, f"G{g}", study, "sepsis" if study == 1 else "control", f"s{s}", float(rng.integers(0, 12))))
    rows += [(50, "flat", 1, "sepsis", f"s{s}", 1.0) for s in range(5)] + [(51, "alone", 1, "sepsis", "elsewhere", 1.0)]
    df = spark.createDataFrame(rows, "gene_key long, gene string, study_key long, condition string, sample string, value double")
    got = {(r.study_key, r.gene_a_key, r.gene_b_key): r for r in pair_correlations(
        df, cells_per_block=cells, max_block_genes=4, longest_vector=longest).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "n", "study", "c", "s", "v"])
    seen = 0
    for study in (1, 2):
        wide = pdf[pdf.study == study].pivot(index="s", columns="g", values="v")
        for a in wide.columns:
            for b in wide.columns:
                if a < b:
                    both = wide[[a, b]].dropna()
                    if len(both) == 0:
                        assert (study, a, b) not in got
                        continue
                    seen += 1
                    r = got[(study, a, b)]
                    assert r.n_samples == len(both)
                    ranks = both.rank()
                    if len(both) < 2 or ranks[a].std() == 0 or ranks[b].std() == 0:
                        assert r.rho_spearman is None
                    else:
                        assert r.rho_spearman == pytest.approx(np.corrcoef(ranks[a], ranks[b])[0, 1], abs=1e-12)
    assert seen == len(got)


@pytest.mark.parametrize("longest", [4_000_000, 10])
def test_repeated_cells_count_once_as_their_mean(spark, longest):
    rng = np.random.default_rng(4)
    schema = "gene_key long, study_key long, condition string, sample string, value double"
    rows = [(g, 1, "sepsis", f"s{s}", float(rng.integers(0, 9))) for g in range(4) for s in range(20) if g < 3 or s]
    again = [(g, k, c, s, v + 5.0) for g, k, c, s, v in rows[::6]]
    plain = pd.DataFrame(rows + again, columns=list("gkcsv")).groupby(["g", "k", "c", "s"], as_index=False).v.mean()
    out = [sorted((r.gene_a_key, r.gene_b_key, r.n_samples, round(r.rho_spearman, 9)) for r in pair_correlations(
        spark.createDataFrame(x, schema), max_block_genes=2, longest_vector=longest).collect()) for x in (rows + again, plain.values.tolist())]
    assert len(out[0]) == 6 and out[0] == out[1] and {n for _, _, n, _ in out[0]} == {19, 20}


def test_directions(spark):
    df = spark.createDataFrame([(1, "A", "sepsis", 3.0), (1, "A", "control", 1.0), (2, "B", "sepsis", 1.0), (2, "B", "control", 1.0),
                                (3, "C", "sepsis", 1.0)], "gene_key long, gene string, condition string, value double")
    assert {r.gene: r.direction for r in gene_directions(df).collect()} == {"A": "Up", "B": "Down", "C": None}
