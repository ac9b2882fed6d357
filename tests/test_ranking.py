import random

import numpy as np
import pytest

from rhopool.operators import ranking as RK
from rhopool.operators.consensus import consensus_distribution
from rhopool.operators.neighbours import local_outlier_factor
from rhopool.operators.points import mahalanobis_points


def _pairs(rows):
    c = d = ta = tb = tc = 0
    for i in range(len(rows)):
        for j in range(i):
            (a, b), (x, y) = rows[i], rows[j]
            ta += a == x
            tb += b == y
            tc += a == x and b == y
            s = (a - x) * (b - y)
            c += s > 0
            d += s < 0
    return c, d, ta, tb, tc


@pytest.mark.parametrize("range_rows", [1_000_000, 40, 7])
def test_kendall_equals_counting_pairs(spark, range_rows):
    r = random.Random(range_rows)
    rows = [(float(r.randrange(12)), float(r.choice([3, 3, 3, r.randrange(30)]))) for _ in range(260)]
    rows += [(r.random(), 5.0) for _ in range(60)]
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None), (float("nan"), 1.0)], "a double, b double")
    got = RK.kendall_tau(df, "a", "b", range_rows).first()
    assert (got.n, *(int(x) for x in got[1:6])) == (len(rows), *_pairs(rows))
    c, d, ta, tb, _ = _pairs(rows)
    n0 = len(rows) * (len(rows) - 1) / 2
    assert abs(got.tau_b - (c - d) / ((n0 - ta) * (n0 - tb)) ** 0.5) < 1e-12


def test_kendall_of_constant_and_empty_columns(spark):
    assert RK.kendall_tau(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first().tau_b is None
    none = RK.kendall_tau(spark.createDataFrame([], "a double, b double"), "a", "b").first()
    assert none.n == 0 and none.tau_b is None


def test_inversions_with_large_weights_are_exact():
    w = np.array([10 ** 12, 10 ** 13, 3], np.int64)
    assert RK.inversions(np.array([3.0, 2.0, 1.0]), w) == 10 ** 25 + 3 * 10 ** 12 + 3 * 10 ** 13


def test_ranking_quality(spark):
    df = spark.createDataFrame([(k, float(s), rel) for k, s, rel in [(1, 5, True), (2, 5, False), (3, 9, False), (4, 1, True)]] + [(5, None, True)], "k int, s double, r boolean")
    p = {r.k: r.precision for r in RK.precision_at(df, "s", df.r, [1, 2, 10], "k").collect()}
    assert p == {1: 0.0, 2: 0.5, 10: 0.6}
    assert RK.reciprocal_rank(df, "s", df.r, "k").first()[0] == 0.5
    assert RK.reciprocal_rank(df, "s", df.k == 99, "k").first()[0] == 0.0


def test_mahalanobis_equals_the_formula(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").repartition(3)
    y = {r.id: np.array(r.v) for r in mahalanobis_points(df).collect()}
    inverse = np.linalg.inv(np.cov(x.T, bias=True))
    for i in range(0, 60, 7):
        for j in range(0, 60, 11):
            assert abs(np.linalg.norm(y[str(i)] - y[str(j)]) - np.sqrt((x[i] - x[j]) @ inverse @ (x[i] - x[j]))) < 1e-8
    flat = spark.createDataFrame([(str(i), [float(v[0]), 2 * float(v[0])]) for i, v in enumerate(x)], "id string, v array<double>")
    z = np.array([r.v for r in mahalanobis_points(flat).orderBy("id").collect()])
    assert np.isfinite(z).all() and abs(z.var(axis=0).sum() - 1) < 1e-6
    assert local_outlier_factor(df, 5, metric="mahalanobis").count() == 60


def test_distribution_equals_the_matrix(spark):
    r = random.Random(3)
    rows = [tuple(r.choice([-1, 0, 1, 2]) for _ in range(3)) for _ in range(70)]
    got = {x.agreement: int(x.cells) for x in consensus_distribution(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"]).collect()}
    want = {k: 0 for k in range(4)}
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            want[0 if i == j else sum(p == q != -1 for p, q in zip(x, y))] += 1
    assert got == want
