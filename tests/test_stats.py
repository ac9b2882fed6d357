import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhopool.functions import stats as S


def test_two_sided_p_matches_erfc(spark):
    z = [x / 8 for x in range(-96, 97)]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", S.two_sided_p("z").alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-7, abs=1e-15)


def test_quantile_inverts_the_tail(spark):
    ps = [1.0, 0.5, 0.05, 1e-3, 1e-10, 1e-40]
    df = spark.createDataFrame([(p, e) for p in ps for e in (1.0, -1.0)] + [(0.0, 1.0), (None, 1.0)], "p double, e double")
    for r in S.add_signed_z(df, "p", "e", "z").collect():
        if not r.p:
            assert r.z == 0.0
        else:
            want = 0.0 if r.p == 1.0 else -NormalDist().inv_cdf(r.p / 2)
            assert abs(r.z) == pytest.approx(want, rel=1e-9, abs=1e-9)
            assert r.z * r.e >= 0


def test_student_p():
    # Closed forms: df 1 is Cauchy, df 2 is algebraic; large df approaches the normal.
    t = np.array([0.0, 0.5, 1.0, 3.0, 12.0])
    assert S.student_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * np.arctan(t), abs=1e-12)
    assert S.student_two_sided(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-12)
    assert S.student_two_sided([1.96], 1e7)[0] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6)
    assert np.isnan(S.student_two_sided([1.0, np.nan], [0.0, 3.0])).all()
    assert S.student_two_sided([np.inf], [4])[0] == 0.0


def test_guarded_arithmetic(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    got = [tuple(r) for r in df.select(S.safe_ratio("a", "b"), S.div("a", "b"), S.inverse_or_zero("b")).collect()]
    assert got == [(1000.0, None, 0.0), (-1000.0, None, 0.0), (0.0, None, 0.0), (1.5, 1.5, 0.5), (None, None, 1.0)]
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)], "x double")
    assert [r[0] for r in bad.select(S.finite("x")).collect()] == [None, None, None, 2.0]


def test_fisher_and_effective_n(spark):
    r = spark.createDataFrame([(1.0, 3), (0.5, 10), (None, None)], "r double, n long").select(
        S.fisher_z("r"), S.effective_n("n")).collect()
    assert r[0][0] == pytest.approx(math.atanh(0.999999)) and r[0][1] is None
    assert r[1][0] == pytest.approx(math.atanh(0.5)) and r[1][1] == 7.0
    assert r[2] == (None, None)
