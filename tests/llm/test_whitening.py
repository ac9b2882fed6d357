import math
import random

import numpy as np

from rhopool.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, component string, v string"


def _brute(vectors):
    """Exact sums by plain loops, then numpy's decomposition of the covariance."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n ** 3 for j in range(d)] for i in range(d)]
    values, axes = np.linalg.eigh(np.array(cov))
    order = np.argsort(-values)
    return x, n, s, values[order], axes[:, order], sum(cov[i][i] for i in range(d))


def _check(got, ids, vectors):
    x, n, s, values, axes, trace = _brute(vectors)
    k = min(8, len(s))
    assert len(got) == k * len(ids)
    of = {}
    for r in got:
        of.setdefault(r.vec_id, {})[r.component] = r
    for c in range(1, k + 1):
        want = {i: sum((row[j] - s[j] / n) * axes[j, c - 1] for j in range(len(s))) / math.sqrt(values[c - 1]) for i, row in zip(ids, x)}
        sign = 1 if of[ids[0]][c].whitened * want[ids[0]] > 0 else -1
        for i in ids:
            assert abs(of[i][c].whitened - sign * want[i]) < 1e-6
            assert abs(of[i][c].explained - values[c - 1] / trace) < 1e-9
    for i, row in zip(ids, x):
        r = of[i][1]
        assert r.n == n and int(r.deviation_exact) == sum((n * a - b) ** 2 for a, b in zip(row, s)) and r.identity_error < 1e-4


def test_whitening_equals_plain_loops(spark):
    r = random.Random(4)
    vectors = [[r.gauss(0, 0.1 * (j + 1)) for j in range(11)] for _ in range(200)]
    vectors += vectors[:20]
    rows = [(i, v, 1, "x", None) for i, v in enumerate(vectors)]
    bad = [(1000, None, 1, "x", None), (1001, [1.0, None] + [0.0] * 9, 1, "", ""), (1002, [float("nan")] * 11, 1, "", ""), (1003, [float("inf")] + [0.0] * 10, 1, "", ""),
           (1004, [], 1, "", ""), (1005, [1.0, 2.0], 1, "", ""), (1006, [3e38] + [0.0] * 10, 1, "", "")]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(3)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    _check(got, list(range(len(vectors))), vectors)
    assert all(g.deviation == int(g.deviation_exact) for g in got)


def test_scatter_is_exact_for_wide_ranges(spark):
    r = random.Random(9)
    vectors = [[r.uniform(-1e9, 1e9), r.uniform(-300, -200), r.choice([-5e5, 7e11]), r.random()] for _ in range(130)]
    df = spark.createDataFrame([(i, v, 1, "", "") for i, v in enumerate(vectors)], SCHEMA)
    m = whitening.fit(df)
    x, n, s, *_ = _brute(vectors)
    assert m.sums == s
    assert [[int(c) for c in row] for row in m.centred] == [[n * sum(a[i] * a[j] for a in x) - s[i] * s[j] for j in range(4)] for i in range(4)]
    got = {g.vec_id: g for g in whitening.whiten(df, m).where("component = 1").collect()}
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    assert all(got[i].deviation == (e if e < 2 ** 63 else None) and (e >= 10 ** 38 or int(got[i].deviation_exact) == e) for i, e in enumerate(exact))


def test_blocks_and_words_of_any_size():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 300):
        x = rng.integers(-50, 5000, (n, 5))
        planes = whitening.Planes.of(x.min(axis=0), x.max(axis=0))
        total = np.zeros((planes.limbs, 5, 6), np.int64)
        whitening.scatter(planes, planes.pack(x), total)
        y = x - x.min(axis=0)
        value = sum(total[k].astype(object) << (24 * k) for k in range(planes.limbs))
        assert (value[:, 0] == y.sum(axis=0)).all()
        assert (np.triu(value[:, 1:].astype(np.int64)) == np.triu(y.T @ y)).all()


def test_flat_and_empty_tables(spark):
    same = spark.createDataFrame([(None, [1.0, 2.0], 1, "", ""), (2, [1.0, 2.0], 1, "", "")], SCHEMA)
    got = whitening.whiten(same, whitening.fit(same)).collect()
    assert len(got) == 4 and all(g.whitened is None and g.explained is None and g.deviation == 0 and g.n == 2 for g in got)
    line = spark.createDataFrame([(k, [k * 0.5, 1.0, k * 1.0], 1, "", "") for k in range(9)], SCHEMA)
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert sum(g.whitened is not None for g in got) == 9 and all(g.identity_error < 1e-4 for g in got)
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
