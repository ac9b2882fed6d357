"""Tiles compared by estimates: bounds of the estimates, few pairs measured, blocks that don't multiply."""
import numpy as np
import pyarrow as pa
import pytest

from rhopool.operators import density as D
from rhopool.operators import forest as FO
from rhopool.operators import neighbours as N
from rhopool.operators import points as P


def _clouds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 7))
    far = x.copy()
    far[5] *= 1e6
    return {"plain": x, "offset": x + 1e6, "one far out": far, "copies nearly": np.repeat(x[:30], 10, 0) + rng.normal(size=(300, 7)) * 1e-9,
            "tiny": x * 1e-25, "constant": np.ones((300, 7))}


def _bounds_hold(metric, x):
    a, b = x[:140], x[140:]
    d, got = P.distances(a, b, metric), P.estimate(a, b, metric)
    for u in (0.0, *np.quantile(d, [0, .01, .3, 1]), np.inf):
        assert (got.e <= got.allow(np.full(len(a), u))[:, None])[d <= u].all()
        assert (d <= u)[got.e <= got.sure(u)].all()
    assert (d <= got.most(got.e)).all()
    i, j = np.divmod(np.arange(d.size), len(b))
    assert (P.pair_distances(a[i], b[j], metric) == d.ravel()).all()


@pytest.mark.parametrize("name", list(_clouds()))
def test_estimates_are_bounds(name):
    _bounds_hold("euclidean", _clouds()[name])


@pytest.mark.parametrize("name", list(_clouds()))
def test_manhattan_estimates_are_bounds(name):
    _bounds_hold("manhattan", _clouds()[name])


def test_few_pairs_are_measured_in_manhattan(monkeypatch):
    assert _measured_share(monkeypatch, "manhattan") < 0.1


def test_no_estimate_of_huge_numbers():
    assert P.estimate(np.full((2, 2), 1e200), np.zeros((2, 2)), "euclidean") is None


def _measured_share(monkeypatch, metric):
    rng = np.random.default_rng(4)
    n, pairs = 3000, []
    x = rng.normal(size=(n, 24))
    measure = P.pair_distances
    monkeypatch.setattr(P, "pair_distances", lambda a, b, m: pairs.append(len(a)) or measure(a, b, m))
    table = pa.table({"num": np.arange(1, n + 1), "v": list(x), "w": np.ones(n), "cell": np.zeros(n, "i4"), "blk": np.zeros(n, "i4"),
                      "bi": np.zeros(n, "i4"), "bj": np.zeros(n, "i4"), "u": np.full(n, np.inf)})
    got = N._knn_kernel(10, metric, np.zeros((1, 1)))(table).to_pandas().set_index("num")
    d = P.distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :10]
    assert (np.vstack(got["n"]) == order + 1).all() and (np.vstack(got["d"]) == np.take_along_axis(d, order, 1)).all()
    return sum(pairs) / n ** 2


def test_few_pairs_are_measured(monkeypatch):
    assert _measured_share(monkeypatch, "euclidean") < 0.1


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_lof_of_several_blocks(spark, metric):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(3000, 3)), 2)
    x[2900:] = x[0]
    pts = spark.createDataFrame([(f"{i:05d}", r.tolist()) for i, r in enumerate(x)], "id string, v array<double>")
    cells = P.make_cells(pts, None, metric=metric)
    assert 1 < cells.last_block.max() + 1 <= 3 and cells.points.agg({"blk": "max"}).first()[0] <= cells.last_block.max()
    got = N.local_outlier_factor(pts, 20, metric=metric).toPandas().set_index("id").sort_index()["lof"].to_numpy()
    # Every copy counts; of others at one distance the first ids do, a point's copies at the place of its first.
    d = P.distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    first = np.unique(x, axis=0, return_index=True, return_inverse=True)
    rep = first[1][first[2].ravel()]
    idx = np.vstack([np.lexsort((np.arange(3000), rep, row))[:20] for row in d])
    near = np.take_along_axis(d, idx, 1)
    lrd = 1 / (np.maximum(near[:, -1][idx], near).mean(1) + 1e-10)
    assert got == pytest.approx(lrd[idx].mean(1) / lrd, rel=1e-6)


def test_blocks_stay_few(spark):
    pts = spark.range(30000).selectExpr("cast(id as string) id", "array(cast(id as double), rand(1)) v")
    assert P.make_cells(pts, None).last_block.max() + 1 <= 20


def test_silhouette_sums_by_tiles(monkeypatch, spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 6)) + 1e4
    x[:40] = x[0]
    x[40:80] = x[40] + rng.normal(size=(40, 6)) * 1e-7
    lab = rng.integers(0, 4, 1500)
    calls = []
    monkeypatch.setattr(N, "distances", lambda *a: calls.append(a) or P.distances(*a))
    got = N._tile_distances(x[:700], x[700:])
    assert got == pytest.approx(P.distances(x[:700], x[700:]), rel=1e-9) and not calls
    assert N._tile_distances(x[:80], x[:80]) == pytest.approx(P.distances(x[:80], x[:80]), rel=1e-9, abs=0)
    monkeypatch.undo()
    pts = spark.createDataFrame([(f"{i:05d}", r.tolist()) for i, r in enumerate(x)], "id string, v array<double>")
    labels = spark.createDataFrame([(f"{i:05d}", int(l)) for i, l in enumerate(lab)], "id string, cluster_label int")
    d = P.distances(x, x)
    sums, size = np.stack([d[:, lab == l].sum(1) for l in range(4)], 1), np.bincount(lab)
    a = sums[np.arange(1500), lab] / (size[lab] - 1)
    b = np.where(np.arange(4) == lab[:, None], np.inf, sums / size).min(1)
    for block in (None, 400):
        out = N.silhouette(pts, labels, block=block).first()
        assert out.n_labels == 4 and out.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-9)


def test_silhouette_takes_missing_labels_as_nothing(spark):
    pts = spark.createDataFrame([(str(i), [float(x)]) for i, x in enumerate([0, 1, 10, 11, 5])], "id string, v array<double>")
    labels = spark.createDataFrame([("0", 0), ("1", 0), ("2", 1), ("3", 1), ("4", None)], "id string, cluster_label int")
    want = 2 * (9.5 / 10.5 + 8.5 / 9.5) / 5
    assert N.silhouette(pts, labels).first().silhouette == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_near_pairs_are_exact_and_few_are_measured(monkeypatch, metric):
    rng, count = np.random.default_rng(9), []
    x = np.round(np.vstack([rng.normal(size=(2500, 12)), rng.normal(size=(500, 12)) * 0.05 + 3]), 3)
    measure = P.pair_distances
    monkeypatch.setattr(P, "pair_distances", lambda a, b, m: count.append(len(a)) or measure(a, b, m))
    rows = P.Rows(pa.table({"v": list(x), "cell": np.zeros(len(x), "i4"), "num": np.arange(len(x))}))
    d = P.distances(x, x, metric)
    eps = float(np.sort(d.ravel())[600000])
    got = np.zeros(d.shape, bool)
    for i, j, both in D._near_pairs(rows, rows, True, eps, metric, np.zeros((1, 1))):
        got[i, j] = True
        if not both:
            got[j, i] = True
    assert (got == (d <= eps)).all() and sum(count) < 0.01 * d.size


def test_dbscan_of_several_blocks(spark):
    rng = np.random.default_rng(10)
    x = np.round(np.vstack([rng.uniform(0, 30, (2600, 2)), rng.normal(12, .4, (900, 2))]), 2)
    x[:6] = [-50, -50]
    pts = spark.createDataFrame([(f"{i:05d}", r.tolist()) for i, r in enumerate(x)], "id string, v array<double>")
    near = P.distances(x, x) <= 0.5
    core, label = near.sum(1) >= 5, np.full(len(x), -1)
    root = D._roots(len(x), *np.nonzero(near & core[:, None] & core))
    names = {r: k for k, r in enumerate(sorted(set(root[core])))}
    for i in range(len(x)):
        of = [names[root[j]] for j in (np.flatnonzero(near[i] & core) if not core[i] else [i])]
        label[i] = min(of, default=-1)
    got = D.dbscan(pts, 0.5, 5).toPandas().set_index("id").sort_index()
    assert got["is_core"].tolist() == core.tolist() and got["cluster_label"].tolist() == label.tolist()


def test_trees_are_sent_their_subsample_only(monkeypatch, spark):
    pts = spark.range(3000).selectExpr("cast(id as string) id", "array(cast(id % 7 as double), rand(1), rand(2)) v")
    sizes = []
    group = type(pts.groupBy("id"))
    apply = group.applyInPandas

    def seen(self, fn, schema):
        sizes.extend(r["count"] for r in self.count().collect())
        return apply(self, fn, schema)

    monkeypatch.setattr(group, "applyInPandas", seen)
    forest = FO.IsolationForest(trees=20, subsample=64).fit(pts)
    assert forest.psi == 64 and len(forest.forest) == 20 and sizes == [64] * 20
