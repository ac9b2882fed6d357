import numpy as np
import pytest

from rhopool.operators import density as D
from rhopool.operators import forest as FO
from rhopool.operators import mixture as MX
from rhopool.operators import neighbours as N


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    # Two blobs, scattered points and a group of 40 copies.
    return np.round(np.vstack([rng.normal(0, .3, (90, 2)), rng.normal(4, .3, (80, 2)), rng.uniform(-3, 7, (30, 2)),
                               np.tile([[1.0, 1.0]], (40, 1))]), 6)


@pytest.fixture(scope="module")
def points(spark, cloud):
    return spark.createDataFrame([(f"p{i:04d}", [float(a) for a in r]) for i, r in enumerate(cloud)], "id string, v array<double>")


def dist(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def brute_dbscan(d, eps, ms):
    near = d <= eps
    core = near.sum(1) >= ms
    lab, c = np.full(len(d), -1), 0
    for i in range(len(d)):
        if core[i] and lab[i] < 0:
            todo, lab[i] = [i], c
            while todo:
                u = todo.pop()
                for v in np.flatnonzero(near[u] & core):
                    if lab[v] < 0:
                        lab[v] = c
                        todo.append(v)
            c += 1
    for i in np.flatnonzero(~core):
        nb = [lab[j] for j in np.flatnonzero(near[i] & core)]
        lab[i] = min(nb) if nb else -1
    return lab, core


@pytest.mark.parametrize("block", [None, 30])
def test_dbscan(points, cloud, block):
    got = D.dbscan(points, 0.5, 5, block=block).toPandas().set_index("id").sort_index()
    lab, core = brute_dbscan(dist(cloud), 0.5, 5)
    assert (got["is_core"].to_numpy() == core).all() and (got["cluster_label"].to_numpy() == lab).all()


def test_dbscan_cosine(spark):
    v = [[1.0, 0.01 * i] for i in range(6)] + [[0.01 * i, 3.0] for i in range(6)] + [[-1.0, -1.0], [0.0, 0.0]]
    pts = spark.createDataFrame([(f"{i:02d}", x) for i, x in enumerate(v)], "id string, v array<double>")
    got = D.dbscan(pts, 0.05, 5, "cosine").orderBy("id").toPandas()["cluster_label"].tolist()
    assert got == [0] * 6 + [1] * 6 + [-1, -1]


@pytest.mark.parametrize("block", [None, 30])
def test_lof(points, cloud, block):
    got = N.local_outlier_factor(points, 20, block).toPandas().set_index("id").sort_index()["lof"].to_numpy()
    d = dist(cloud)
    np.fill_diagonal(d, np.inf)
    idx = np.argsort(d, axis=1, kind="stable")[:, :20]
    near = np.take_along_axis(d, idx, 1)
    lrd = 1 / (np.maximum(near[:, -1][idx], near).mean(1) + 1e-10)
    assert got == pytest.approx(lrd[idx].mean(1) / lrd, rel=1e-6)


def test_cluster_quality(spark, points, cloud):
    lab, _ = brute_dbscan(dist(cloud), 0.5, 5)
    labels = spark.createDataFrame([(f"p{i:04d}", int(l)) for i, l in enumerate(lab)], "id string, cluster_label int")
    d, s = dist(cloud), []
    for i in range(len(cloud)):
        own = lab == lab[i]
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][lab == l].mean() for l in set(lab) if l != lab[i])
        s.append((b - a) / max(a, b))
    assert N.silhouette(points, labels, block=30).first().silhouette == pytest.approx(np.mean(s), abs=1e-9)
    g, ks = cloud.mean(0), sorted(set(lab))
    between = sum((lab == l).sum() * ((cloud[lab == l].mean(0) - g) ** 2).sum() for l in ks)
    within = sum(((cloud[lab == l] - cloud[lab == l].mean(0)) ** 2).sum() for l in ks)
    want = (between / (len(ks) - 1)) / (within / (len(cloud) - len(ks)))
    assert N.calinski_harabasz(points, labels).first().calinski_harabasz == pytest.approx(want)


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n) if i != 29], "a string, b string")
    got = {r.node: r.label for r in D.connected_components(edges).collect()}
    assert len(got) == n + 1 and {got[k] for k in got if k <= "029"} == {"000"} and {got[k] for k in got if k > "029"} == {"030"}


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (400, 3)), [[9, 9, 9], [-8, 9, 7]]])
    pts = spark.createDataFrame([(f"{i:03d}", [float(a) for a in r]) for i, r in enumerate(x)], "id string, v array<double>")
    forest = FO.IsolationForest().fit(pts)
    s = FO.flag_outliers(forest.score(pts), 0.05).toPandas().sort_values("isolation_score")
    assert set(s["id"].tail(2)) == {"400", "401"} and s["isolation_score"].between(0, 1).all()
    assert abs(s["is_outlier"].mean() - 0.05) < 0.01
    again = FO.IsolationForest().fit(pts).score(pts).toPandas().sort_values("isolation_score")
    assert again["isolation_score"].tolist() == s["isolation_score"].tolist()
    with pytest.raises(ValueError):
        FO.IsolationForest().score(pts)


def test_mixture_kmeans_pca(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.2, (60, 2)) for c in (0, 5, 10)])
    pts = spark.createDataFrame([(f"{i:03d}", [float(a) for a in r]) for i, r in enumerate(x)], "id string, v array<double>")
    km = MX.kmeans_distance(pts, 3).toPandas()
    assert km["kmeans_label"].nunique() == 3 and km["center_distance"].max() < 2
    gm = MX.mixture(pts).toPandas()
    assert gm["gmm_confidence"].between(0.3, 1 + 1e-9).all()
    df = spark.createDataFrame([(f"{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "pair_id string, a double, b double")
    pc = MX.PrincipalComponents(2).fit(df, ["a", "b"])
    got = pc.transform(df).select("pc_1", "pc_2").toPandas().to_numpy()
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u * s), abs=1e-6)
    assert pc.ratio == pytest.approx(s**2 / (s**2).sum()) and got.mean(0) == pytest.approx([0, 0], abs=1e-9)
    assert pc.loadings(spark).count() == 4 and pc.summary(spark).count() == 2
