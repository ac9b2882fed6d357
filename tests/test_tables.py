import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhopool.functions import features as FE
from rhopool.functions import text as T
from rhopool.operators import clean as C
from rhopool.operators import rules as RU
from rhopool.operators import scaling as SC
from rhopool.operators import upsert as U
from rhopool.operators.recommend import PairAnalyzer, recommendations
from rhopool.sources import files as FI
from rhopool.sources import tables as TB


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_exact_quantiles(spark, held, monkeypatch):
    monkeypatch.setattr(SC, "HELD", held)
    rng = np.random.default_rng(5)
    cols = {"x": np.round(rng.normal(size=5000), 3), "tie": rng.choice([1.0, 2.0, 2.0, 2.0, 7.0], 5000), "wide": rng.normal(size=5000) * 10.0 ** rng.integers(-300, 300, 5000),
            "sign": rng.choice([-0.0, 0.0, -5e-324, 5e-324, np.inf, -np.inf], 5000), "gap": np.where(rng.random(5000) < 0.4, None, rng.random(5000)), "one": [3.5] + [None] * 4999, "none": [None] * 5000}
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in cols.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.731, 1.0]
    got = SC.exact_quantiles(df, list(cols), probs)
    for c, values in cols.items():
        x = np.sort(np.array([v for v in values if v is not None], float))
        if not len(x):
            assert got[c] == [None] * len(probs)
            continue
        for p, g in zip(probs, got[c]):
            pos = p * (len(x) - 1)
            a, b = x[int(pos)], x[min(int(pos) + 1, len(x) - 1)]
            assert g == pytest.approx(a if a == b or pos == int(pos) else a + (pos - int(pos)) * (b - a), rel=1e-12), (c, p)


def test_quantiles_take_as_many_jobs_for_many_columns(spark):
    df = spark.range(300).select(*[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(1, 9)])
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for cols in (["c1"], df.columns):
        spark.sparkContext.setJobGroup(f"quantiles-{len(cols)}", "")
        got = SC.exact_quantiles(df, cols, [0.1, 0.5, 0.9], stats={c: {"n": 300} for c in cols})
        jobs.append(len(tracker.getJobIdsForGroup(f"quantiles-{len(cols)}")))
        assert got[cols[-1]][1] == 149.5 * int(cols[-1][1:])
    assert jobs[0] == jobs[1] > 0


def test_aliases_and_required(spark):
    df = spark.createDataFrame([("a", "b", 0.1, 0.2)], "`Gene A` string, gene_b_name string, `P-Value SS` double, p_ss double")
    out = C.rename_aliases(df)
    assert out.columns == ["GeneAName", "GeneBName", "P-Value SS", "p_ss"]
    assert "dz_ss_mean" in C.missing_columns(out) and set(C.REQUIRED) <= set(C.add_missing(out).columns)


def test_coercion(spark):
    df = spark.createDataFrame([("1", "1", "NA"), (" 2.5", "x", "y")], "a string, b string, c string")
    out = C.coerce_columns(df, ["a", "b"])
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert [r.c for r in C.null_tokens(df, ["c"]).collect()] == [None, "y"]


def test_derived_features_names(spark):
    cols = ["dz_ss_mean", "dz_soth_mean", "p_ss", "p_soth", "dz_ss_ci_low", "dz_ss_ci_high", "dz_soth_ci_low", "dz_soth_ci_high",
            "dz_ss_I2", "dz_soth_I2", "dz_ss_z", "dz_soth_z", "n_studies_ss", "n_studies_soth", "q_ss", "q_soth"]
    df = spark.createDataFrame([tuple(float(i + j) / 20 for i in range(16)) for j in range(2)], ", ".join(f"{c} double" for c in cols))
    out = FE.derived_features(df)
    new = [c for c in out.columns if c not in cols and not c.endswith("_abs")]
    assert len(new) == 30 and all(f"{c}_abs" in out.columns for c in cols + new)
    assert out.select(*cols).collect() == df.collect()


def test_rules(spark):
    df = spark.createDataFrame([(0.01, None), (0.5, 10.0)], "p double, i2 double")
    hit = lambda cond: [r[0] for r in df.select(RU.satisfied(RU.Rule("r", cond, 0.5), df.columns)).collect()]
    assert hit("p < 0.1 and i2 is not None") == [False, False]
    assert hit("p < 0.1 or absent > 3") == [True, False]
    assert hit("max(p, 0.2) + -1 < 0 AND i2 == 10") == [False, True]
    assert hit("p < 0.1; drop table x") == [False, False] and hit("java_method(p) < 1") == [False, False]
    assert RU.problems("q < 1", ["p"]) == ["column 'q'"]
    rules = RU.add_rule(RU.AGENT_RULES, RU.Rule("mine", "p < 1", 0.1))
    with pytest.raises(ValueError):
        RU.add_rule(rules, RU.Rule("mine", "p < 1", 0.1))
    with pytest.raises(ValueError):
        RU.Rule("x", "p < 1", 1.5)
    rules = RU.remove_rule(RU.update_rule(rules, "mine", enabled=False), "Consistency")
    assert RU.summarise_rules(rules)["total_rules"] == 5 and RU.summarise_rules(rules)["enabled_rules"] == 4


def test_rule_files(spark, tmp_path):
    RU.save_rules(spark, RU.SAMPLE_RULES, str(tmp_path / "r"))
    assert RU.load_rules(spark, str(tmp_path / "r")) == RU.SAMPLE_RULES
    f = tmp_path / "rules.json"
    f.write_text(json.dumps({"rules": [{"name": "a", "condition": "p < 1", "weight": 0.2}, {"name": "b", "weight": 3}]}))
    assert [r.name for r in RU.load_rules(spark, str(f))] == ["a"]
    assert RU.load_rules(spark, str(tmp_path / "none.json")) == RU.AGENT_RULES


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, sk int")
    s = spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (3, None, 1)], "k int, name string, at int")
    once = U.upsert(t, s, ["k"], ["name"], order=["at"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 10), (2, "BB", 20), (3, None, None)]
    assert sorted(map(tuple, U.upsert(once, s, ["k"], ["name"], order=["at"]).collect())) == sorted(map(tuple, once.collect()))


def test_number_rows_is_dense(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("x"))
    got = U.number_rows(df, ["x"], "n").orderBy("x").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_text_functions(spark):
    df = spark.createDataFrame([("Septic shock 3",), ("Abnormal S7",), ("Infected_12",), (None,)], "t string")
    got = [tuple(r) for r in df.select(T.condition_of_title("t"), T.condition_of_title("t", True), T.sample_number("t")).collect()]
    assert got == [("unknown", "septic shock", 3), ("control", "control", 7), ("sepsis", "sepsis", 12), ("unknown", "unknown", None)]
    m = spark.createDataFrame([(["a: 1", "b: x 2.5e-3 y", "a: 7", "bare", "ci: [0.1, -0.2]"],)], "i array<string>").withColumn("m", T.metrics_map("i"))
    r = m.select(T.map_float("m", "a"), T.map_float("m", "b"), T.map_float("m", "bare"), T.map_interval("m", "ci")).first()
    assert r[0] == 7.0 and r[1] == 0.0025 and r[2] is None and tuple(r[3]) == (0.1, -0.2)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0.5)], "id int, name string, v double")
    for fmt in ("csv", "json", "parquet"):
        FI.write_table(df, str(tmp_path / f"t.{fmt}"), fmt)
        assert FI.read_table(spark, str(tmp_path / f"t.{fmt}"), multiline=False).select("id", "name", "v").collect() == df.collect()
    with pytest.raises(ValueError):
        FI.format_of("a.xlsx")
    nested = tmp_path / "n.json"
    nested.write_text(json.dumps([{"pair_id": "1", "stats": {"p": 0.1, "q": {"x": 2}}}]))
    flat = FI.flatten(FI.read_table(spark, str(nested)))
    assert sorted(flat.columns) == ["pair_id", "stats.p", "stats.q.x"]
    with pytest.raises(ValueError, match="mandatory"):
        FI.read_pairs(spark, str(nested))
    recs = spark.createDataFrame([(1, [1.0])], "rank int, m array<double>")
    for fmt in ("json", "csv"):
        FI.write_bundle({"summary": df, "recs": recs}, str(tmp_path / f"b{fmt}"), fmt)
        back = FI.read_bundle(spark, str(tmp_path / f"b{fmt}"), fmt)
        assert set(back) == {"summary", "recs"} and set(back["recs"].columns) == {"rank", "m"}
    prints = FI.fingerprints(spark, str(tmp_path / "t.csv"))
    assert prints.where("md5 is not null").count() == prints.count() and FI.changed_files(prints, prints).count() == 0
    assert TB.describe(df).count() == 3 and TB.fetch(df, limit=5, name="x").count() == 1


def pairs(spark, n=120):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        d1, d2 = rng.normal(-.5, .3), rng.normal(-1, .5)
        s1, s2 = rng.uniform(.1, .3), rng.uniform(.2, .4)
        p1, p2 = rng.beta(.5, 5), rng.beta(.3, 10)
        rows.append((f"g{i}_h{i}", int(rng.integers(1, 5)), int(rng.integers(3, 8)), d1, d2, d1 - 1.96 * s1, d1 + 1.96 * s1, d2 - 1.96 * s2,
                     d2 + 1.96 * s2, rng.uniform(0, 80), rng.uniform(0, 90), d1 / s1, d2 / s2, p1, p2, min(1.0, 2 * p1), min(1.0, 2 * p2),
                     abs(d1), abs(d2), f"G{i}", f"H{i}"))
    cols = ("pair_id string, n_studies_ss int, n_studies_soth int, dz_ss_mean double, dz_soth_mean double, dz_ss_ci_low double, dz_ss_ci_high double, "
            "dz_soth_ci_low double, dz_soth_ci_high double, dz_ss_I2 double, dz_soth_I2 double, dz_ss_z double, dz_soth_z double, p_ss double, "
            "p_soth double, q_ss double, q_soth double, abs_dz_ss double, abs_dz_soth double, GeneAName string, GeneBName string")
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], cols)


def test_recommendation_paths(spark):
    df = pairs(spark)
    recs, summary = recommendations(df, ("H3", "G3"), top_n=10)
    got = recs.orderBy("rank").toPandas()
    assert got["rank"].tolist() == list(range(1, 11)) and got["combined_score"].is_monotonic_decreasing
    assert got["combined_score"].between(0, 1).all() and summary.first().total_pairs == 120
    with pytest.raises(ValueError):
        recommendations(df, ("no", "pair"))
    with pytest.raises(ValueError):
        PairAnalyzer().predict(df)
    a = PairAnalyzer(control=("G3", "H3")).fit(df)
    recs, summary = a.predict(df)
    s = summary.first()
    assert recs.count() == 20 and s.total_pairs == 120 and abs(s.outliers_detected / 120 - 0.1) < 0.03
    other, _ = a.predict(df.limit(40))
    assert other.count() == 20


def test_a_large_file_of_equal_length_and_time_is_seen_as_changed(spark, tmp_path):
    import hashlib
    import os

    for name, text in (("a é b%20.bin", b"x" * 10_000_000), ("small", b"y"), ("same", b"z" * 2000)):
        (tmp_path / name).write_bytes(text)
        os.utime(tmp_path / name, (1e9, 1e9))
    before = spark.createDataFrame(FI.fingerprints(spark, str(tmp_path), limit=1000).collect())
    assert {r.md5 for r in before.collect()} == {hashlib.md5(x).hexdigest() for x in (b"x" * 10_000_000, b"y", b"z" * 2000)}
    (tmp_path / "a é b%20.bin").write_bytes(b"x" * 9_999_999 + b"w")
    os.utime(tmp_path / "a é b%20.bin", (1e9, 1e9))
    now = FI.fingerprints(spark, str(tmp_path), limit=1000)
    assert [r.path.rpartition("/")[2] for r in FI.changed_files(now, before).collect()] == ["a é b%20.bin"]
