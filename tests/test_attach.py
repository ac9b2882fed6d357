import pytest
from pyspark.sql import functions as F

from rhopool.operators.attach import attach
from rhopool.operators.fdr import adjust
from rhopool.operators.ranks import grouped_ranks
from rhopool.sources import files as FI


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle only and all partitions as they fall."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "8")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _loads(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_hot_values_and_nulls_are_spread(spark, shuffled):
    # Half of the rows hold p = 1, a quarter none.
    d = spark.range(0, 40_000, 1, 16).select("id", F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 2 == 1, 1.0).otherwise(F.col("id") / 80_000.0).alias("p"))
    out = adjust(d, "p", "q")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    loads = _loads(out)
    assert sum(loads) == 40_000 and len(loads) == 8 and loads[-1] <= 2 * loads[len(loads) // 2]
    p = sorted(r.p for r in d.where("p is not null").collect())
    m, best, want = len(p), 1.0, {}
    for k in range(m, 0, -1):
        best = min(best, p[k - 1] * m / k)
        want.setdefault(p[k - 1], best)
    for r in out.collect():
        assert (r.q is None) if r.p is None else r.q == pytest.approx(want[r.p], rel=1e-12)


def test_attach_edges(spark):
    d = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, None, 2.0), (4, "b", 5.0), (4, "b", 5.0)], "id int, g string, v double")
    values = spark.createDataFrame([("a", 2.0, 10, 1), ("b", 5.0, 20, 2), ("c", 1.0, 30, 0)], "g string, w double, q int, n long")
    got = attach(d, values, {"g": "g", "v": "w"}, "q", "n")
    assert got.columns == ["id", "g", "v", "q"]
    assert sorted([(r.id, r.q) for r in got.collect()], key=repr) == [(1, 10), (2, None), (3, None), (4, 20), (4, 20)]
    # The column may exist, or be the key itself; no values, no rows.
    assert sorted(r.v or 0 for r in attach(d, values.withColumnRenamed("q", "v"), {"g": "g"}, "v", "n").collect()) == [0, 10, 10, 20, 20]
    assert [r.q for r in attach(d, values.limit(0), {"g": "g"}, "q", "n").collect()] == [None] * 5
    assert attach(d.limit(0), values, {"g": "g"}, "q", "n").count() == 0


def test_ranks_with_one_hot_value(spark, shuffled):
    d = spark.range(0, 3_000, 1, 6).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    pdf = d.toPandas()
    pdf["want"] = pdf.groupby("g")["v"].rank()
    got = grouped_ranks(d, ["g"], "v", "r").toPandas()
    assert sorted(zip(got.g, got.v, got.r)) == sorted(zip(pdf.g, pdf.v, pdf.want))


@pytest.mark.parametrize("width", [1, 2, 3, 1024])
def test_matrix_ranges(spark, tmp_path, width):
    texts = {"GSE1": "\ts1\ts2\ts3\ts4\ts5\nA\t1\t2\t3\t4\t5\nB\t1\nC\t1\t\t3\t4\t5\t6\t7\n", "GSE2": "\tx1\nA\t9\n\t8\n", "GSE3": "\n", "GSE4": "gene\nA\t1\n"}
    for study, text in texts.items():
        (tmp_path / study).mkdir()
        (tmp_path / study / "matrix.tsv").write_text(text)
    got = {(r.study, r.gene, r.sample): r.value for r in FI.read_matrix(spark, f"{tmp_path}/*/matrix.tsv", width).collect()}
    want = {("GSE1", "A", f"s{i}"): str(i) for i in range(1, 6)} | {("GSE1", "B", f"s{i}"): "1" if i == 1 else None for i in range(1, 6)}
    want |= {("GSE1", "C", f"s{i}"): None if i == 2 else str(i) for i in range(1, 6)} | {("GSE2", "A", "x1"): "9"}
    assert got == want


def test_matrix_over_many_splits(spark, tmp_path, shuffled):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        (tmp_path / "GSE7").mkdir()
        names = [f"s{i}" for i in range(50)]
        (tmp_path / "GSE7" / "m.tsv").write_text("\t".join(["", *names]) + "\n" + "".join(
            "\t".join([f"g{k}", *[str(k * 50 + i) for i in range(50)]]) + "\n" for k in range(400)))
        got = FI.read_matrix(spark, f"{tmp_path}/GSE7/m.tsv", 16)
        assert got.count() == 20_000 and got.select("gene", "sample").distinct().count() == 20_000
        assert got.where("cast(value as int) <> cast(substring(gene, 2) as int) * 50 + cast(substring(sample, 2) as int)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
