"""Queries of the file sources and sinks: the test tables are written out, read back and compared."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.operators import clean as C
from rhopool.operators import reports as R
from rhopool.operators import rules as RU
from rhopool.plans import catalog_warehouse as CW
from rhopool.plans import etl as E
from rhopool.plans import fixtures as X
from rhopool.plans import sqltext as Q
from rhopool.plans.registry import query, r, rounded
from rhopool.session import checkpoint_root
from rhopool.sources import files as FI
from rhopool.sources import metadata as MD
from rhopool.sources import tables as TB


def _folder(spark, name: str) -> str:
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def _study_folders(df: DataFrame, root: str, write) -> None:
    """One folder for each of the few regions, named by its study code."""
    for k in sorted(x.k for x in df.select(F.col("region").alias("k")).distinct().collect()):
        write(df.where(F.col("region") == k).drop("region"), f"{root}/SRP{k}")


# --- tables ------------------------------------------------------------------------

_PAIR_COLS = ["dz_ss_mean", "dz_soth_mean", "p_ss", "abs_dz_ss"]


@query("pair_files", Q.with_(Q.metrics(), f"""SELECT fmt, pair_id, GeneAName, {', '.join(r(c, c, 5) for c in _PAIR_COLS)}
  FROM pm, (VALUES ('csv'), ('tsv'), ('json'), ('parquet')) f(fmt)"""))
def pair_files(spark, sf):
    """The pair table in four formats, each read by the format its name tells."""
    m, root = X.metrics(spark, sf).select(*C.MANDATORY), _folder(spark, "pairs")
    FI.write_table(m, f"{root}/m.csv", "csv")
    m.write.csv(f"{root}/m.tsv", sep="\t", header=True)
    m.write.json(f"{root}/m.json")
    FI.write_table(m, f"{root}/m.parquet")
    read = lambda f: FI.read_pairs(spark, f"{root}/m.{f}", multiline=False).select(
        F.lit(f).alias("fmt"), "pair_id", "GeneAName", *[F.col(c).cast("double").alias(c) for c in _PAIR_COLS])
    return rounded(reduce(DataFrame.unionByName, [read(f) for f in ("csv", "tsv", "json", "parquet")]), 5)


@query("flattened_json", """SELECT l_orderkey AS "key.order", l_linenumber AS "key.line", l_returnflag AS "state.flags.returned", l_linestatus AS "state.status" FROM lineitem""")
def flattened_json(spark, sf):
    path = _folder(spark, "nested")
    X.table(spark, sf, "lineitem").select(
        F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line")).alias("key"),
        F.struct(F.struct(F.col("l_returnflag").alias("returned")).alias("flags"), F.col("l_linestatus").alias("status")).alias("state")).write.json(path)
    d = FI.flatten(FI.read_table(spark, path, "json", multiline=False))
    return d.select(*[F.col(f"`{c}`") for c in ("key.order", "key.line", "state.flags.returned", "state.status")])


@query("table_sinks", f"""SELECT fmt, o_orderkey, o_orderpriority, {r('o_totalprice')} FROM orders, (VALUES ('csv'), ('json'), ('parquet'), ('orc')) f(fmt)""")
def table_sinks(spark, sf):
    """Orders through every sink format."""
    o, root = X.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), _folder(spark, "sinks")
    parts = []
    for fmt in ("csv", "json", "parquet", "orc"):
        FI.write_table(o, f"{root}/{fmt}", fmt)
        back = spark.read.schema(o.schema).format(fmt).options(**({"header": True} if fmt == "csv" else {})).load(f"{root}/{fmt}")
        parts.append(back.withColumn("fmt", F.lit(fmt)))
    return rounded(reduce(DataFrame.unionByName, parts).select("fmt", "o_orderkey", "o_orderpriority", "o_totalprice"))


@query("source_files", "SELECT l_returnflag AS flag, count(*) AS rows, 1 AS named FROM lineitem GROUP BY 1")
def source_files(spark, sf):
    """Rows keep the file they were read from, through a projection."""
    path = _folder(spark, "lineage")
    X.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").write.partitionBy("l_returnflag").parquet(path)
    d = C.with_source(spark.read.parquet(path).select("l_orderkey", F.col("l_returnflag").alias("flag")))
    own = F.contains("data_source", F.concat(F.lit("/l_returnflag="), "flag", F.lit("/")))
    return d.groupBy("flag").agg(F.count(F.lit(1)).alias("rows"), F.min(own.cast("int")).alias("named"))


@query("stored_sizes", """SELECT 'orders' AS "table", count(DISTINCT o_orderstatus) AS files, true AS filled FROM orders
UNION ALL SELECT 'parts', count(DISTINCT p_brand), true FROM part UNION ALL SELECT 'empty', 1, true""")
def stored_sizes(spark, sf):
    root = _folder(spark, "sizes")
    o, p = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), X.table(spark, sf, "part").select("p_partkey", "p_brand")
    o.repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(f"{root}/o")
    p.repartition("p_brand").write.partitionBy("p_brand").parquet(f"{root}/p")
    o.limit(0).coalesce(1).write.parquet(f"{root}/e")
    s = TB.stored_sizes(spark, {"orders": f"{root}/o", "parts": f"{root}/p", "empty": f"{root}/e"})
    return s.select("table", "files", (F.col("bytes") > 0).alias("filled"))


@query("study_table_rows", Q.with_(CW._SQL, """SELECT 'fact_expression' AS "table", x.study, count(*) AS rows FROM x JOIN a ON a.study = x.study AND a.accession_code = x.sample GROUP BY 2
UNION ALL SELECT 'dim_sample', study, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'dim_gene', NULL, count(DISTINCT gene) FROM x"""))
def study_table_rows(spark, sf):
    """Rows of warehouse tables for each study."""
    t = E.transform(CW.study_input(spark, sf))
    f = t["fact_expression"].join(t["dim_sample"].select("sample_key", F.col("study").alias("_s")), "sample_key").select("gene_key", F.col("_s").alias("study"))
    return TB.table_rows_by({"fact_expression": f, "dim_sample": t["dim_sample"], "dim_gene": t["dim_gene"]}, "study")


@query("pair_values", Q.with_(CW._SQL, f"""SELECT x.study, row_number() OVER (ORDER BY x.study, x.sample) AS nr, {CW._ILL.replace('rf', 'any_value(a.rf)')} AS sample_classification,
  {r("max(value) FILTER (gene = 'Brand#11')", 'expr_a')}, {r("max(value) FILTER (gene = 'Brand#12')", 'expr_b')}
  FROM x JOIN a ON a.study = x.study AND a.accession_code = x.sample WHERE gene IN ('Brand#11', 'Brand#12') GROUP BY x.study, x.sample"""))
def pair_values(spark, sf):
    """Two genes' values by sample, from the fact and its sample dimension."""
    t = E.transform(CW.study_input(spark, sf))
    key = {x.gene_symbol: x.gene_key for x in t["dim_gene"].where("gene_symbol in ('Brand#11', 'Brand#12')").select("gene_symbol", "gene_key").collect()}
    d = R.pair_values(t["fact_expression"], t["dim_sample"], key.get("Brand#11", -1), key.get("Brand#12", -1))
    d = CW.E.number_rows(d, ["sample_key"], "nr")
    return rounded(d.select("study", F.col("nr").cast("long").alias("nr"), "sample_classification", *[F.col(c).cast("double").alias(c) for c in ("expr_a", "expr_b")]))


# --- studies -----------------------------------------------------------------------

_SAMPLES = """SELECT 'SRP' || n_regionkey AS study, 'SRR' || s_suppkey AS sample, s_name AS title, CASE WHEN s_acctbal > 0 THEN 'HOMO_SAPIENS' END AS organism
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _suppliers(spark, sf) -> DataFrame:
    n = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    return X.table(spark, sf, "supplier").join(n, "s_nationkey").select(
        "region", F.concat(F.lit("SRR"), "s_suppkey").alias("sample"), F.col("s_name").alias("title"), F.when(F.col("s_acctbal") > 0, "HOMO_SAPIENS").alias("organism"))


def _documents(spark, sf) -> DataFrame:
    """Metadata documents of the regions; the samples lie at the top, under the study, or inside the experiment."""
    s = _suppliers(spark, sf).withColumn("study", F.concat(F.lit("SRP"), "region"))
    entry = F.struct("sample", F.struct("title", "organism", F.col("study").alias("experiment_accession_code")))
    d = s.groupBy("region", "study").agg(F.map_from_entries(F.collect_list(entry)).alias("all"))
    title = F.to_json(F.create_map(F.lit("title"), F.concat(F.lit("study of "), "study")))
    of = lambda body: F.concat(F.lit('{"experiments":{"'), "study", F.lit('":'), body)
    inside = F.concat(F.lit('{"title":"study of '), "study", F.lit('","samples":'), F.to_json("all"), F.lit("}"))
    text = (F.when(F.col("region") % 3 == 0, F.concat(of(title), F.lit('},"samples":'), F.to_json("all"), F.lit("}")))
            .when(F.col("region") % 3 == 1, F.concat(of(title), F.lit('},"samples":{"'), "study", F.lit('":'), F.to_json("all"), F.lit("}}")))
            .otherwise(F.concat(of(inside), F.lit("}}"))))
    root = _folder(spark, "documents")
    _study_folders(d.select("region", text.alias("value")), root, lambda one, path: one.coalesce(1).write.text(path))
    return MD.read_documents(spark, f"{root}/*/*.txt")


@query("metadata_samples", _SAMPLES)
def metadata_samples(spark, sf):
    """Samples of documents nested in three ways."""
    return MD.attributes(MD.samples(_documents(spark, sf)), ["study", "sample"], "title", "organism")


@query("metadata_experiments", "SELECT DISTINCT 'SRP' || n_regionkey AS study, 'study of SRP' || n_regionkey AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def metadata_experiments(spark, sf):
    return MD.attributes(MD.experiments(_documents(spark, sf)), ["study"], "title")


@query("annotation_files", f"""WITH s AS ({_SAMPLES}) SELECT study, sample, title, organism FROM s""")
def annotation_files(spark, sf):
    """Tab-separated annotations of each study, with prefixed names, spaces and spelled nulls."""
    root = _folder(spark, "annotations")
    s = _suppliers(spark, sf).select("region", F.col("sample").alias(" MetaSRA_sample"), F.col("title").alias("MetaSRA_title "), F.coalesce("organism", F.lit("N/A")).alias("MetaSRA_organism"))
    _study_folders(s, root, lambda one, path: one.write.csv(path, sep="\t", header=True))
    return FI.read_annotations(spark, f"{root}/*/*.csv", "MetaSRA_").select("study", "sample", "title", "organism")


@query("matrix_files", f"""WITH {CW._SQL}, k AS (SELECT DISTINCT study, sample FROM x), g AS (SELECT DISTINCT study, gene FROM x)
SELECT g.study, g.gene, k.sample, round(any_value(x.value), 6) + 0.0 AS value FROM g JOIN k ON k.study = g.study LEFT JOIN x ON x.study = g.study AND x.gene = g.gene AND x.sample = k.sample GROUP BY ALL""")
def matrix_files(spark, sf):
    """Expression matrices of the studies, each with its own columns, over several files."""
    x = CW.study_input(spark, sf).expression.withColumn("region", F.substring("study", 4, 9).cast("int"))
    root = _folder(spark, "matrices")
    _study_folders(x.drop("study"), root, lambda one, path: one.groupBy("gene").pivot("sample").agg(F.max("value")).write.csv(path, sep="\t", header=True))
    return rounded(FI.read_matrix(spark, f"{root}/*/*.csv", width=50).withColumn("value", F.col("value").cast("double")))


@query("discovered_studies", "SELECT DISTINCT 'SRP' || n_regionkey AS study FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'GSE' || (100 + r_regionkey) FROM region")
def discovered_studies(spark, sf):
    """Study codes of folders and of documents."""
    root = _folder(spark, "studies")
    _study_folders(_suppliers(spark, sf).select("region", "sample"), root, lambda one, path: one.coalesce(1).write.text(path))
    code = F.concat(F.lit("GSE"), F.col("r_regionkey") + 100)
    docs = X.table(spark, sf, "region").select(F.create_map(code, F.lit("x"), F.lit("not a study"), F.lit("y")).alias("experiments"))
    return FI.discover_studies(spark, root, docs)


@query("file_fingerprints", """SELECT c_nationkey AS nation, md5(string_agg(c_custkey || chr(10), '' ORDER BY c_custkey)) AS md5, CAST(sum(length(c_custkey || chr(10))) AS BIGINT) AS length FROM customer GROUP BY 1""")
def file_fingerprints(spark, sf):
    """One file for each nation; half of the hashes are taken in chunks."""
    path = _folder(spark, "prints")
    c = X.table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    (c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", F.col("c_custkey").cast("string").alias("value"))
     .write.partitionBy("c_nationkey").text(path))
    f = FI.fingerprints(spark, path, limit=X.table(spark, sf, "customer").count() // 10)
    return f.select(F.regexp_extract("path", "c_nationkey=(\\d+)", 1).cast("int").alias("nation"), "md5", F.col("length").cast("long").alias("length"))


# --- results -----------------------------------------------------------------------

_RECS = """rc AS (SELECT p_partkey::VARCHAR AS pair_id, p_brand AS gene_a, p_type AS gene_b, p_retailprice / 10000 AS combined_score, p_size / 50.0 AS rules_score,
  (p_partkey % 10) / 10.0 AS ml_confidence, p_size > 25 AS is_high_confidence, p_partkey % 7 = 0 AS is_outlier, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey::VARCHAR) AS rank,
  p_size / 100.0 AS p_ss, p_size / 200.0 AS p_soth, p_partkey % 5 - 2.0 AS e1, p_partkey % 3 - 1.0 AS e2 FROM part)"""


def _recs(spark, sf) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    d = X.table(spark, sf, "part").select(
        k.cast("string").alias("pair_id"), F.col("p_brand").alias("gene_a"), F.col("p_type").alias("gene_b"), (F.col("p_retailprice") / 10000).alias("combined_score"),
        (size / 50.0).alias("rules_score"), (k % 10 / 10.0).alias("ml_confidence"), (size > 25).alias("is_high_confidence"), (k % 7 == 0).alias("is_outlier"),
        F.struct((size / 100.0).alias("p_ss"), (size / 200.0).alias("p_soth"), (k % 5 - 2.0).alias("dz_ss_mean"), (k % 3 - 1.0).alias("dz_soth_mean")).alias("statistical_measures"),
        (-F.col("p_retailprice")).alias("_down"))
    return CW.E.number_rows(d, ["_down", "pair_id"], "rank").drop("_down")


_FLAT = f"""rank AS "Rank", gene_a AS "Gene_A", gene_b AS "Gene_B", {r('combined_score', 'Combined_Score')}, {r('rules_score', 'Rules_Score')}, {r('ml_confidence', 'ML_Confidence')},
  is_high_confidence AS "High_Confidence", is_outlier AS "Outlier", {r('p_ss', 'P_Value_SS')}, {r('p_soth', 'P_Value_SOTH')}, {r('e1', 'Effect_Size_SS')}, {r('e2', 'Effect_Size_SOTH')}"""


@query("flat_recommendations", Q.with_(_RECS, f"SELECT {_FLAT} FROM rc"))
def flat_recommendations(spark, sf):
    return rounded(R.flat_recommendations(_recs(spark, sf)))


@query("recommendation_totals", Q.with_(_RECS, f"""SELECT count(*) AS total_recommendations, count(*) FILTER (is_high_confidence) AS high_confidence_pairs, count(*) FILTER (is_outlier) AS outlier_pairs,
  {r('avg(combined_score)', 'avg_combined_score')}, {r('avg(rules_score)', 'avg_rules_score')}, {r('avg(ml_confidence)', 'avg_ml_confidence')} FROM rc"""))
def recommendation_totals(spark, sf):
    return rounded(R.recommendation_metrics(_recs(spark, sf)))


@query("chart_ranking", Q.with_(_RECS, f"SELECT rank, gene_a || '-' || gene_b AS pair, {r('combined_score')}, {r('rules_score')}, {r('ml_confidence')} FROM rc WHERE rank <= 20"))
def chart_ranking(spark, sf):
    return rounded(R.ranking_rows(_recs(spark, sf)))


_LABELS = "lb AS (SELECT CASE WHEN l_quantity > 40 THEN -1 ELSE 1 END AS a, CASE WHEN l_linenumber > 5 THEN -1 ELSE l_linenumber END AS c, CASE WHEN l_returnflag <> 'R' THEN l_suppkey % 3 END AS g FROM lineitem)"


@query("chart_clusters", Q.with_(_LABELS, """SELECT method, CAST(label AS BIGINT) AS label, count(*) AS size FROM (SELECT 'anomaly_label' AS method, a AS label FROM lb UNION ALL SELECT 'cluster_label', c FROM lb
UNION ALL SELECT 'gmm_label', g FROM lb WHERE g IS NOT NULL) GROUP BY 1, 2"""))
def chart_clusters(spark, sf):
    li = X.table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") > 40, -1).otherwise(1).alias("anomaly_label"), F.when(F.col("l_linenumber") > 5, -1).otherwise(F.col("l_linenumber")).alias("cluster_label"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey") % 3).alias("gmm_label"))
    return R.label_sizes(li, R.METHODS)


@query("report_bundle", Q.with_(f"{_RECS}, {Q.metrics()}, ef AS (SELECT count(*) FILTER (isfinite(dz_ss_mean) AND isfinite(dz_soth_mean)) AS n FROM pm)", """SELECT 'metadata' AS "table", 1 AS rows, NULL::DOUBLE AS score FROM ef
UNION ALL SELECT 'summary', 1, round(avg(combined_score), 6) + 0.0 FROM rc
UNION ALL SELECT 'top_recommendations', least(15, count(*)), round((SELECT sum(combined_score) FROM rc WHERE rank <= 15), 6) + 0.0 FROM rc
UNION ALL SELECT 'export_records', count(*), round(sum(combined_score), 6) + 0.0 FROM rc
UNION ALL SELECT 'export_columns', 72, NULL UNION ALL SELECT 'chart_effect_scatter', n, NULL FROM ef
UNION ALL SELECT 'chart_ranking', least(20, count(*)), round((SELECT sum(combined_score) FROM rc WHERE rank <= 20), 6) + 0.0 FROM rc"""))
def report_bundle(spark, sf):
    """A whole report written as JSON and read back: rows and sums of each of its tables."""
    m, recs, path = X.metrics(spark, sf), _recs(spark, sf), _folder(spark, "report")
    charts = {"effect_scatter": R.scatter_rows(m), "ranking": R.ranking_rows(recs)}
    summary = m.agg(F.count(F.lit(1)).alias("total_pairs"))
    FI.write_bundle(R.report_tables(m, recs, summary, "s-1", charts, 15), path)
    score = {"summary": "avg_combined_score", "top_recommendations": "combined_score", "export_records": "Combined_Score", "chart_ranking": "combined_score"}
    back = FI.read_bundle(spark, path)
    parts = [d.agg(F.count(F.lit(1)).alias("rows"), (F.sum(score[n]) if n in score else F.lit(None).cast("double")).alias("score")).select(F.lit(n).alias("table"), "rows", "score")
             for n, d in back.items()]
    return rounded(reduce(DataFrame.unionByName, parts))


_FINDINGS = "SELECT o_orderkey, o_orderpriority AS study, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'metric' END AS level, o_totalprice AS value FROM orders"


@query("run_report", f"""SELECT 'text' AS form, upper(level) || '  ' || study || '  order ' || o_orderkey || '  ' || CAST(CAST(value AS BIGINT) AS VARCHAR) AS line FROM ({_FINDINGS})
UNION ALL SELECT 'json', level || '|' || study || '|order ' || o_orderkey || '|' || CAST(CAST(value AS BIGINT) AS VARCHAR) FROM ({_FINDINGS})""".replace("CAST(value AS BIGINT)", "CAST(round(value) AS BIGINT)"))
def run_report(spark, sf):
    """Findings as text lines and as JSON rows, read back."""
    path = _folder(spark, "findings")
    level = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning").otherwise("metric")
    FI.write_report(X.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("study"), F.concat(F.lit("order "), "o_orderkey").alias("check"), level.alias("level"), F.round("o_totalprice").cast("long").alias("value")), path)
    text = spark.read.text(f"{path}/text").select(F.lit("text").alias("form"), F.col("value").alias("line"))
    rows = spark.read.json(f"{path}/json").select(F.lit("json").alias("form"), F.concat_ws("|", "level", "study", "check", "value").alias("line"))
    return text.unionByName(rows)


@query("stored_rules", Q.with_(Q.metrics(), f"SELECT pair_id, {r('(CASE WHEN p_ss < 0.5 THEN 0.5 ELSE 0 END + CASE WHEN abs_dz_ss > 0.1 THEN 0.25 ELSE 0 END) / 0.75', 'rules_score')} FROM pm"))
def stored_rules(spark, sf):
    """Rules saved, loaded with an invalid one among them, and applied."""
    path = _folder(spark, "rules")
    RU.save_rules(spark, [RU.Rule("p", "p_ss < 0.5", 0.5, "small p"), RU.Rule("e", "abs_dz_ss > 0.1", 0.25, "effect"), RU.Rule("off", "p_ss < 2", 0.25, "unused", False)], path)
    spark.createDataFrame([('{"name": "broken", "weight": 1}',)], "value string").write.mode("append").text(path)
    return rounded(RU.apply_rules(X.metrics(spark, sf), RU.load_rules(spark, path)).select("pair_id", "rules_score"))
