"""Queries of the warehouse layer over study inputs derived from the test tables."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from rhopool.operators.quality import quality_score, validate_studies
from rhopool.plans import etl as E
from rhopool.plans import fixtures as X
from rhopool.plans.registry import query, r, rounded
from rhopool.session import checkpoint_root, materialize_once

_SQL = """x AS MATERIALIZED (SELECT 'SRP' || n_regionkey AS study, p_brand AS gene, 'SRR' || strftime(l_shipdate, '%Y%m') || ascii(l_returnflag) AS sample,
  l_returnflag AS rf, strftime(l_shipdate, '%Y%m') AS ym, avg(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT DISTINCT study, sample, rf, ym FROM x),
a AS (SELECT study, sample AS accession_code, CASE rf WHEN 'R' THEN 'Infected sample ' || ym WHEN 'N' THEN 'Healthy s' || ym ELSE 'other (' || ym || ')' END AS title,
        rf, CASE WHEN ym >= '1999' THEN 'HOMO_SAPIENS' END AS organism FROM s WHERE ym < '2001')"""


def study_input(spark, sf) -> E.StudyInput:
    # Real studies arrive as files; the derived matrix is stored once so every dimension reads it, not its joins.
    stored = materialize_once(spark, (sf,), "expression", lambda: X.expression_long(spark, sf))
    x = (stored.withColumn("rf", F.expr(
            "case condition when 'septic shock' then 'R' when 'sepsis' then 'N' else 'A' end"))
         .withColumn("ym", F.replace("sample", F.lit("-"), F.lit("")))
         .select(F.concat(F.lit("SRP"), "study_key").alias("study"), "gene",
                 F.concat(F.lit("SRR"), "ym", F.ascii("rf")).alias("sample"), "rf", "ym", "value"))
    s = x.select("study", "sample", "rf", "ym").distinct()
    title = F.when(F.col("rf") == "R", F.concat(F.lit("Infected sample "), "ym")).when(
        F.col("rf") == "N", F.concat(F.lit("Healthy s"), "ym")).otherwise(F.concat(F.lit("other ("), "ym", F.lit(")")))
    a = s.where("ym < '2001'").select(
        "study", F.col("sample").alias("accession_code"), F.col("study").alias("experiment_accession_code"), title.alias("title"),
        F.when(F.col("ym") >= "1999", "HOMO_SAPIENS").alias("organism"), F.when(F.col("rf") == "R", "True").otherwise("no").alias("processed"))
    j = s.select("study", "sample", F.col("sample").alias("accession_code"), F.lit("HOMO_SAPIENS").alias("organism"),
                 F.concat(F.when(F.col("rf") == "R", "Illumina ").otherwise("GeneChip affy "), F.substring("ym", 1, 4)).alias("platform_name"),
                 F.col("ym").alias("processor_version"))
    e = X.table(spark, sf, "region").select(
        F.concat(F.lit("SRP"), "r_regionkey").alias("study"), F.concat(F.lit("SRP"), "r_regionkey").alias("accession_code"),
        F.col("r_name").alias("title"), F.lit("HOMO_SAPIENS").alias("organism"), F.lit("rna-seq").alias("technology"),
        F.lit("2020-02-0").alias("d"), F.concat(F.lit("2020-02-0"), F.col("r_regionkey") + 1).alias("source_first_published"))
    return E.StudyInput(e.drop("d"), j, a, x.select("study", "gene", "sample", "value"))


@query("dim_study", """SELECT row_number() OVER (ORDER BY r_regionkey) AS study_key, 'SRP' || r_regionkey AS accession_code, r_name AS title,
  'RNA-SEQ' AS technology, '2020-02-0' || (r_regionkey + 1) AS published FROM region""")
def dim_study(spark, sf):
    d = E.dim_study(study_input(spark, sf).experiments)
    return d.select("study_key", "accession_code", "title", "technology", F.date_format("source_first_published", "yyyy-MM-dd").alias("published"))


@query("dim_platform", f"""WITH {_SQL}, p AS (SELECT CASE rf WHEN 'R' THEN 'Illumina ' ELSE 'GeneChip affy ' END || substr(ym, 1, 4) AS platform_name, arg_min(ym, study || sample) AS processor_version FROM s GROUP BY 1)
SELECT platform_name, processor_version, CASE WHEN starts_with(platform_name, 'I') THEN 'ILLUMINA' ELSE 'AFFYMETRIX' END AS platform_type, row_number() OVER (ORDER BY platform_name) AS platform_key FROM p""")
def dim_platform(spark, sf):
    return E.dim_platform(study_input(spark, sf).samples).select("platform_name", "processor_version", "platform_type", "platform_key")


_ILL = "CASE rf WHEN 'R' THEN 'sepsis' WHEN 'N' THEN 'control' ELSE 'unknown' END"


@query("dim_illness", f"""WITH {_SQL} SELECT i AS illness_type, row_number() OVER (ORDER BY i) AS illness_key FROM (SELECT DISTINCT {_ILL} AS i FROM a)""")
def dim_illness(spark, sf):
    return E.dim_illness(study_input(spark, sf).annotations).select("illness_type", "illness_key")


@query("dim_sample", f"""WITH {_SQL} SELECT study, accession_code, coalesce(organism, 'HOMO_SAPIENS') AS organism, {_ILL} AS sample_classification,
  rf = 'R' AS processed, CAST(regexp_extract(title, '(\\d+)', 1) AS BIGINT) AS sample_number, row_number() OVER (ORDER BY study, accession_code) AS sample_key FROM a""")
def dim_sample(spark, sf):
    d = study_input(spark, sf)
    return E.dim_sample(d.annotations, d.samples).select("study", "accession_code", "organism", "sample_classification", "processed", "sample_number", "sample_key")


@query("dim_gene", f"""WITH {_SQL} SELECT gene AS gene_symbol, row_number() OVER (ORDER BY gene) AS gene_key, 'protein_coding' AS gene_type, false AS valid_symbol FROM (SELECT DISTINCT gene FROM x)""")
def dim_gene(spark, sf):
    return E.dim_gene(study_input(spark, sf).expression).select("gene_symbol", "gene_key", "gene_type", "valid_symbol")


@query("fact_expression", f"""WITH {_SQL}, ds AS (SELECT study, accession_code, row_number() OVER (ORDER BY study, accession_code) AS sample_key FROM a),
dg AS (SELECT gene, row_number() OVER (ORDER BY gene) AS gene_key FROM (SELECT DISTINCT gene FROM x))
SELECT sample_key, gene_key, {r('value', 'expression_value', 5)} FROM x JOIN ds ON ds.study = x.study AND accession_code = sample JOIN dg ON dg.gene = x.gene""")
def fact_expression(spark, sf):
    return rounded(E.transform(study_input(spark, sf))["fact_expression"], 5)


@query("unmapped_keys", f"""WITH {_SQL} SELECT 'sample' AS kind, count(DISTINCT (study, sample)) AS unmapped FROM x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.study = x.study AND accession_code = sample) UNION ALL SELECT 'gene', 0""")
def unmapped_keys(spark, sf):
    d = study_input(spark, sf)
    return E.unmapped(d, E.transform(d))


@query("study_validation", f"""WITH {_SQL}, m AS (SELECT study, count(DISTINCT gene) AS g, count(DISTINCT sample) AS n FROM x GROUP BY 1),
o AS (SELECT s.study, count(*) AS u, count(a.accession_code) AS b FROM s LEFT JOIN a ON a.study = s.study AND a.accession_code = s.sample GROUP BY 1)
SELECT 'SRP' || r_regionkey AS study, 'technology' AS "check", 'warning' AS level, 1.0 AS value FROM region
UNION ALL SELECT study, 'json samples', 'metric', count(*) FROM s GROUP BY 1
UNION ALL SELECT study, 'annotation rows', 'metric', count(*) FROM a GROUP BY 1
UNION ALL SELECT study, 'expression genes', 'metric', g FROM m UNION ALL SELECT study, 'expression samples', 'metric', n FROM m
UNION ALL SELECT study, 'json_tsv overlap', 'metric', round(b / u, 6) FROM o
UNION ALL SELECT study, 'low gene count', 'warning', g FROM m WHERE g < 1000""")
def study_validation(spark, sf):
    d = study_input(spark, sf)
    f = validate_studies(d.experiments, d.samples, d.annotations, d.expression)
    keep = ["technology", "json samples", "annotation rows", "expression genes", "expression samples", "json_tsv overlap", "low gene count"]
    return rounded(f.where(F.col("check").isin(keep)))


@query("study_quality_score")
def study_quality_score(spark, sf):
    d = study_input(spark, sf)
    return quality_score(validate_studies(d.experiments, d.samples, d.annotations, d.expression, min_genes=10))


def _warehouse(spark) -> E.Warehouse:
    return E.Warehouse(spark, os.path.join(checkpoint_root(spark), f"warehouse-{uuid.uuid4().hex}"))


# The study of region 3 can't be read, that of region 4 has no name for its organism and no accession.
def _partly_broken(spark, sf) -> E.StudyInput:
    d = study_input(spark, sf)
    sick = F.when(F.col("study") == "SRP3", F.raise_error(F.lit("unreadable block")).cast("double")).otherwise(F.col("value"))
    e = d.experiments.withColumns({"organism": F.when(F.col("study") != "SRP4", F.col("organism")), "accession_code": F.when(F.col("study") != "SRP4", F.col("accession_code"))})
    return E.StudyInput(e, d.samples, d.annotations, d.expression.withColumn("value", sick))


@query("study_outcomes", f"""WITH {_SQL} SELECT 'SRP' || r_regionkey AS study, CASE WHEN r_regionkey IN (3, 4) THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  r_regionkey = 3 AS unreadable, CASE WHEN r_regionkey = 3 THEN 0 ELSE (SELECT count(*) FROM x WHERE study = 'SRP' || r_regionkey) END AS records FROM region""")
def study_outcomes(spark, sf):
    """Two of five studies are broken, one unreadable and one invalid; the others load."""
    _, audit = E.run(_partly_broken(spark, sf), _warehouse(spark), min_genes=10)
    return audit.select("study", "status", F.coalesce(F.contains("message", F.lit("unreadable block")), F.lit(False)).alias("unreadable"), "records")


@query("stage_summaries", f"""WITH {_SQL}, loaded AS (SELECT * FROM x JOIN (SELECT DISTINCT study AS st, accession_code FROM a) ON st = study AND accession_code = sample)
SELECT 'extract' AS step, 'experiments' AS "table", count(*) AS records, 0::BIGINT AS warnings, 0::BIGINT AS errors FROM region
UNION ALL SELECT 'extract', 'samples', count(*), 0, 0 FROM s
UNION ALL SELECT 'extract', 'annotations', count(*), count(*) FILTER (organism IS NULL), 0 FROM a
UNION ALL SELECT 'extract', 'expression', count(*), count(*) FILTER (value IS NULL), 0 FROM x
UNION ALL SELECT 'load', 'dim_study', count(*), 0, 0 FROM region
UNION ALL SELECT 'load', 'dim_platform', count(DISTINCT CASE rf WHEN 'R' THEN 'I' ELSE 'A' END || substr(ym, 1, 4)), 0, 0 FROM s
UNION ALL SELECT 'load', 'dim_illness', count(DISTINCT rf), 0, 0 FROM a
UNION ALL SELECT 'load', 'dim_sample', count(*), count(*) FILTER (rf NOT IN ('R', 'N')), 0 FROM a
UNION ALL SELECT 'load', 'dim_gene', count(DISTINCT gene), count(DISTINCT gene), 0 FROM x
UNION ALL SELECT 'load', 'fact_expression', count(*), 0, 0 FROM loaded""")
def stage_summaries(spark, sf):
    """Counts taken by the writes of a whole run, against recounting."""
    w = _warehouse(spark)
    E.run(study_input(spark, sf), w, min_genes=10)
    return spark.read.parquet(f"{w.root}/audit_stage").select("step", "table", "records", "warnings", "errors")


@query("staged_fact", f"""WITH {_SQL} SELECT x.study, sample AS accession_code, x.gene AS gene_symbol, {r("value + CASE WHEN x.study = 'SRP1' THEN 1 ELSE 0 END", 'expression_value', 4)}
FROM x JOIN a ON a.study = x.study AND accession_code = sample""")
def staged_fact(spark, sf):
    """Two loads: all studies, then one of them with other values; its folder alone is rewritten."""
    w, d = _warehouse(spark), study_input(spark, sf)
    w.load(E.transform(d))
    first = w.manifest()["facts"]
    one = d.only(["SRP1"])
    w.load(E.transform(E.StudyInput(one.experiments, one.samples, one.annotations, one.expression.withColumn("value", F.col("value") + 1))))
    now = w.manifest()["facts"]
    if {s for s in now if now[s] != first.get(s)} != {"SRP1"}:
        raise AssertionError("a load rewrote studies that it doesn't hold")
    w.cleanup()
    f = w.read("fact_expression").join(w.read("dim_sample").select("study", "accession_code", "sample_key"), ["study", "sample_key"]).join(
        w.read("dim_gene").select("gene_symbol", "gene_key"), "gene_key")
    return rounded(f.select("study", "accession_code", "gene_symbol", F.col("expression_value").cast("double").alias("expression_value")), 4)


@query("log_retention", """WITH l AS (SELECT event_id, ts, max(ts) OVER () AS now FROM events)
SELECT 'a' AS log, event_id FROM l WHERE ts >= now - INTERVAL 10 DAY UNION ALL SELECT 'b', event_id FROM l WHERE ts >= now - INTERVAL 10 DAY""")
def log_retention(spark, sf):
    """Log tables older than ten days, dropped twice."""
    w, events = _warehouse(spark), X.table(spark, sf, "events").select("event_id", "ts")
    now = events.agg(F.max("ts").alias("t")).select(F.unix_micros(F.col("t").cast("timestamp")).alias("t")).first()["t"]
    for log in ("a", "b"):
        w.append(log, events, "ts")
    for _ in range(2):
        w.retain_logs(10, {"a": "ts", "b": "ts"}, datetime.fromtimestamp(now / 1e6, timezone.utc))
    return spark.read.parquet(f"{w.root}/a").select(F.lit("a").alias("log"), "event_id").unionByName(spark.read.parquet(f"{w.root}/b").select(F.lit("b").alias("log"), "event_id"))
