import json

import pytest
from pyspark.sql import functions as F

from rhopool.operators import reports as R
from rhopool.plans import etl as E
from rhopool.sources import files as FI
from rhopool.sources import metadata as MD


def write_study(root, code, layout, value=5.0, broken=False):
    d = root / code
    d.mkdir()
    accs = [f"SRR{code[-1]}{i}" for i in range(4)]
    sample = lambda a: {"accession_code": a, "organism": "HOMO_SAPIENS", "platform_name": "Illumina HiSeq", "processor_name": "salmon",
                        "processor_version": "1", "experiment_accession_code": code}
    exp = {"accession_code": code, "title": "T" * 600, "organism": None if broken else "HOMO_SAPIENS", "technology": "RNA-SEQ",
           "has_publication": True, "source_first_published": "2020-01-31"}
    samples = {a: sample(a) for a in accs}
    doc = {"experiments": {code: exp}, "samples": samples}
    if layout == "under":
        doc["samples"] = {code: samples}
    if layout == "inside":
        doc = {"experiments": {code: {**exp, "samples": samples}}}
    if layout == "top":
        doc["samples"]["SRR999"] = {**sample("SRR999"), "experiment_accession_code": "OTHER"}
    (d / "metadata.json").write_text(json.dumps(doc, indent=1))
    lines = ["src_accession_code\texperiment_accession_code\tsrc_title\tsrc_organism\tsrc_processed"]
    lines += [f"{a}\t{code}\t{t}\t{o}\tTrue" for a, t, o in zip(accs, ["Healthy sample 1", "Sepsis \"S2", "other", "control 4"],
                                                               ["HOMO_SAPIENS", "NA", "HOMO_SAPIENS", "HOMO_SAPIENS"])]
    (d / "annotations.tsv").write_text("\n".join(lines) + "\n")
    m = ["Gene\t" + "\t".join(accs)] + [f"{g}\t" + "\t".join(str(value + i + j) for j in range(4)) for i, g in enumerate(["CD86", "RPL3", "MIR21"])]
    m.append("LINC01\t1.0\tNA\t\tx")
    (d / "matrix.tsv").write_text("\n".join(m) + "\n")


def read(spark, root):
    docs = MD.read_documents(spark, f"{root}/*/metadata.json")
    e = MD.attributes(MD.experiments(docs), ["study"], "accession_code", "title", "description", "organism", "technology",
                      "has_publication", "pubmed_id", "publication_title", "source_first_published", "source_last_modified")
    s = MD.attributes(MD.samples(docs), ["study", "sample"], "accession_code", "organism", "platform_name", "processor_name", "processor_version")
    a = FI.read_annotations(spark, f"{root}/*/annotations.tsv", "src_")
    x = FI.read_matrix(spark, f"{root}/*/matrix.tsv")
    return docs, E.StudyInput(e, s, a, x.withColumn("value", F.col("value").try_cast("double")))


def test_pipeline(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for code, layout, broken in (("SRP1", "top", False), ("SRP2", "under", False), ("SRP3", "inside", False), ("SRP4", "top", True)):
        write_study(src, code, layout, broken=broken)
    docs, data = read(spark, src)
    assert {r.study for r in FI.discover_studies(spark, str(src), docs).collect()} == {"SRP1", "SRP2", "SRP3", "SRP4"}
    assert {(r.study, r["count"]) for r in data.samples.groupBy("study").count().collect()} == {(f"SRP{i}", 4) for i in (1, 2, 3, 4)}
    assert data.annotations.where("organism is null").count() == 4
    w = E.Warehouse(spark, str(tmp_path / "wh"))
    findings, audit = E.run(data, w, min_genes=3)
    status = {r.study: r.status for r in audit.collect()}
    assert status == {"SRP1": "SUCCESS", "SRP2": "SUCCESS", "SRP3": "SUCCESS", "SRP4": "FAILED"}
    assert all(0 <= r.quality_score <= 100 for r in audit.collect())
    study = w.read("dim_study")
    assert study.count() == 3 and study.agg(F.max(F.length("title"))).first()[0] == 500
    assert {r.illness_type for r in w.read("dim_illness").collect()} == {"control", "sepsis", "unknown"}
    # 3 full genes x 4 samples x 3 studies plus the one numeric cell of the gappy gene per study.
    fact = w.read("fact_expression")
    assert fact.count() == 39
    keys = {r.accession_code: r.sample_key for r in w.read("dim_sample").collect()}
    # A second load with a changed value and a new study keeps keys and is otherwise idempotent.
    E.run(data, w, min_genes=3)
    assert w.read("fact_expression").count() == 39 and w.read("dim_gene").count() == 4
    more = tmp_path / "more"
    more.mkdir()
    write_study(more, "SRP0", "top", value=7.0)
    write_study(more, "SRP1", "top", value=50.0)
    E.run(read(spark, more)[1], w, min_genes=3)
    again = {r.accession_code: r.sample_key for r in w.read("dim_sample").collect()}
    assert all(again[a] == k for a, k in keys.items()) and len(again) == 16 and len(set(again.values())) == 16
    f = w.read("fact_expression")
    assert f.count() == 52 and f.groupBy("sample_key", "gene_key").count().where("count > 1").isEmpty()
    assert float(f.agg(F.max("expression_value")).first()[0]) == 55.0
    assert spark.read.parquet(f"{w.root}/audit_execution").count() == 10
    only, audit = E.run(data, None, min_genes=3)
    assert {r.status for r in audit.collect()} == {"VALIDATED", "FAILED"}
    FI.write_report(findings, str(tmp_path / "report"))
    assert spark.read.text(f"{tmp_path}/report/text").count() == findings.count()


def test_each_matrix_keeps_its_own_header(spark, tmp_path):
    for study, head, row in (("SRP1", "Gene\tA1\tA2", "G1\t1\t"), ("SRP2", 'id\t"B1"\tB2\tB3', "G1\t3\t4")):
        (tmp_path / study).mkdir()
        (tmp_path / study / "matrix.tsv").write_text(f"{head}\n{row}\n")
    got = {(r.study, r.gene, r.sample): r.value for r in FI.read_matrix(spark, f"{tmp_path}/*/matrix.tsv").collect()}
    assert got == {("SRP1", "G1", "A1"): "1", ("SRP1", "G1", "A2"): None, ("SRP2", "G1", "B1"): "3", ("SRP2", "G1", "B2"): "4", ("SRP2", "G1", "B3"): None}


def test_failing_load_is_audited_with_its_studies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_study(tmp_path / "in", "SRP1", "top")

    class Broken(E.Warehouse):
        def load(self, star, load=None, summary=None):
            raise OSError("disk full")

    _, audit = E.run(read(spark, tmp_path / "in")[1], Broken(spark, str(tmp_path / "wh")), min_genes=3)
    (row,) = audit.collect()
    assert row.status == "FAILED" and "disk full" in row.message and row.seconds >= 0 and row.finished >= row.started
    stored = spark.read.parquet(f"{tmp_path}/wh/audit_execution")
    assert R.pipeline_summary(stored).first().failed == 1
    quality = spark.read.parquet(f"{tmp_path}/wh/audit_quality")
    assert R.run_statistics(stored, quality).first().checks == quality.count() > 0


def test_one_broken_study_fails_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for code in ("SRP1", "SRP2", "SRP3", "SRP4", "SRP5"):
        write_study(tmp_path / "in", code, "top")

    class Fragile(E.Warehouse):
        def load(self, star, load=None, summary=None):
            sick = F.when(F.col("study") == "SRP3", F.raise_error(F.lit("unreadable block")).cast("string")).otherwise(F.col("study"))
            return super().load({**star, "dim_sample": star["dim_sample"].withColumn("study", sick)}, load, summary)

    w = Fragile(spark, str(tmp_path / "wh"))
    _, audit = E.run(read(spark, tmp_path / "in")[1], w, min_genes=3)
    rows = {r.study: r for r in audit.collect()}
    assert {s: r.status for s, r in rows.items()} == {s: "FAILED" if s == "SRP3" else "SUCCESS" for s in rows} and len(rows) == 5
    assert "unreadable block" in rows["SRP3"].message and rows["SRP1"].message is None
    assert {r.study for r in w.read("fact_expression").select("study").distinct().collect()} == set(rows) - {"SRP3"}
    assert len({r.started for r in rows.values()}) > 1
    stages = {(r.step, r.table): r.records for r in spark.read.parquet(f"{w.root}/audit_stage").collect()}
    assert stages["extract", "expression"] == 5 * 16


def test_give_up_after_failures_in_a_row(spark, tmp_path):
    class Full(E.Warehouse):
        def load(self, star, load=None, summary=None):
            raise OSError("disk full")

    (tmp_path / "in").mkdir()
    for k in range(4):
        write_study(tmp_path / "in", f"SRP{k}", "top")
    done = E.load_isolated(Full(spark, str(tmp_path / "wh")), read(spark, tmp_path / "in")[1], [f"SRP{k}" for k in range(4)], give_up=3)
    assert len(done) == 4 and all("disk full" in f for f, *_ in done.values()) and sum("not attempted" in f for f, *_ in done.values()) == 3


def test_a_load_rewrites_its_studies_only_and_a_crash_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for code in ("SRP1", "SRP2"):
        write_study(tmp_path / "in", code, "top")
    w = E.Warehouse(spark, str(tmp_path / "wh"))
    E.run(read(spark, tmp_path / "in")[1], w, min_genes=3)
    before = w.manifest()
    more = tmp_path / "more"
    more.mkdir()
    write_study(more, "SRP2", "top", value=90.0)
    E.run(read(spark, more)[1], w, min_genes=3)
    after = w.manifest()
    assert after["facts"]["SRP1"] == before["facts"]["SRP1"] and after["facts"]["SRP2"] != before["facts"]["SRP2"]
    rows = w.read("fact_expression").count()
    # Staged but never committed.
    load = w.begin()
    w.stage(load, "dim_study", w.read("dim_study").limit(0))
    assert w.manifest() == after and w.read("fact_expression").count() == rows and w.read("dim_study").count() == 2
    # A manifest cut off while it was written.
    (tmp_path / "wh" / "_manifests" / "000000099").write_text('{"number": 99')
    assert w.manifest() == after
    assert load in w.cleanup() and w.cleanup() == [] and w.read("fact_expression").count() == rows
    E.run(read(spark, more)[1], w, min_genes=3)
    assert w.manifest()["number"] == 100 and w.read("fact_expression").count() == rows


def test_retention_drops_old_rows_once_and_for_all(spark, tmp_path):
    from datetime import datetime, timezone
    w = E.Warehouse(spark, str(tmp_path / "wh"))
    now = datetime(2024, 5, 20, 12, tzinfo=timezone.utc)
    logs = {t: "at" for t in ("a", "b", "c")}
    for t in logs:
        w.append(t, spark.sql("select id, timestamp'2024-05-01 06:00:00' + make_dt_interval(0, id) as at from range(480) union all select -1, null"))
    want = {r.id for r in spark.sql("select id from range(480) where timestamp'2024-05-01 06:00:00' + make_dt_interval(0, id) >= timestamp'2024-05-13 12:00:00'").collect()} | {-1}
    for _ in range(2):
        w.retain_logs(7, logs, now)
        assert all({r.id for r in spark.read.parquet(f"{w.root}/{t}").collect()} == want for t in logs)
    w.retain_logs(0, logs, datetime(2030, 1, 1, tzinfo=timezone.utc))
    assert {r.id for r in spark.read.parquet(f"{w.root}/a").collect()} == {-1}
