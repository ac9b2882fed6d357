"""Study warehouse: validated star schema, staged and idempotent load, audit, retention. All studies go through one job."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhopool.functions import text as T
from rhopool.operators.clean import batch_id, coerce_number, parse_bool
from rhopool.operators.quality import quality_score, validate_studies
from rhopool.operators.summary import StageSummary
from rhopool.operators.upsert import latest_rows, number_rows, unmatched_keys, upsert
from rhopool.session import materialize


@dataclass
class StudyInput:
    """experiments(study, accession_code, title, description, technology, organism, ...), samples(study, sample,
    accession_code, organism, platform_name, processor_name, processor_version), annotations(study, accession_code,
    experiment_accession_code, title, organism, processed, source_database), expression(study, gene, sample, value)."""
    experiments: DataFrame
    samples: DataFrame
    annotations: DataFrame
    expression: DataFrame

    def stored(self, write: Callable[..., DataFrame]) -> "StudyInput":
        """The inputs read back from where ``write(df, table, warning, error)`` puts them."""
        null = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
        number = F.col("value").try_cast("double")
        return StudyInput(
            write(self.experiments, "experiments", null("organism") if "organism" in self.experiments.columns else None, null("accession_code")),
            write(self.samples, "samples", null("organism") if "organism" in self.samples.columns else None, null("sample")),
            write(self.annotations, "annotations", null("title") | null("organism"), null("accession_code")),
            write(self.expression, "expression", F.col("value").isNull(), F.col("value").isNotNull() & number.isNull()))

    def only(self, studies: list[str]) -> "StudyInput":
        """The inputs of the named studies. A short list is a filter that reaches the sources, so that others aren't read."""
        if len(studies) <= LISTED:
            keep = lambda d: d.where(F.col("study").isin(studies) if studies else F.lit(False))
        else:
            names = self.experiments.sparkSession.createDataFrame([(s,) for s in studies], "study string")
            keep = lambda d: d.join(names, "study", "left_semi")
        return StudyInput(*map(keep, (self.experiments, self.samples, self.annotations, self.expression)))


LISTED = 1000  # studies named in a filter; more are joined


def _get(df: DataFrame, name: str, default=None):
    return F.col(name) if name in df.columns else F.lit(default).cast("string")


def dim_study(e: DataFrame) -> DataFrame:
    d = e.select(
        F.coalesce("accession_code", F.lit("")).alias("accession_code"), T.truncate(_get(e, "title"), T.TITLE_LENGTH).alias("title"),
        T.truncate(_get(e, "description"), T.DESCRIPTION_LENGTH).alias("description"),
        T.technology(F.coalesce(_get(e, "technology"), F.lit("RNA-SEQ"))).alias("technology"), _get(e, "organism").alias("organism"),
        parse_bool(_get(e, "has_publication")).alias("has_publication"), _get(e, "pubmed_id").alias("pubmed_id"),
        T.truncate(_get(e, "publication_title"), T.TITLE_LENGTH).alias("publication_title"),
        T.parse_date(_get(e, "source_first_published")).alias("source_first_published"),
        T.parse_date(_get(e, "source_last_modified")).alias("source_last_modified"))
    return number_rows(d.dropDuplicates(["accession_code"]), ["accession_code"], "study_key")


def dim_platform(s: DataFrame) -> DataFrame:
    """One row per platform, described by its first sample; a lone Unknown row when there are no samples."""
    name = F.coalesce(_get(s, "platform_name"), F.lit("Unknown"))
    first = lambda c: F.min_by(F.coalesce(_get(s, c), F.lit("")), F.struct("study", "sample")).alias(c)
    d = s.groupBy(name.alias("platform_name")).agg(first("processor_name"), first("processor_version"))
    fallback = s.sparkSession.createDataFrame([("Unknown", "", "")], d.schema)
    d = d.unionByName(fallback.where(~s.agg(F.count(F.lit(1)) > 0).scalar()))
    return number_rows(d.withColumn("platform_type", T.platform_type("platform_name")), ["platform_name"], "platform_key")


def dim_illness(a: DataFrame, extended: bool = False) -> DataFrame:
    d = a.where("title is not null").select(T.condition_of_title("title", extended).alias("illness_type")).distinct()
    fallback = a.sparkSession.createDataFrame([("control",), ("sepsis",)], "illness_type string")
    d = d.unionByName(fallback.where(~a.agg(F.count("title") > 0).scalar()))
    d = d.withColumn("illness_description", T.condition_description("illness_type"))
    return number_rows(d, ["illness_type"], "illness_key")


def dim_sample(a: DataFrame, s: DataFrame, extended: bool = False) -> DataFrame:
    """Annotated samples, enriched by the document's organism; natural key (study, accession)."""
    j = s.select("study", F.col("sample").alias("accession_code"), _get(s, "organism").alias("_org")).dropDuplicates(["study", "accession_code"])
    rows = a.where("accession_code is not null and accession_code <> ''").dropDuplicates(["study", "accession_code"])
    d = rows.join(j, ["study", "accession_code"], "left").select(
        "study", "accession_code", _get(rows, "experiment_accession_code").alias("experiment_accession"),
        T.truncate("title", T.SAMPLE_TITLE_LENGTH).alias("title"), F.coalesce("organism", "_org").alias("organism"),
        parse_bool(_get(rows, "processed")).alias("processed"), _get(rows, "source_database").alias("source_database"),
        T.condition_of_title("title", extended).alias("sample_classification"), T.sample_number("title").alias("sample_number"))
    return number_rows(d, ["study", "accession_code"], "sample_key")


def dim_gene(x: DataFrame) -> DataFrame:
    d = x.select(F.col("gene").alias("gene_symbol")).where("gene_symbol is not null").distinct()
    d = d.withColumns({"gene_description": T.gene_description("gene_symbol"), "gene_type": T.gene_type("gene_symbol"),
                       "valid_symbol": F.col("gene_symbol").rlike(T.GENE_SYMBOL_PATTERN)})
    return number_rows(d, ["gene_symbol"], "gene_key")


def fact_expression(x: DataFrame, samples: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample_key, gene_key, expression_value): numeric cells whose sample and gene are known; one per key pair."""
    value = F.col("value") if dict(x.dtypes)["value"] == "double" else coerce_number("value")
    cells = x.select("study", F.col("sample").alias("accession_code"), F.col("gene").alias("gene_symbol"), value.alias("v")).where("v is not null")
    f = (cells.join(samples.select("study", "accession_code", "sample_key"), ["study", "accession_code"])
         .join(genes.select("gene_symbol", "gene_key"), "gene_symbol"))
    return f.groupBy("sample_key", "gene_key").agg(F.max("v").cast("decimal(15,6)").alias("expression_value"))


def transform(data: StudyInput, extended: bool = False) -> dict[str, DataFrame]:
    """The star schema of the given studies with fresh surrogate keys."""
    samples = dim_sample(data.annotations, data.samples, extended)
    genes = dim_gene(data.expression)
    samples, genes = materialize(samples, "dim_sample"), materialize(genes, "dim_gene")
    return {"dim_study": dim_study(data.experiments), "dim_platform": dim_platform(data.samples),
            "dim_illness": dim_illness(data.annotations, extended), "dim_sample": samples, "dim_gene": genes,
            "fact_expression": fact_expression(data.expression, samples, genes)}


def unmapped(data: StudyInput, star: dict[str, DataFrame]) -> DataFrame:
    """Per kind the number of expression keys without a dimension row; a sample belongs to its study."""
    s = data.expression.select("study", F.col("sample").alias("accession_code"))
    g = data.expression.select(F.col("gene").alias("gene_symbol"))
    count = lambda d, k: d.agg(F.count(F.lit(1)).alias("unmapped")).select(F.lit(k).alias("kind"), "unmapped")
    return count(unmatched_keys(s, star["dim_sample"], "study", "accession_code"), "sample").unionByName(
        count(unmatched_keys(g, star["dim_gene"], "gene_symbol"), "gene"))


# Natural key and surrogate per table.
NATURAL = {"dim_study": (["accession_code"], "study_key"), "dim_platform": (["platform_name"], "platform_key"),
           "dim_illness": (["illness_type"], "illness_key"), "dim_sample": (["study", "accession_code"], "sample_key"),
           "dim_gene": (["gene_symbol"], "gene_key")}


class Warehouse:
    """Tables below ``root`` whose current state is named by the last manifest.

    A load writes its tables to a folder of its own (the stage) and then commits a manifest that names them; until then,
    and if it never comes to that, readers see the state before. The fact is kept in one folder for each study, so a
    load rewrites the studies it touches and no others. Dimensions are rewritten whole.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _list(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _remove(self, *parts: str) -> None:
        path = self._path(*parts)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def manifest(self) -> dict:
        """{"number", "tables": table -> folder, "facts": study -> folder} of the last complete commit."""
        for name in reversed(self._list("_manifests")):
            path = self._path("_manifests", name)
            stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):          # a writer that died left no line end
                return json.loads(text)
        return {"number": 0, "tables": {}, "facts": {}}

    def commit(self, tables: dict[str, str], facts: dict[str, str]) -> int:
        """Makes the given folders current in one step; fails if another load commits the same number."""
        old = self.manifest()
        number = max([old["number"], *(int(n) for n in self._list("_manifests"))]) + 1
        new = {"number": number, "tables": {**old["tables"], **tables}, "facts": {**old["facts"], **facts}}
        path = self._path("_manifests", f"{number:09d}")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
        try:
            out.write(bytearray(json.dumps(new).encode() + b"\n"))
        finally:
            out.close()
        return number

    def begin(self) -> str:
        return f"{self.manifest()['number'] + 1:09d}-{uuid.uuid4().hex[:12]}"

    def cleanup(self) -> list[str]:
        """Removes the stages that the current manifest doesn't use; not to be run beside a load. Older states go with them."""
        now = self.manifest()
        used = {f.split("/")[1] for f in (*now["tables"].values(), *now["facts"].values())}
        gone = [name for name in self._list("_data") if name not in used]
        for name in gone:
            self._remove("_data", name)
        return gone

    def read(self, table: str, studies: list[str] | None = None) -> DataFrame | None:
        """A table as of the last commit; of the fact only the given studies, if named."""
        now = self.manifest()
        if table != "fact_expression":
            return self.spark.read.parquet(f"{self.root}/{now['tables'][table]}") if table in now["tables"] else None
        folders = [f for s, f in now["facts"].items() if studies is None or s in set(studies)]
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders)) if folders else None

    def stage(self, load: str, table: str, df: DataFrame, summary: StageSummary | None = None, step: str = "load",
              warning=None, error=None, partition_by: str | None = None) -> DataFrame:
        """Writes ``df`` to the load's stage and reads it back; the summary counts what passes."""
        path = f"{self.root}/_data/{load}/{table}"
        (summary or StageSummary()).write(df, path, step, table, warning, error, partition_by)
        return self.spark.read.parquet(path)

    def append(self, table: str, df: DataFrame, at: str = "at") -> None:
        """Adds rows to a log table, in a folder for each day of the timestamp ``at``."""
        df.withColumn("log_date", F.to_date(at)).write.mode("append").partitionBy("log_date").parquet(f"{self.root}/{table}")

    def retain_logs(self, days: int, logs: dict[str, str] | None = None, now: datetime | None = None) -> None:
        """Log rows older than ``days`` go: whole days by their folder, the day that holds the limit by rewriting it alone.

        ``logs``: table -> timestamp column (default: LOGS). A second run changes nothing.
        """
        limit = (now or datetime.now(timezone.utc)) - timedelta(days=days)
        for table, at in (logs or LOGS).items():
            for name in self._list(table):
                if not name.startswith("log_date=") or name.endswith("__HIVE_DEFAULT_PARTITION__"):
                    continue
                day = date.fromisoformat(name.removeprefix("log_date="))
                if day < limit.date():
                    self._remove(table, name)
                elif day == limit.date():
                    rows = self.spark.read.parquet(f"{self.root}/{table}/{name}")
                    late = rows.where(F.col(at) < F.lit(limit))
                    if late.isEmpty():
                        continue
                    kept = materialize(rows.where(F.coalesce(F.col(at) >= F.lit(limit), F.lit(False))), "kept")
                    if kept.isEmpty():
                        self._remove(table, name)
                    else:
                        (kept.withColumn("log_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                         .partitionBy("log_date").parquet(f"{self.root}/{table}"))

    def load_dimension(self, load: str, table: str, incoming: DataFrame, summary: StageSummary | None = None) -> DataFrame:
        """Known natural keys keep their surrogate and take the new attributes; new ones continue the numbering."""
        keys, surrogate = NATURAL[table]
        old = self.read(table)
        warning = F.expr(WARNINGS[table]) if table in WARNINGS else None
        if old is None:
            return self.stage(load, table, incoming, summary, warning=warning)
        top = old.agg(F.coalesce(F.max(surrogate), F.lit(0))).first()[0]
        new = incoming.join(old.select(*keys), keys, "left_anti").drop(surrogate)
        numbered = number_rows(new, keys, surrogate, start=top + 1)
        update = [c for c in incoming.columns if c not in (*keys, surrogate)]
        merged = upsert(old, incoming.join(old.select(*keys), keys, "left_semi"), keys, update)
        return self.stage(load, table, merged.unionByName(numbered.select(*merged.columns)), summary, warning=warning)

    def load(self, star: dict[str, DataFrame], load: str | None = None, summary: StageSummary | None = None) -> dict[str, DataFrame]:
        """Stages all tables and commits them; the fact is resolved over natural keys to the warehouse's surrogates.

        Only the folders of the star's studies are read and rewritten; the latest value of a key wins.
        """
        load = load or self.begin()
        out = {t: self.load_dimension(load, t, star[t], summary) for t in NATURAL}
        f = star["fact_expression"]
        swap = lambda t, k: star[t].select(*NATURAL[t][0], F.col(k).alias(f"_{k}")).join(out[t].select(*NATURAL[t][0], k), NATURAL[t][0]) \
            .select(*(["study"] if t == "dim_sample" else []), F.col(f"_{k}"), F.col(k).alias(f"_new_{k}"))
        for t, k in (("dim_sample", "sample_key"), ("dim_gene", "gene_key")):
            f = f.join(swap(t, k), F.col(k) == F.col(f"_{k}")).drop(k, f"_{k}").withColumnRenamed(f"_new_{k}", k)
        f = f.select("study", "sample_key", "gene_key", "expression_value").withColumn("processed_at", F.current_timestamp())
        f = latest_rows(f, ["study", "sample_key", "gene_key"], ["processed_at", "expression_value"])
        old = self.read("fact_expression", [r["study"] for r in star["dim_sample"].select("study").distinct().collect()])
        merged = f if old is None else upsert(old, f, ["study", "sample_key", "gene_key"], ["expression_value", "processed_at"])
        self.stage(load, "fact_expression", merged.withColumn("_study", F.col("study")), summary, partition_by="_study")
        folder = f"_data/{load}/fact_expression"
        facts = {unquote(n.removeprefix("_study=")): f"{folder}/{n}" for n in self._list(folder) if n.startswith("_study=")}
        self.commit({t: f"_data/{load}/{t}" for t in NATURAL}, facts)
        out["fact_expression"] = self.read("fact_expression")
        return out


#: Log tables and their time.
LOGS = {"audit_execution": "started", "audit_quality": "at", "audit_stage": "at"}
#: What counts as a warning in a loaded table.
WARNINGS = {"dim_study": "organism is null", "dim_sample": "sample_classification = 'unknown'", "dim_gene": "not valid_symbol"}


def isolated(studies: list[str], attempt: Callable[[list[str]], None], give_up: int = 20) -> dict[str, tuple]:
    """study -> (failure or None, started, finished): ``attempt`` is made for all studies at once.

    If it fails they are halved and each half is attempted on its own, so k broken ones among n cost about 2 k log n
    attempts. After ``give_up`` failures in a row the rest fails unattempted.
    """
    done: dict[str, tuple] = {}
    todo, failed, last = [sorted(studies)] if studies else [], 0, ""
    while todo:
        some = todo.pop(0)
        started = datetime.now(timezone.utc)
        if failed >= give_up:
            done.update({s: (f"not attempted after {failed} failures, the last: {last}"[:1000], started, started) for s in some})
            continue
        try:
            attempt(some)
            failure, failed = None, 0
        except Exception as e:  # whatever it was, the audit names it
            failure = last = f"{type(e).__name__}: {e}"[:1000]
            failed += 1
            if len(some) > 1:
                todo[:0] = [some[:len(some) // 2], some[len(some) // 2:]]
                continue
        done.update({s: (failure, started, datetime.now(timezone.utc)) for s in some})
    return done


def load_isolated(warehouse: Warehouse, data: StudyInput, studies: list[str], extended: bool = False,
                  summary: StageSummary | None = None, give_up: int = 20) -> dict[str, tuple]:
    """Every study that can be loaded is, whatever the others do: one job and one commit for all, in halves where it fails."""

    def attempt(some):
        own = StageSummary()
        warehouse.load(transform(data.only(some), extended), summary=own)
        if summary is not None:
            summary.counts += own.counts

    return isolated(studies, attempt, give_up)


def extract_isolated(warehouse: Warehouse, data: StudyInput, load: str, summary: StageSummary) -> tuple[StudyInput, dict[str, tuple]]:
    """The inputs stored in the stage ``load``, without the studies that can't be read, and the outcomes of a reading in halves."""
    parts: list[StudyInput] = []

    def attempt(some):
        own, place = StageSummary(), f"{load}/{len(parts)}-{uuid.uuid4().hex[:6]}"
        chosen = data if some is None else data.only(some)
        parts.append(chosen.stored(lambda df, table, warning, error: warehouse.stage(place, table, df, own, "extract", warning, error)))
        summary.counts += own.counts

    try:
        attempt(None)
        return parts[0], {}
    except Exception:
        # Which study it was is told by reading them apart; what no part holds is read as empty.
        outcome = isolated([r["study"] for r in data.experiments.select("study").distinct().collect()], attempt)
    names = ("experiments", "samples", "annotations", "expression")
    if not parts:
        return data.only([]), outcome
    return StudyInput(*(reduce(DataFrame.unionByName, [getattr(p, n) for p in parts]) for n in names)), outcome


def run(data: StudyInput, warehouse: Warehouse | None, min_genes: int = 1000, extended: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, audit): validate every study, load those without errors, record one audit row per study.

    A failing study never stops the others: studies with errors aren't loaded, and a reading or load that fails is repeated in
    halves until the broken studies stand alone, audited as FAILED with their message and times. Findings carry the execution_id
    of their study's audit row and a result (FAIL, WARNING or PASS). The inputs are stored once, in a stage that is removed after
    the load; records, warnings and errors of each step and table go to the log ``audit_stage``. ``warehouse=None``
    only validates.
    """
    started = datetime.now(timezone.utc)
    spark, summary = data.experiments.sparkSession, StageSummary()
    inputs = warehouse.begin() + "-input" if warehouse is not None else None
    unread: dict[str, tuple] = {}
    studies = materialize(data.experiments.select("study").distinct(), "studies")
    if warehouse is not None:
        data, unread = extract_isolated(warehouse, data, inputs, summary)
        unread = {s: o for s, o in unread.items() if o[0]}
    findings = materialize(validate_studies(data.experiments, data.samples, data.annotations, data.expression, min_genes), "findings")
    score = materialize(studies.join(quality_score(findings), "study", "left")
                        .withColumn("execution_id", batch_id("study")), "scores")
    good = [r["study"] for r in score.where(F.coalesce("errors", F.lit(0)) == 0).select("study").collect() if r["study"] not in unread]
    records = data.expression.groupBy("study").agg(F.count(F.lit(1)).alias("records"))
    outcome = {**unread, **load_isolated(warehouse, data, good, extended, summary)} if warehouse is not None else {}
    finished = datetime.now(timezone.utc)
    times = spark.createDataFrame([(s, *o) for s, o in outcome.items()], "study string, failure string, began timestamp, ended timestamp")
    bad, count = F.coalesce("errors", F.lit(0)) > 0, F.coalesce("records", F.lit(0))
    began, ended = F.coalesce("began", F.lit(started)), F.coalesce("ended", F.lit(finished))
    seconds = F.col("ended_at").cast("double") - F.col("started").cast("double")
    loaded = F.lit("VALIDATED") if warehouse is None else F.when(F.col("failure").isNull(), "SUCCESS").otherwise("FAILED")
    rows = score.join(records, "study", "left").join(times, "study", "left").withColumns({"started": began, "ended_at": ended})
    audit = materialize(rows.select(
        "execution_id", "study", F.when(bad, "FAILED").otherwise(loaded).alias("status"), "started", F.col("ended_at").alias("finished"),
        seconds.alias("seconds"), count.alias("records"), (count / F.greatest(seconds, F.lit(1e-3))).alias("records_per_second"),
        F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), "quality_score",
        F.when(~bad, F.col("failure")).alias("message")), "audit")
    result = F.when(F.col("level") == "error", "FAIL").when(F.col("level") == "warning", "WARNING").otherwise("PASS")
    findings = findings.join(score.select("study", "execution_id"), "study", "left").withColumn("result", result)
    if warehouse is not None:
        findings = materialize(findings, "named_findings")
        warehouse.append("audit_execution", audit, "started")
        warehouse.append("audit_quality", findings.withColumn("at", F.lit(started)))
        warehouse.append("audit_stage", summary.rows(spark).withColumns({"load": F.lit(inputs), "at": F.lit(started)}))
        warehouse._remove("_data", inputs)
    return findings, audit
