"""Nested study metadata documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhopool.sources.files import study_of_path

_OBJECTS = "map<string,map<string,string>>"
# Values stay text: a nested object arrives as its JSON and is parsed where it is used.
DOCUMENT = f"experiments {_OBJECTS}, samples map<string,string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(study, experiments, samples) per metadata file; the study comes from the path."""
    raw = spark.read.text(path, wholetext=True).withColumn("study", study_of_path(F.input_file_name()))
    return raw.select("study", F.from_json("value", DOCUMENT).alias("d")).select("study", "d.*")


def experiments(docs: DataFrame) -> DataFrame:
    """(study, attrs): the experiment under the study's code, else the first one of the document."""
    own = F.try_element_at("experiments", F.col("study"))
    first = F.try_element_at(F.map_values("experiments"), F.lit(1))
    return docs.select("study", F.coalesce(own, first).alias("attrs"))


def samples(docs: DataFrame) -> DataFrame:
    """(study, sample, attrs): samples at top level, under the study's code, or inside the experiment.

    Samples that name another experiment are left out.
    """
    parse = lambda c: F.from_json(c, _OBJECTS)
    exp = F.try_element_at(F.coalesce(F.try_element_at("experiments", F.col("study")),
                                      F.try_element_at(F.map_values("experiments"), F.lit(1))), F.lit("samples"))
    under = parse(F.try_element_at("samples", F.col("study")))
    top = F.transform_values("samples", lambda k, v: F.from_json(v, "map<string,string>"))
    picked = F.when(under.isNotNull(), under).when(F.size("samples") > 0, top).otherwise(parse(exp))
    rows = docs.select("study", F.explode(picked).alias("sample", "attrs"))
    named = F.try_element_at("attrs", F.lit("experiment_accession_code"))
    return rows.where(F.coalesce(named == F.col("study"), F.lit(True)))


def attributes(rows: DataFrame, keep: list[str], *names: str) -> DataFrame:
    """Named attributes of ``attrs`` as columns."""
    return rows.select(*keep, *[F.try_element_at("attrs", F.lit(n)).alias(n) for n in names])
