"""A cleaning pipeline over ``documents``: every stage works on all rows that the one before it kept.

toxicity drops documents scored 0.7 or more; near_duplicates keeps one document of each group (five words, 0.8);
decontamination drops documents that hold half or more of a benchmark item; pii masks personal data; tokens encodes.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhopool.llm import pii, toxicity
from rhopool.llm.bpe import transcode
from rhopool.llm.decontam import contaminated
from rhopool.llm.dedup import near_duplicates
from rhopool.llm.queries import rank_bytes, table
from rhopool.session import checkpoint_root

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by a model of this table's labels; null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC).select(docs.columns)


def _unit(docs: DataFrame) -> DataFrame:
    """``docs`` with _unit, a hash of id and text: what is told apart is a text under an id, whatever ids repeat or are missing."""
    return docs.withColumn("_unit", F.xxhash64("doc_id", "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group (without ids: some one); different texts under one id are documents of their own.

    Rows that repeat id and text are one document, and stay once; documents without words stay.
    """
    units = _unit(docs)
    groups = near_duplicates(units.select(F.col("_unit").alias("doc_id"), "text"), shingle=5, percent=80)
    named = groups.select(F.col("doc_id").alias("_unit"), "component_id").distinct().join(units.select("_unit", "doc_id").distinct(), "_unit")
    # An absent id comes after all others.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_unit")
    kept = named.groupBy("component_id").agg(F.min_by("_unit", order).alias("_unit")).select("_unit")
    return units.join(kept, "_unit", "left_semi").dropDuplicates(["_unit"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them, whether they have an id or not."""
    units = _unit(docs)
    hit = contaminated(units.select(F.col("_unit").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_unit")).distinct()
    return units.join(hit, "_unit", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text where it was given."""
    masked = pii.mask(pii.extract(docs)).select(docs.columns)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(kind))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of each whole text."""
    encoded = transcode(docs.select("doc_id", "text", "lang", "source"), rank_bytes())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("tokens", encode),
]

#: A trained model and learned patterns take part; the tests hold the result against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = os.path.join(checkpoint_root(spark), f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
