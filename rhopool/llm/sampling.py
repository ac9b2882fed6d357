"""Held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 30


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label 0/1) of about ``rows`` labelled ids at most, chosen by a hash of the id.

    An id labelled more than once counts as 1 if any of its labels is; null ids and labels are left out. The choice
    needs one count and no sort; it keeps each id with the same chance.
    """
    once = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = max(1, once.count())
    keep = min(STEPS, STEPS * rows // n)
    return once.where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < keep)
