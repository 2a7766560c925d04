"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, at most.
MAX_LABELLED = 12_000
HELD_OUT_CLASS, CLASSES = 2, 4


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned: crc32 of its id as text leaves 2, divided by 4. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % CLASSES == HELD_OUT_CLASS, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents that are not held out, the same ones each time.

    The ids are drawn by hash from the labels, so what is broadcast is ``limit`` ids at most. A document
    with several labels counts by the largest, and of rows that share an id one is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    drawn = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).select("text", "y")
