"""From documents to packed training sequences: rules, classifier, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm.mil_quality import fit_quality, score_quality
from plumeria.llm.near_copies import one_of_each
from plumeria.llm.packing import best_fit_pack
from plumeria.llm.quality_rules import fit_references, verdict
from plumeria.llm.queries import documents, labels, vocabulary
from plumeria.llm.shared import written


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the histograms pass; the references are fitted over all of ``docs``."""
    return docs.filter(verdict(F.col("text"), fit_references(docs))["kept"])


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it is fitted on labelled rows of the whole documents table."""
    model = fit_quality(documents(spark, sf_dir), labels(spark, sf_dir))
    scored = score_quality(docs, model)
    return (scored.filter("predicted = 1") if model else scored).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles of similarity 0.8 or more link: by SimHash, and beyond its ball by prefixes."""
    return one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in training sequences."""
    return best_fit_pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("best-fit packing", packing_stage),
]
#: SQL can't express the classifier, the near-copies or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
