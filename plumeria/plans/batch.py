"""The batch and the resume pipeline, stage by stage, over tables in a results folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, dedup, embeddings, enrich, joins, quality, quotes
from ..sources.writers import save


def texts_of(raw: DataFrame) -> DataFrame:
    """(id, seq, comment, attachment_texts) of nested comments; the order is by id."""
    return raw.select("id", F.col("id").alias("seq"), F.col("attributes.comment").alias("comment"), F.transform("attributes.attachment_texts", lambda a: a["text"]).alias("attachment_texts"))


def finish(raw: DataFrame, lookup: DataFrame, members: DataFrame, path: str, classifier: enrich.Classifier | None, config: enrich.EnrichConfig, encoder: embeddings.Encoder | None = None) -> dict[str, DataFrame]:
    """Analysis, clusters, coordinates, merge and checks, each a table below ``path``; analyses, and an ``encoder``'s vectors, are kept in ledgers there, so a run that is begun again takes them up."""
    if classifier:
        lookup = save(enrich.analyse_resumable(lookup, classifier, f"{path}/analyses", config), f"{path}/analysed")
    told = lookup.select("lookup_id", "truncated_text")
    told = embeddings.embed_resumable(told, "truncated_text", encoder, f"{path}/vectors") if encoder else clusters.hashed_embeddings(told, "truncated_text")
    vectors = save(told.select(F.col("lookup_id").alias("id"), "embedding"), f"{path}/embeddings")
    placed = clusters.ward_clusters(vectors).join(clusters.plane(vectors), "id").withColumnRenamed("id", "lookup_id")
    lookup = save(joins.relabel(lookup, placed), f"{path}/lookup")
    flat = joins.flatten(raw)
    missing = joins.orphans(members, flat).limit(1).count()
    if missing:
        raise quality.IntegrityError("the lookup table has ids without a comment")
    data = save(joins.merge(flat, lookup, members), f"{path}/data")
    verified = quotes.verify(lookup)
    listed = dedup.with_ids(lookup, members.withColumn("seq", F.col("id")))
    return {"lookup": listed, "members": members, "data": data, "quotes": quotes.rates(verified), "report": quality.report(quality.validate(data)), "summary": dedup.summary(lookup)}


def batch(raw: DataFrame, path: str, truncate: int | None = 1000, classifier: enrich.Classifier | None = None, config: enrich.EnrichConfig = enrich.EnrichConfig(), encoder: embeddings.Encoder | None = None) -> dict[str, DataFrame]:
    """From nested comments to the merged table."""
    texts = dedup.combined(texts_of(raw), truncate)
    found, ids = dedup.entries(texts)
    lookup = save(dedup.lookup_rows(texts, found).drop("seq"), f"{path}/created")
    members = save(ids.select("id", "lookup_id"), f"{path}/members")
    return finish(raw, lookup, members, path, classifier, config, encoder)


def resume(raw: DataFrame, lookup: DataFrame, incoming: DataFrame, path: str, truncate: int | None = 1000, classifier: enrich.Classifier | None = None, config: enrich.EnrichConfig = enrich.EnrichConfig(), members: DataFrame | None = None, encoder: embeddings.Encoder | None = None) -> dict[str, DataFrame]:
    """Take in the comments of ``incoming`` whose ids are new: only unanalysed rows are analysed, and all are clustered again.

    The ids of ``lookup`` are its own lists, or ``members`` (id, lookup_id) if given.
    """
    quality.truncation_gate(lookup, truncate)
    fresh = incoming.join(joins.new_ids(incoming, raw), "id", "left_semi")
    together = save(raw.unionByName(fresh), f"{path}/raw")
    known = dedup.pairs(lookup if members is None else members)
    rows, ids = dedup.fold_members(lookup.drop("comment_ids"), known, dedup.combined(texts_of(fresh), truncate))
    return finish(together, save(rows, f"{path}/folded"), save(ids, f"{path}/members"), path, classifier, config, encoder)
