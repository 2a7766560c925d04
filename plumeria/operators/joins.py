"""Joins of comments, lookup rows, clusters and id sets.

Where a lookup table only tells which ids it has, its members (id, lookup_id) do as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_ws
from ..schemas import LOOKUP, LOOKUP_DEFAULTS
from .dedup import bridge, pairs


def flatten(raw: DataFrame) -> DataFrame:
    """Nested comments as flat rows with snake-case names."""
    names = {"comment_on": "commentOn", "posted_date": "postedDate", "received_date": "receivedDate", "submitter_name": "submitterName", "document_type": "documentType", "agency_id": "agencyId"}
    own = ("title", "comment_on", "posted_date", "received_date", "submitter_name", "organization", "city", "state", "country", "comment", "document_type", "agency_id", "category")
    text = lambda n: F.coalesce(F.col(f"attributes.{names.get(n, n)}"), F.lit("")).alias(n)
    joined = lambda f: F.coalesce(F.array_join(F.transform("attributes.attachments", lambda a: F.coalesce(a[f], F.lit(""))), "; "), F.lit(""))
    count = F.coalesce("attributes.attachmentCount", F.lit(0))
    return raw.select(
        "id", *map(text, own), F.coalesce("attributes.comment", F.lit("")).alias("original_comment"), count.alias("attachment_count"), (count > 0).alias("has_attachments"),
        joined("fileUrl").alias("attachment_urls"), joined("title").alias("attachment_titles"), joined("localPath").alias("attachment_local_paths"),
    )


def merge(comments: DataFrame, lookup: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Comments with their first lookup entry's fields, or the defaults; ids come from ``members`` or the lookup rows' lists."""
    types = {f.name: f.dataType for f in LOOKUP.fields} | {"corrected": "boolean"}
    have = [c for c in LOOKUP_DEFAULTS if c in lookup.columns]
    out = comments.join(bridge(lookup if members is None else members), "id", "left").join(lookup.select(*have), "lookup_id", "left")
    filled = {k: F.coalesce(F.col(k), F.lit(v).cast(types[k])) if k in have else F.lit(v).cast(types[k]) for k, v in LOOKUP_DEFAULTS.items() if k != "lookup_id"}
    return out.withColumns(filled)


def orphans(lookup: DataFrame, comments: DataFrame) -> DataFrame:
    """Ids of the lookup table without a comment."""
    return bridge(lookup).join(comments.select("id"), "id", "left_anti")


def unmatched(comments: DataFrame, lookup: DataFrame) -> DataFrame:
    return comments.join(bridge(lookup).select("id"), "id", "left_anti")


def new_ids(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return incoming.select("id").distinct().join(known.select("id"), "id", "left_anti")


def described(comments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Comments with their cluster's title and description; Spark broadcasts the dimension if its size allows."""
    return comments.join(clusters.select("cluster_id", F.col("title").alias("cluster_title"), "description"), "cluster_id", "left")


def primary_ids(comments: DataFrame, lookup: DataFrame) -> DataFrame:
    """The least id of each lookup group; all comments without a lookup row share one survivor."""
    known = lookup.select("lookup_id").distinct().withColumn("_known", F.col("lookup_id"))
    return comments.select("id", "lookup_id").join(known, "lookup_id", "left").groupBy("_known").agg(F.min("id").alias("id")).select("id")


def primary_only(comments: DataFrame, lookup: DataFrame) -> DataFrame:
    return comments.join(primary_ids(comments, lookup), "id", "left_semi")


def related(comments: DataFrame, lookup: DataFrame, lookup_id: str) -> DataFrame:
    """Comments of one lookup row; none if it is missing."""
    return comments.join(pairs(lookup.filter(F.col("lookup_id") == lookup_id)).select("id"), "id", "left_semi")


def sidecar_texts(lookup: DataFrame, texts: DataFrame) -> DataFrame:
    """(lookup_id, text): texts (id, text) of a row's ids, joined in the order of its list, or of members (id, seq, lookup_id) by seq."""
    ids = lookup.select("lookup_id", F.posexplode("comment_ids").alias("pos", "id")) if "comment_ids" in lookup.columns else lookup.select("lookup_id", F.col("seq").alias("pos"), "id")
    each = ids.join(texts, "id")
    listed = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return each.groupBy("lookup_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("text"))


def rebuilt_texts(lookup: DataFrame, members: DataFrame, comments: DataFrame, attachments: DataFrame, updated: DataFrame, most: int = 1000) -> DataFrame:
    """``lookup`` with new truncated_text and text_source in the rows that have an id of ``updated`` (id).

    The text is that of all members (id, seq, lookup_id) in their order: the comment (id, comment) and then its
    attachments (id, name, text) by name, stripped, empty ones left out, with a blank line between and cut at ``most``
    characters without dots. The source is ``both``, ``attachment`` or ``comment``; an attachment without a text counts
    for it. Each piece adds three characters or more, so the first ``(most + 4) // 3`` of a row are all that its text can
    need, and no task holds more of a row that many comments share.
    """
    touched = members.join(updated.select("id").distinct(), "id", "left_semi").select("lookup_id").distinct()
    own = members.select("id", "seq", "lookup_id").join(touched, "lookup_id", "left_semi")
    said = own.join(comments.filter("comment != ''").select("id", F.lit(False).alias("attached"), F.lit("").alias("name"), F.substring("comment", 1, most).alias("piece")), "id")
    added = own.join(attachments.select("id", F.lit(True).alias("attached"), "name", F.substring(trim_ws(F.col("text")), 1, most).alias("piece")), "id")
    pieces = said.unionByName(added)
    first = Window.partitionBy("lookup_id").orderBy("seq", "id", "attached", "name")
    needed = pieces.filter("piece != ''").withColumn("at", F.row_number().over(first)).filter(F.col("at") <= (most + 4) // 3)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "\n\n")
    text = needed.groupBy("lookup_id").agg(F.substring(joined, 1, most).alias("_text"))
    source = pieces.groupBy("lookup_id").agg(F.bool_or("attached").alias("_attached"), F.bool_or(~F.col("attached")).alias("_said"))
    found = touched.join(text, "lookup_id", "left").join(source, "lookup_id", "left").withColumn("_touched", F.lit(True))
    kind = F.when(F.col("_attached") & F.col("_said"), "both").when(F.col("_attached"), "attachment").otherwise("comment")
    new = {"truncated_text": F.when(F.col("_touched"), F.coalesce("_text", F.lit(""))).otherwise(F.col("truncated_text")), "text_source": F.when(F.col("_touched"), kind).otherwise(F.col("text_source"))}
    return lookup.join(found, "lookup_id", "left").withColumns(new).drop("_text", "_attached", "_said", "_touched")


def relabel(lookup: DataFrame, found: DataFrame) -> DataFrame:
    """Put cluster_id, pca_x and pca_y of ``found`` on the lookup table; rows that it has not got keep theirs."""
    names = ("cluster_id", "pca_x", "pca_y")
    new = found.select("lookup_id", *(F.col(n).alias(f"_{n}") for n in names))
    return lookup.join(new, "lookup_id", "left").withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop(*(f"_{n}" for n in names))


def membership(**sets: DataFrame) -> DataFrame:
    """(id, in_<name>...) of every id in any set (one column, id)."""
    marked = [df.select("id", *(F.lit(n == name).alias(f"in_{n}") for n in sets)) for name, df in sets.items()]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df)
    return out.groupBy("id").agg(*(F.bool_or(f"in_{n}").alias(f"in_{n}") for n in sets))
