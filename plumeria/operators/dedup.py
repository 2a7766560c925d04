"""The lookup table: one row for each normalised text, and the ids that share it.

Its two parts are kept apart at scale: lookup rows, without ids, and members (id, seq, lookup_id), one row for each
comment. A list of ids in a lookup row is the form of the exported file, and only ``with_ids`` makes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import combine, lookup_id, lookup_number, normalize_for_dedup, trim_ws, truncate
from ..shared import written

ANALYSIS = {"stance": "string", "key_quote": "string", "rationale": "string", "themes": "string", "corrected": "boolean", "cluster_id": "string", "pca_x": "double", "pca_y": "double"}
TEXTS = ("truncated_text", "text_source", "comment_text", "attachment_text")
ROW_BITS = 33  #: bits of ``monotonically_increasing_id`` that number the rows of a partition


def numbered(rows: DataFrame, by: list[str] | str, name: str, start: int = 0) -> DataFrame:
    """Add 1-based sequential numbers in the order of the columns ``by``; ``rows`` should hold no texts.

    Rows are dealt into ranges, sorted, and written with their range and their place in it; all that
    follows reads that table, so the numbers can't depend on a second dealing. Sizes of ranges, a row for
    each, move the places; no task holds all rows.
    """
    by = [by] if isinstance(by, str) else by
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    before = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("_before"))
    return placed.withColumn("_part", part).join(before, "_part").withColumn(name, (place + 1 + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def combined(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """``raw`` (id, seq, comment, attachment_texts) with its combined and truncated text; blank texts are left out."""
    out = raw.withColumn("_c", combine(F.col("comment"), F.col("attachment_texts"))).select("*", "_c.*").drop("_c")
    out = out.withColumn("truncated_text", truncate(F.col("full_text"), limit) if limit else F.col("full_text"))
    return out.filter(trim_ws(F.col("truncated_text")) != "")


def text_key(text: Column | str = "truncated_text") -> Column:
    """32 bytes that stand for a normalised text in shuffles: its SHA-256. Never null, so that no join filters by it first."""
    digest = F.unhex(F.sha2(normalize_for_dedup(F.col(text) if isinstance(text, str) else text).cast("binary"), 256))
    return F.coalesce(digest, F.lit("").cast("binary"))


def keyed(texts: DataFrame) -> DataFrame:
    """(text_key, seq, id) of ``combined`` rows, a written table: the texts are normalised once."""
    return written(texts.select(text_key().alias("text_key"), "seq", "id"), "keys")


def entries(texts: DataFrame, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Different texts of ``combined`` rows, numbered by first appearance, and what belongs to them.

    The first is (text_key, seq, first_id, comment_count, lookup_id), the second members (id, seq,
    lookup_id); ``seq`` is the order of input, and id and ``seq`` name a row. Only keys and numbers are
    shuffled: once by key, counted before, and once into ranges of ``seq``. Both read written tables.
    """
    keys = keyed(texts)
    found = _number(_counted(keys), start)
    return found, _members(keys, found)


def _counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy("text_key").agg(F.min("seq").alias("seq"), F.min_by("id", "seq").alias("first_id"), F.count(F.lit(1)).alias("comment_count"))


def _number(counted: DataFrame, start: int) -> DataFrame:
    return numbered(counted, ["seq", "text_key"], "_number", start).withColumn("lookup_id", lookup_id(F.col("_number"))).drop("_number")


def _members(keys: DataFrame, found: DataFrame) -> DataFrame:
    return keys.join(found.select("text_key", "lookup_id"), "text_key").select("id", "seq", "lookup_id")


def lookup_rows(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The lookup rows of ``found`` (see ``entries``): fields of the first row of each text, analysis fields empty.

    Each text moves once at most. Of rows that share id and ``seq``, the least fields count.
    """
    fields = [*(F.col(t) for t in TEXTS), F.length("full_text").alias("full_text_length")]
    first = found.select("seq", F.col("first_id").alias("id"), "comment_count", "lookup_id")
    rows = texts.select("id", "seq", F.struct(*fields).alias("f")).join(first, ["id", "seq"])
    rows = rows.groupBy("id", "seq", "comment_count", "lookup_id").agg(F.min("f").alias("f"))
    rows = rows.select("seq", "lookup_id", F.col("comment_count").cast("int").alias("comment_count"), "f.*").withColumn("truncated_text_length", F.length("truncated_text"))
    return rows.withColumns({k: F.lit(None).cast(v) for k, v in ANALYSIS.items()})


def with_ids(lookup: DataFrame, ids: DataFrame) -> DataFrame:
    """The file's form: ``lookup`` with the list of its ids in input order, from members (id, seq, lookup_id). A list is one row's content, so it must fit one."""
    listed = ids.groupBy("lookup_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("comment_ids"))
    return lookup.join(listed, "lookup_id")


def create_lookup(texts: DataFrame, start: int = 0) -> DataFrame:
    """Lookup rows of ``combined`` texts in the file's form: the first row's fields, ids in input order, numbered by first appearance."""
    found, ids = entries(texts, start)
    return with_ids(lookup_rows(texts, found), ids)


def in_order(lookup: DataFrame) -> DataFrame:
    return lookup.orderBy(F.desc("comment_count"), "lookup_id")


def pairs(lookup: DataFrame) -> DataFrame:
    """(id, lookup_id) of lookup rows with lists of ids, or of members as they are."""
    return lookup.select(F.explode("comment_ids").alias("id"), "lookup_id") if "comment_ids" in lookup.columns else lookup.select("id", "lookup_id")


def bridge(lookup: DataFrame) -> DataFrame:
    """(id, lookup_id): each id's first lookup entry, from ``pairs``."""
    return pairs(lookup).groupBy("id").agg(F.min("lookup_id").alias("lookup_id"))


def fold_members(lookup: DataFrame, known: DataFrame, new_texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``combined`` rows to lookup rows without lists and their members ``known`` (id, lookup_id): (lookup rows, members).

    Known texts get the members they have not got; new texts get the next numbers. Only keys, ids and
    numbers are shuffled, and the texts of new rows.
    """
    old = written(lookup.select(text_key().alias("text_key"), "lookup_id"), "known")
    start = old.agg(F.max(lookup_number(F.col("lookup_id")))).first()[0] or 0
    keys = keyed(new_texts)
    fresh = _number(_counted(keys.join(old, "text_key", "left_anti")), start)
    hits = keys.join(old, "text_key").select("id", "seq", "lookup_id")
    hits = hits.groupBy("id", "lookup_id").agg(F.min("seq").alias("seq")).join(known.select("id", "lookup_id"), ["id", "lookup_id"], "left_anti")
    more = hits.groupBy("lookup_id").agg(F.count(F.lit(1)).cast("int").alias("_more"))
    kept = lookup.join(more, "lookup_id", "left").withColumn("comment_count", F.col("comment_count") + F.coalesce("_more", F.lit(0))).drop("_more", "seq")
    rows = kept.unionByName(lookup_rows(new_texts, fresh).drop("seq"), allowMissingColumns=True)
    return rows, known.select("id", "lookup_id").unionByName(hits.select("id", "lookup_id")).unionByName(_members(keys, fresh).select("id", "lookup_id"))


def fold(lookup: DataFrame, new_texts: DataFrame) -> DataFrame:
    """``fold_members`` on the file's form: known texts' lists go on with the ids they have not got, in input order."""
    known = lookup.select("lookup_id", F.posexplode("comment_ids").alias("_at", "id"))
    rows, ids = fold_members(lookup.drop("comment_ids"), known.select("id", "lookup_id").distinct(), new_texts)
    first = known.groupBy("id", "lookup_id").agg(F.min("_at").alias("_at"))
    order = new_texts.groupBy("id").agg(F.min("seq").alias("_seq"))
    ordered = ids.join(first, ["id", "lookup_id"], "left").join(order, "id", "left").select("id", "lookup_id", F.struct(F.col("_at").isNull().alias("new"), "_at", "_seq").alias("seq"))
    return with_ids(rows, ordered)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; of several new rows with one key, the last by ``order``."""
    if order:
        rest = [c for c in new.columns if c != key]
        new = new.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def summary(lookup: DataFrame) -> DataFrame:
    """total, unique, efficiency and reduction in percent (half-even, one decimal), ratio."""
    total, unique = F.sum("comment_count"), F.count(F.lit(1))
    return lookup.agg(total.alias("total"), unique.alias("unique_texts"), F.bround((1 - unique / total) * 100, 1).alias("efficiency"), F.bround(total / unique, 6).alias("ratio"))
