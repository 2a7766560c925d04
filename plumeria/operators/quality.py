"""Data quality: row rules, coverage, profiles, integrity of lookup tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import attachment_flags, lookup_number
from ..functions.values import is_iso_date
from ..schemas import COMMENT_ID, FIELDS, MAX_TRUNCATED, STANCES, TEXT_SOURCES, FieldSpec
from .dedup import pairs
from .joins import membership


class PipelineError(Exception):
    """Base of this library's errors."""


class ConfigurationError(PipelineError, ValueError):
    """A setting is out of range."""


class IntegrityError(PipelineError):
    """Tables that should agree do not."""


class TruncationError(IntegrityError):
    """A lookup table was made with another truncation."""


def issues(df: DataFrame, fields: tuple[FieldSpec, ...] = FIELDS) -> Column:
    """Array of what is wrong with a row."""
    found: list[Column] = []
    types = dict(df.dtypes)
    for f in fields:
        if f.name not in types:
            if f.required:
                found.append(F.lit(f"missing: {f.name}"))
            continue
        c = F.col(f"`{f.name}`")
        if not f.nullable:
            found.append(F.when(c.isNull(), f"null: {f.name}"))
        if types[f.name] != f.kind and not {types[f.name], f.kind} <= {"int", "bigint"}:
            found.append(F.when(c.isNotNull(), f"type: {f.name}"))
        elif f.date:
            found.append(F.when(c.isNotNull() & ~is_iso_date(c), f"date: {f.name}"))
        if f.allowed:
            found.append(F.when(~c.isin(*f.allowed), f"value: {f.name}"))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def validate(df: DataFrame, fields: tuple[FieldSpec, ...] = FIELDS) -> DataFrame:
    return df.withColumn("issues", issues(df, fields))


def report(validated: DataFrame) -> DataFrame:
    bad = F.count_if(F.size("issues") > 0)
    return validated.agg(F.count(F.lit(1)).alias("total"), bad.alias("with_issues"), (bad == 0).alias("passed"))


def sample_issues(validated: DataFrame, key: str = "id", n: int = 10) -> DataFrame:
    return validated.filter(F.size("issues") > 0).orderBy(key).limit(n)


def lookup_violations() -> Column:
    """Names of the schema rules that a lookup row breaks."""
    rules = {
        "lookup_id": ~F.col("lookup_id").rlike("^lookup_[0-9]{6,}$"), "text_source": ~F.col("text_source").isin(*TEXT_SOURCES), "truncated_text": F.length("truncated_text") > MAX_TRUNCATED,
        "comment_count": F.col("comment_count") < 1, "comment_ids": F.exists("comment_ids", lambda x: ~x.rlike(COMMENT_ID)), "stance": ~F.col("stance").isin(*STANCES, ""),
    }
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def coverage(df: DataFrame) -> DataFrame:
    """(field, present, non_null) of each column, in one pass."""
    row = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").isNotNull().alias("v")) for c in df.columns))
    return df.select(F.explode(row).alias("x")).groupBy("x.field").agg(F.count(F.lit(1)).alias("present"), F.count_if("x.v").alias("non_null"))


def _tokens(df: DataFrame) -> DataFrame:
    """(field, value): one row for each different value of a column, counted."""
    row = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))
    return df.select(F.explode(row).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """What each field looks like: always empty, null or the same; one or few values; mostly empty; mixed. Null and '' are values too."""
    empty = F.coalesce("value", F.lit("")) == ""
    per = _tokens(df).groupBy("field").agg(
        F.sum("n").alias("total"), F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("empty"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count(F.lit(1)).alias("values"), F.count_if(~empty).alias("filled_values")
    )
    kind = F.when(F.col("nulls") == F.col("total"), "always_null").when(F.col("empty") == F.col("total"), "always_empty").when(F.col("values") == 1, "always_same")
    kind = kind.when(F.col("filled_values") == 1, "single_unique").when(F.col("values").between(2, 3), "few_unique").when(F.col("empty") > 0.9 * F.col("total"), "mostly_empty").otherwise("mixed")
    return per.select("field", "total", "empty", "nulls", "values", kind.alias("category"))


def categoricals(df: DataFrame, most: int = 20) -> DataFrame:
    """(field, cardinality) of string columns with few different values once stripped."""
    texts = df.select(*(f"`{c}`" for c, t in df.dtypes if t == "string"))
    stripped = _tokens(texts).select("field", F.regexp_replace("value", "(?U)^\\s+|\\s+$", "").alias("value")).filter("value != ''").distinct()
    return stripped.groupBy("field").agg(F.count(F.lit(1)).alias("cardinality")).filter(F.col("cardinality") <= most).orderBy("cardinality", "field")


def shared_ids(lookup: DataFrame) -> DataFrame:
    """Ids that several lookup rows have, by their lists or by members (id, lookup_id)."""
    each = pairs(lookup).distinct()
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("entries"), F.min("lookup_id").alias("first")).filter("entries > 1")


def text_sources(lookup: DataFrame) -> DataFrame:
    return lookup.groupBy("text_source").agg(F.count(F.lit(1)).alias("n"))


def attachment_issues(lookup: DataFrame) -> DataFrame:
    return lookup.filter(attachment_flags(F.col("text_source"), F.col("truncated_text")))


def truncation_issues(lookup: DataFrame, tolerance: int = 5) -> DataFrame:
    """Rows whose recorded length is off."""
    return lookup.filter(F.abs(F.col("truncated_text_length") - F.length("truncated_text")) > tolerance)


def truncation_state(lookup: DataFrame) -> DataFrame:
    """(most, cut, longer): the longest recorded text, whether any text is cut, and whether any was longer than the longest."""
    sizes = lookup.agg(F.max("truncated_text_length").alias("most"), F.bool_or(F.col("full_text_length") > F.col("truncated_text_length")).alias("cut"), F.max("full_text_length").alias("_full"))
    return sizes.select("most", F.coalesce("cut", F.lit(False)).alias("cut"), F.coalesce(F.col("_full") > F.col("most"), F.lit(False)).alias("longer"))


def truncation_gate(lookup: DataFrame, requested: int | None, exact: bool = False) -> int | None:
    """The truncation to go on with; raises if the table was made with another one.

    ``exact`` demands that the longest text is as long as what is asked for. Without it, a cut table's
    longest text may have the three dots more, or be cut at a space beyond 80 %, and an uncut table's
    must not exceed what is asked for.
    """
    found = truncation_state(lookup).first()
    if found.most is None:
        return requested
    if requested is None:
        if found.longer if exact else found.cut:
            raise TruncationError("the table is truncated, and no truncation is asked for")
        return None
    least, most = (requested, requested) if exact else (0.8 * requested if found.cut else 0, requested + (3 if found.cut else 0))
    if not least <= found.most <= most:
        raise TruncationError(f"the table's longest text has {found.most} characters, {requested} are asked for")
    return requested


def completeness(lookup: DataFrame, attachments_only: bool = False) -> DataFrame:
    rows = lookup.filter(F.contains("text_source", F.lit("attachment"))) if attachments_only else lookup
    done = F.count_if(F.coalesce("stance", F.lit("")) != "")
    return rows.agg(F.count(F.lit(1)).alias("total"), done.alias("analysed"), F.count_if(F.col("stance").isNull()).alias("waiting"), F.count_if(F.col("stance") == "").alias("failed"))


def analysis_stats(lookup: DataFrame) -> DataFrame:
    """By stance: entries and comments; errors are entries whose rationale starts with ``Error:``."""
    return lookup.groupBy("stance").agg(F.count(F.lit(1)).alias("entries"), F.sum("comment_count").alias("comments"), F.count_if(F.col("rationale").startswith("Error:")).alias("errors"))


def failed_rows(lookup: DataFrame) -> DataFrame:
    """Rows whose analysis failed: their rationale starts with ``Error:``."""
    return lookup.filter(F.col("rationale").startswith("Error:"))


def max_lookup_number(lookup: DataFrame) -> DataFrame:
    return lookup.agg(F.max(lookup_number(F.col("lookup_id"))).alias("max_number"))


def set_checks(**sets: DataFrame) -> DataFrame:
    """(missing_from, found_in, n, status): ids of each set that another lacks."""
    marked, names = membership(**sets), list(sets)
    counts = [(a, b, F.count_if(F.col(f"in_{b}") & ~F.col(f"in_{a}"))) for a in names for b in names if a != b]
    row = marked.agg(F.array(*(F.struct(F.lit(a).alias("missing_from"), F.lit(b).alias("found_in"), n.alias("n")) for a, b, n in counts)).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*").withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))


def overall(checks: DataFrame) -> DataFrame:
    """The worst status."""
    level = reduce(lambda c, kv: c.when(F.col("status") == kv[0], kv[1]), (("WARN", 1), ("FAIL", 2)), F.when(F.col("status") == "PASS", 0))
    return checks.agg(F.max(level).alias("level")).select(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("level") + 1).alias("status"))


def output_check(csv: DataFrame, raw: DataFrame, data: DataFrame, lookup: DataFrame, members: DataFrame, excluded: tuple = ()) -> DataFrame:
    """One row on what a pipeline made: counts, ids that are missing, rows without analysis, its rate in percent, and whether all is valid.

    ``csv``, ``raw`` and ``data`` have an id. Excluded ids count in ``raw`` and ``data`` only. Rows whose
    analysis is incomplete, and data without a lookup row, are no errors.
    """
    own = lambda df: df.filter(~F.col("id").isin(*excluded)) if excluded else df
    sets = membership(csv=own(csv).select("id"), raw=own(raw).select("id"), lookup=own(pairs(members)).select("id"))
    found = sets.agg(F.count_if("in_csv").alias("csv_count"), F.count_if(F.col("in_csv") & ~F.col("in_raw")).alias("missing_from_raw"), F.count_if(F.col("in_raw") & ~F.col("in_lookup")).alias("missing_from_lookup"))
    whole = F.col("key_quote").isNotNull() & F.col("rationale").isNotNull() & F.col("themes").isNotNull()
    rows = F.count(F.lit(1))
    done = lookup.agg(rows.alias("lookup_entries"), F.count_if(F.col("stance").isNull()).alias("unanalysed"), F.count_if(F.col("stance").isNotNull() & ~whole).alias("partly_analysed"))
    sizes = raw.agg(rows.alias("raw_count")), data.agg(rows.alias("data_count"), F.count_if(F.col("lookup_id").isNull() | F.col("stance").isNull()).alias("data_without_lookup"))
    out = reduce(lambda a, b: a.join(b, "_one"), (df.withColumn("_one", F.lit(1)) for df in (found, done, *sizes))).drop("_one")
    valid = (F.col("csv_count") == F.col("raw_count")) & (F.col("raw_count") == F.col("data_count")) & (F.col("missing_from_lookup") == 0) & (F.col("unanalysed") == 0)
    rate = F.when(F.col("lookup_entries") > 0, (F.col("lookup_entries") - F.col("unanalysed")) / F.col("lookup_entries") * 100).otherwise(0.0)
    return out.withColumns({"analysis_rate": rate, "valid": valid})


def repair_lookup(lookup: DataFrame) -> DataFrame:
    """Fill missing text fields, drop ``corrected``, clip texts and lengths at the schema's limit."""
    out = lookup.drop("corrected")
    for name in ("truncated_text", "text_source", "comment_text", "attachment_text"):
        out = out.withColumn(name, F.coalesce(F.col(name) if name in out.columns else F.lit(None).cast("string"), F.lit("")))
    out = out.withColumn("truncated_text", F.substring("truncated_text", 1, MAX_TRUNCATED))
    return out.withColumn("truncated_text_length", F.least(F.length("truncated_text"), F.lit(MAX_TRUNCATED)))


def extraction_stats(files: DataFrame) -> DataFrame:
    """By extension of ``files`` (ext, text): number, with text, mean length, success in percent."""
    size = F.length(F.coalesce("text", F.lit("")))
    good = F.count_if(size >= 50)
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("total"), good.alias("with_text"), F.coalesce(F.floor(F.avg(F.when(size >= 50, size))), F.lit(0)).alias("mean_length"), (good / F.count(F.lit(1)) * 100).alias("success")).orderBy(F.desc("total"), "ext")
