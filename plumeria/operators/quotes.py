"""Whether key quotes occur in their texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import clean_for_comparison, normalize_quotes, words, wrap
from .dedup import numbered

# Fixed values of the report.
WIDE, NARROW = "=" * 80, "-" * 40
SECTIONS = {"missing": (1, "QUOTES NOT FOUND"), "similar": (2, "QUOTES WITH SIMILAR MATCHES")}


def match_type(quote: Column, text: Column) -> Column:
    """exact (also after normalising quotes), similar (cleaned and over 20 characters, or most words in one sentence), missing; null without either."""
    q, t = clean_for_comparison(quote), clean_for_comparison(text)
    own = F.array_distinct(words(q))
    shared = lambda chunk: F.size(F.array_intersect(own, words(clean_for_comparison(chunk)))) >= F.size(own) * F.lit(0.8)
    close = (F.size(own) > 5) & F.exists(F.split(text, "[.!?]"), shared)
    exact = F.contains(text, quote) | F.contains(normalize_quotes(text), normalize_quotes(quote))
    found = F.when(exact, "exact").when((F.length(q) > 20) & F.contains(t, q), "similar").when(close, "similar").otherwise("missing")
    return F.when((F.coalesce(quote, F.lit("")) != "") & (F.coalesce(text, F.lit("")) != ""), found)


def verify(lookup: DataFrame, quote: str = "key_quote", text: str = "truncated_text") -> DataFrame:
    """Rows with their match_type and, for exact matches, the quote's 0-based place."""
    return lookup.withColumn("match_type", match_type(F.col(quote), F.col(text))).withColumn("position", F.when(F.col("match_type") == "exact", F.position(F.col(quote), F.col(text)) - 1))


def rates(verified: DataFrame) -> DataFrame:
    """Totals, and rates of rows with quotes in percent (half-even, one decimal); null rates without quotes."""
    kinds = {k: F.count_if(F.col("match_type") == k) for k in ("exact", "similar", "missing")}
    n = F.count("match_type")
    rate = lambda c: F.when(n > 0, F.bround(c / n * 100, 1))
    return verified.agg(F.count(F.lit(1)).alias("total"), n.alias("with_quotes"), *(c.alias(k) for k, c in kinds.items()), rate(kinds["exact"]).alias("exact_rate"), rate(kinds["exact"] + kinds["similar"]).alias("found_rate"))


def problems(verified: DataFrame) -> DataFrame:
    return verified.filter(F.col("match_type").isin("similar", "missing"))


def report(verified: DataFrame) -> DataFrame:
    """(section, number, lookup_id, text): the text report's parts in order, of ``verified`` lookup rows.

    Section 0 is the summary; in 1, quotes not found, and 2, similar ones, number 0 is the heading and the entries follow
    in the order of lookup_id, with up to five of their comment_ids if there are any. Entries are made and numbered in
    tasks, so the report may be as long as the table.
    """
    count = F.coalesce(F.col("comment_count"), F.lit(0))
    share = lambda c: F.concat(c.cast("string"), F.lit(" ("), F.coalesce(F.bround(c / F.nullif(F.col("with_quotes"), F.lit(0)) * 100, 1), F.lit(0)).cast("string"), F.lit("%)"))
    totals = rates(verified).crossJoin(verified.agg(F.coalesce(F.sum(count), F.lit(0)).alias("comments")))  # a row each
    lines = [
        F.lit(f"QUOTE VERIFICATION REPORT\n{WIDE}\n\nSUMMARY\n{NARROW}"),
        F.concat(F.lit("Total lookup entries: "), "total"),
        F.concat(F.lit("Total comments represented: "), "comments"),
        F.concat(F.lit("Lookup entries with quotes: "), "with_quotes"),
        F.concat(F.lit("Quotes found (exact): "), share(F.col("exact"))),
        F.concat(F.lit("Quotes found (similar): "), share(F.col("similar"))),
        F.concat(F.lit("Quotes NOT found: "), share(F.col("missing"))),
        F.concat(F.lit("Overall verification rate: "), F.coalesce("found_rate", F.lit(0)).cast("string"), F.lit("%\n")),
    ]
    none = F.lit(None).cast("string")
    summary = totals.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("number"), none.alias("lookup_id"), F.concat_ws("\n", *lines).alias("text"))

    @F.pandas_udf(StringType())
    def wrapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "\n".join(f"   {x}" for x in wrap(t or "", 77).split("\n")))

    listed = F.col("comment_ids") if "comment_ids" in verified.columns else F.lit(None).cast("array<string>")
    section = F.when(F.col("match_type") == "missing", 1).otherwise(2)
    rows = problems(verified).select("lookup_id", section.alias("section"), count.alias("n"), listed.alias("ids"), F.col("key_quote").alias("quote"), F.col("truncated_text").alias("body"))
    placed = numbered(rows.select("section", "lookup_id"), ["section", "lookup_id"], "place")
    heads = placed.groupBy("section").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("entries"))
    number = (F.col("place") - F.col("first") + 1).alias("number")
    entries = rows.join(placed, ["section", "lookup_id"]).join(heads, "section").select("*", number)
    opening = F.concat(F.col("number"), F.lit(". Lookup ID: "), "lookup_id", F.lit("\n   Represents "), "n", F.lit(" comment(s)\n"))
    ids = F.when(F.col("ids").isNotNull(), F.concat(F.lit("   Comment IDs: "), F.array_join(F.slice(F.col("ids").cast("array<string>"), 1, 5), ", "), F.when(F.size("ids") > 5, "...").otherwise(""), F.lit("\n"))).otherwise("")
    quote = F.concat(F.lit('   QUOTE: "'), "quote", F.lit('"\n'))
    missing = F.concat(opening, ids, F.lit("\n"), quote, F.lit("\n   TRUNCATED TEXT ("), F.length("body"), F.lit(" characters):\n"), wrapped(F.when(F.col("section") == 1, F.col("body"))), F.lit(f"\n{'-' * 80}\n"))
    similar = F.concat(opening, quote, F.lit(f"   MATCH INFO: Found similar (not exact)\n{NARROW}\n"))
    blocks = entries.select("section", "number", "lookup_id", F.when(F.col("section") == 1, missing).otherwise(similar).alias("text"))
    title = F.when(F.col("section") == 1, SECTIONS["missing"][1]).otherwise(SECTIONS["similar"][1])
    headings = heads.select("section", F.lit(0).cast("long").alias("number"), none.alias("lookup_id"), F.concat(F.lit("\n"), title, F.lit(" ("), "entries", F.lit(f" entries)\n{WIDE}\n")).alias("text"))
    return summary.unionByName(headings).unionByName(blocks)
