"""The hierarchical cluster report: a table of the tree's nodes, its text, and the text read back.

Every lookup row counts in its own cluster and in all that hold it; its path code is cut into prefixes, so one
pass over the rows rolls the whole tree up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_ws
from ..operators.stats import keywords, top_n

# Fixed values of the report: how many entries are shown, how long, and its headings.
KEYWORDS, EXAMPLES, DEVIATIONS, IDS, WIDTH = 10, 3, 5, 3, 200
TITLE = "HIERARCHICAL CLUSTERING REPORT"
UNKNOWN = "Unknown"
ENTRY = "struct<lookup_id:string,stance:string,comment_count:int,comment_ids:array<string>,more_ids:int,key_quote:string,rationale:string,preview:string>"
TREE = f"cluster_id string, level int, unique_texts long, total_comments long, keywords array<string>, dominant string, stances array<struct<stance:string,n:long>>, examples array<{ENTRY}>, deviations array<{ENTRY}>, more_deviations long"


def prefixes(code: Column) -> Column:
    """The codes of a path, from the main cluster down: its number, then a letter for each level."""
    number = F.length(F.regexp_extract(code, "^([0-9]*)", 1))
    return F.transform(F.sequence(number, F.length(code)), lambda n: F.left(code, n))


def tree(lookup: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each node of the clusters' tree, of lookup rows (lookup_id, cluster_id, stance, truncated_text, comment_count, key_quote, rationale).

    ids are members (id, lookup_id), of which each shown row gets the first few; rows without a cluster are left
    out. Null stances are ``Unknown``. The dominant stance has most comments, of equal ones the least name;
    rows are shown by lookup_id. White space in shown texts is one space, so that a line holds them.
    """
    line = lambda c: trim_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    text = line("truncated_text")
    shown = F.when(F.length(text) > WIDTH, F.concat(F.left(text, F.lit(WIDTH)), F.lit("..."))).otherwise(text)
    base = lookup.filter("cluster_id is not null").select("cluster_id", "lookup_id", F.coalesce("stance", F.lit(UNKNOWN)).alias("stance"), F.coalesce(F.col("comment_count"), F.lit(0)).cast("int").alias("comment_count"), line("key_quote").alias("key_quote"), line("rationale").alias("rationale"), shown.alias("preview"), "truncated_text")
    nodes = base.select(F.explode(prefixes(F.col("cluster_id"))).alias("cluster_id"), *(c for c in base.columns if c != "cluster_id"))
    by = nodes.groupBy("cluster_id", "stance").agg(F.sum("comment_count").alias("n"), F.count(F.lit(1)).alias("texts"))
    best = F.max_by("stance", F.struct("n", F.transform(F.split("stance", ""), lambda c: -F.ascii(c)))).alias("dominant")
    stances = F.sort_array(F.collect_list(F.struct("stance", "n"))).alias("stances")  # a few stances for each node
    totals = by.groupBy("cluster_id").agg(F.sum("texts").alias("unique_texts"), F.sum("n").alias("total_comments"), best, stances)
    words = keywords(nodes.select("cluster_id", "truncated_text"), "cluster_id", "truncated_text", KEYWORDS)
    words = words.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    told = nodes.join(totals.select("cluster_id", "dominant"), "cluster_id")
    agrees = F.col("stance") == F.col("dominant")
    entries = top_n(told.withColumn("agrees", agrees), ["cluster_id", "agrees"], [F.col("lookup_id")], max(EXAMPLES, DEVIATIONS), "rank").filter((F.col("rank") <= EXAMPLES) | ~F.col("agrees"))
    entries = entries.filter((F.col("rank") <= DEVIATIONS) | F.col("agrees"))
    if ids is None:
        first = entries.select("lookup_id").distinct().withColumns({"comment_ids": F.array().cast("array<string>"), "more_ids": F.lit(0)})
    else:
        members = ids.join(entries.select("lookup_id").distinct(), "lookup_id").select("lookup_id", "id")
        counted = members.groupBy("lookup_id").agg(F.count(F.lit(1)).alias("n"))
        first = top_n(members, "lookup_id", [F.col("id")], IDS, "rank").groupBy("lookup_id").agg(F.array_sort(F.collect_list("id")).alias("comment_ids")).join(counted, "lookup_id")
        first = first.select("lookup_id", "comment_ids", F.greatest(F.lit(0), F.col("n") - IDS).cast("int").alias("more_ids"))
    entries = entries.join(first, "lookup_id", "left").withColumn("comment_ids", F.coalesce("comment_ids", F.array().cast("array<string>"))).withColumn("more_ids", F.coalesce("more_ids", F.lit(0)))
    entry = F.struct("lookup_id", "stance", "comment_count", "comment_ids", "more_ids", "key_quote", "rationale", "preview")
    listed = lambda kind: F.sort_array(F.collect_list(F.when(kind, entry)))
    shown_by = entries.groupBy("cluster_id").agg(listed(F.col("agrees")).alias("examples"), listed(~F.col("agrees")).alias("deviations"))
    others = told.groupBy("cluster_id").agg(F.count_if(~agrees).alias("others"))
    out = totals.join(words, "cluster_id", "left").join(shown_by, "cluster_id").join(others, "cluster_id")
    level = F.length(F.regexp_replace("cluster_id", "^[0-9]*", ""))
    more = F.greatest(F.lit(0), F.col("others") - DEVIATIONS).cast("long")
    plain = out.select("cluster_id", level.alias("level"), "unique_texts", "total_comments", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "dominant", "stances", "examples", "deviations", more.alias("more_deviations"))
    return plain.select(*(F.col(f.name).cast(f.dataType) for f in lookup.sparkSession.createDataFrame([], TREE).schema.fields))


def _natural(code: str) -> tuple:
    number = re.match("[0-9]*", code)[0]
    return int(number or 0), code[len(number) :]


def text(nodes: DataFrame) -> str:
    """The report of ``tree``'s rows: a few for each cluster, so the driver writes it. Children stand below their parent, two spaces further in."""
    rows = sorted(nodes.collect(), key=lambda r: _natural(r.cluster_id))
    out = [TITLE, "=" * 80, ""]
    for k, r in enumerate(rows):
        pad = "  " * r.level
        body = [f"CLUSTER {r.cluster_id}", "-" * 40, f"Level: {r.level}", f"Unique texts: {r.unique_texts}", f"Total comments: {r.total_comments}", f"Keywords: {', '.join(r.keywords)}"]
        share = lambda n, total=r.total_comments: n / total * 100 if total else 0.0
        body += [f"Dominant stance: {r.dominant} ({share(dict(r.stances)[r.dominant]):.1f}% purity)", "Stance distribution:", *(f"  {s}: {n} ({share(n):.1f}%)" for s, n in r.stances)]
        for heading, entries in ((f"EXAMPLES OF DOMINANT STANCE ({r.dominant}):", r.examples), ("DEVIATIONS FROM DOMINANT STANCE:", r.deviations)):
            if entries:
                body += ["", heading, "~" * 60]
            for i, e in enumerate(entries, 1):
                more = f" (and {e.more_ids} more)" if e.more_ids else ""
                body += [f"{i}. Lookup ID: {e.lookup_id}", f"   STANCE: {e.stance}", f"   Comment Count: {e.comment_count}", f"   Comment IDs: {', '.join(e.comment_ids)}{more}", f'   Key Quote: "{e.key_quote}"', f"   LLM Rationale: {e.rationale}", f"   Text Preview: {e.preview}", "   " + "-" * 40]
        if r.more_deviations:
            body.append(f"   ... and {r.more_deviations} more deviations")
        if k + 1 < len(rows) and rows[k + 1].level > r.level:
            body += ["", "SUBCLUSTERS:"]
        out += [f"{pad}{x}" if x else "" for x in body] + [""]
    return "\n".join(out)


def parse(report: str) -> list[tuple]:
    """``tree``'s rows of a report's text. A heading opens a node at its indent, which is its level; what follows at that indent is its own."""
    nodes: list[dict] = []
    part = None
    for raw in report.split("\n"):
        line = raw.strip(" ")
        if m := re.fullmatch(r"( *)CLUSTER ([0-9]+[a-z]*)", raw):
            nodes.append({"cluster_id": m[2], "level": len(m[1]) // 2, "keywords": [], "stances": [], "examples": [], "deviations": [], "more_deviations": 0})
            part = None
            continue
        if not nodes:
            continue
        node = nodes[-1]
        key, _, value = line.partition(": ")
        if line.startswith("EXAMPLES OF DOMINANT STANCE"):
            part = "examples"
        elif line.startswith("DEVIATIONS FROM DOMINANT STANCE"):
            part = "deviations"
        elif line == "Stance distribution:":
            part = "stances"
        elif m := re.fullmatch(r"\.\.\. and ([0-9]+) more deviations", line):
            node["more_deviations"] = int(m[1])
        elif part in ("examples", "deviations"):
            _entry(node[part], re.sub(r"^[0-9]+\. (?=Lookup ID$)", "", key), value)
        elif part == "stances" and (m := re.fullmatch(r"(.*): ([0-9]+) \([0-9.]+%\)", line)):
            node["stances"].append((m[1], int(m[2])))
        elif key in ("Unique texts", "Total comments"):
            node[key.lower().replace(" ", "_")] = int(value)
        elif key in ("Keywords", "Keywords:"):
            node["keywords"] = [w for w in value.split(", ") if w]
        elif key == "Dominant stance":
            node["dominant"] = re.sub(r" \([0-9.]+% purity\)$", "", value)
    return [tuple(n.get(f) for f in ("cluster_id", "level", "unique_texts", "total_comments", "keywords", "dominant", "stances", "examples", "deviations", "more_deviations")) for n in nodes]


def _entry(entries: list[dict], key: str, value: str) -> None:
    fields = {"STANCE": "stance", "LLM Rationale": "rationale", "LLM Rationale:": "rationale", "Text Preview": "preview", "Text Preview:": "preview"}
    if key == "Lookup ID":
        entries.append({"lookup_id": value, "stance": None, "comment_count": None, "comment_ids": [], "more_ids": 0, "key_quote": "", "rationale": "", "preview": ""})
    elif not entries:
        return
    elif key in fields:
        entries[-1][fields[key]] = value
    elif key == "Comment Count":
        entries[-1]["comment_count"] = int(value)
    elif key == "Key Quote":
        entries[-1]["key_quote"] = value[1:-1]
    elif key == "Comment IDs" and value:
        m = re.fullmatch(r"(.*?)(?: \(and ([0-9]+) more\))?", value)
        entries[-1] |= {"comment_ids": [i for i in m[1].split(", ") if i], "more_ids": int(m[2] or 0)}


def read(spark: SparkSession, path: str) -> DataFrame:
    """``tree``'s rows of the report files at ``path``; each file is one cell, read by a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for report in frame["value"] for row in parse(report)]
            yield pd.DataFrame(rows, columns=["cluster_id", "level", "unique_texts", "total_comments", "keywords", "dominant", "stances", "examples", "deviations", "more_deviations"]).assign(stances=lambda d: d["stances"].map(lambda own: [{"stance": s, "n": n} for s, n in own]))

    return spark.read.text(path, wholetext=True).mapInPandas(run, TREE)
