"""Writers: tables, JSON, CSV pages, versioned folders, reports."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview, wrap
from ..ledger import Ledger
from ..operators.dedup import upsert
from ..shared import discard, written


def version_dir(base: str, prefix: str = "results", now: datetime | None = None) -> str:
    return f"{base.rstrip('/')}/{prefix}_{(now or datetime.now(UTC)):%Y%m%d_%H%M%S}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme and authority."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def save(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet, replacing what is there, and read it back; a path that ``df`` reads from is refused."""
    own = qualified(df.sparkSession, path) + "/"
    if any(qualified(df.sparkSession, f).startswith(own) for f in df.inputFiles()):
        raise ValueError(f"{path} is read by what would replace it")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_upsert(old: DataFrame, new: DataFrame, key: str, path: str, order: str | None = None) -> DataFrame:
    """Merge into a new version; the old one is left as it is."""
    return save(upsert(old, new, key, order), path)


def csv_field(c: Column, kind: str) -> Column:
    """Texts in quotes, doubled inside; numbers and booleans bare; null empty."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')) if kind in ("string", "date", "timestamp", "timestamp_ntz") else text, F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of each row, scalar columns only."""
    kinds = [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    return df.select(F.concat_ws(",", *(csv_field(F.col(f"`{c}`"), t) for c, t in kinds)).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join(f'"{c}"' for c, t in df.dtypes if not t.startswith(("array", "map", "struct")))


def cluster_report(clusters: DataFrame, examples: DataFrame, width: int = 200) -> str:
    """Text of a (cluster_id, total_comments, unique_texts, dominant, purity) table with (cluster_id, text) examples; both have a few rows for each cluster."""
    shown: dict[str, list[str]] = {}
    for row in examples.select("cluster_id", preview(F.col("text"), width).alias("text")).collect():
        shown.setdefault(row.cluster_id, []).append(row.text)
    out = []
    for c in clusters.orderBy(F.desc("total_comments"), "cluster_id").collect():
        out += [f"CLUSTER {c.cluster_id}", f"Total comments: {c.total_comments}", f"Unique texts: {c.unique_texts}", f"Dominant stance: {c.dominant} ({c.purity:.1%})"]
        out += [f"  - {wrap(t)}" for t in shown.get(c.cluster_id, [])] + [""]
    return "\n".join(out)


def quote_report(parts: DataFrame, path: str) -> None:
    """The parts of ``quotes.report`` as text files, whose lines in the order of the files' names are the report."""
    parts.orderBy("section", "number").select("text").write.text(path)


def length_histogram(df: DataFrame, text: str, width: int = 100) -> DataFrame:
    """(bucket, n): what a length plot draws."""
    return df.groupBy((F.floor(F.length(F.coalesce(text, F.lit(""))) / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket")


def sidecar_name(path: Column) -> Column:
    return F.concat(path, F.lit(".extracted.txt"))


def checkpoint(batch: DataFrame, path: str, key: str = "lookup_id") -> Ledger:
    """Commit the rows of ``batch`` that the ledger below ``path`` has not got; a repeated batch adds nothing."""
    ledger = Ledger(batch.sparkSession, path, batch.schema, key)
    fresh = written(ledger.pending(batch), "fresh")
    if fresh.limit(1).count():
        ledger.append(fresh)
    discard(fresh)
    return ledger


def promote(spark: SparkSession, version: str, base: str) -> None:
    """Make ``version`` the one that ``current`` gives: one small file is replaced, no data is copied or deleted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/CURRENT")
    out = pointer.getFileSystem(conf).create(pointer, True)
    out.write(bytearray(version.encode()))
    out.close()


def current(spark: SparkSession, base: str) -> str:
    return spark.read.text(f"{base.rstrip('/')}/CURRENT", wholetext=True).first().value
