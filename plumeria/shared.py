"""The shared folder: tables and files that every executor and the driver can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumeria/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` made, once nothing reads it any more; anything else is left alone."""
    spark = df.sparkSession
    found = {m[1] for f in df.inputFiles() if (m := re.match(r"(.*/plumeria/[^/]+-[0-9a-f]{32})/", f))}
    for folder in found:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a Hadoop-style URI, for code that runs in tasks."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def batches_of(uri: str, columns: list[str], rows: int):
    """Arrow batches of so many rows at most of a file of a written table, for code that runs in tasks."""
    import pyarrow.parquet as pq

    fs, path = filesystem(uri)
    with fs.open_input_file(path) as file:
        yield from pq.ParquetFile(file).iter_batches(rows, columns=columns)
