"""The shared folder, and files in it for code that runs in tasks."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame

from ..shared import discard, new_path, shared_dir, written

__all__ = ["bucketed", "discard", "filesystem", "new_path", "shared_dir", "written"]


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``written``, in buckets of ``key``: a join on it moves the other side only.

    The name in the catalog goes at once; the files stay.
    """
    spark = df.sparkSession
    table, buckets = f"plumeria_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a Hadoop-style URI, for code that runs in tasks."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)
