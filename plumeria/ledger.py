"""A ledger of processed rows: parts that are written once and count once they are committed.

A part is a folder of Parquet files; it is committed by a small file that appears whole, under its number, and that
no second writer can replace. What a killed run leaves is no commit, so it is never read, and the run that follows
writes it again. Compaction commits one part in place of many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Ledger:
    """Rows of ``schema`` below ``path``; ``key`` names a row. One writer at a time; a second one's commit fails."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path, path.getFileSystem(self._conf)

    def commits(self) -> dict[str, list[str]]:
        """By number, in order: the parts that count from this commit on in place of all before, or the one that it adds."""
        folder, fs = self._at("commits")
        if not fs.exists(folder):
            return {}
        rows = self.spark.read.text(f"{self.path}/commits", wholetext=True).select(F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).alias("n"), "value").collect()
        return {r.n: r.value.split("\n") for r in sorted(rows)}

    def parts(self) -> list[str]:
        """Names of the parts that count."""
        live: list[str] = []
        for kind, *names in self.commits().values():
            live = names if kind == "replace" else [*live, *names]
        return live

    def read(self) -> DataFrame:
        """The committed rows, with the name of their part."""
        parts = self.parts()
        whole = T.StructType([*self.schema.fields, T.StructField("part", T.StringType())])
        if not parts:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(*(f"{self.path}/parts/{p}" for p in parts))

    def latest(self) -> DataFrame:
        """One row for each key: that of its last part."""
        rest = [f.name for f in self.schema.fields if f.name != self.key]
        return self.read().groupBy(self.key).agg(F.max_by(F.struct(*rest), "part").alias("r")).select(self.key, "r.*")

    def pending(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose key no committed part has."""
        return rows.join(self.read().select(self.key), self.key, "left_anti")

    def append(self, rows: DataFrame, name: str | None = None) -> bool:
        """Write and commit ``rows`` as a part; one whose ``name`` is committed already is left as it is.

        Parts without a name are numbered, so that later ones sort later.
        """
        commits = self.commits()
        known = {n for kind, *names in commits.values() for n in names}
        if name in known:
            return False
        number = f"{int(max(commits, default='0')) + 1:09d}"
        name = name or number
        rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(name).alias("part")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/parts/{name}")
        self._commit(number, ["add", name])
        return True

    def _commit(self, number: str, lines: list[str]) -> None:
        final, fs = self._at("commits", number)
        begun, _ = self._at("commits", f".{uuid.uuid4().hex}")
        out = fs.create(begun, False)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(begun, final):
            fs.delete(begun, False)
            raise RuntimeError(f"commit {number} of {self.path} was taken by another writer")

    def compact(self) -> None:
        """Rewrite all parts as one; the part names of rows stay. Readers that hold the old parts should have ended."""
        commits, old = self.commits(), self.parts()
        if len(old) < 2:
            return
        number = f"{int(max(commits)) + 1:09d}"
        name = f"{number}-compact"
        self.read().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/parts/{name}")
        self._commit(number, ["replace", name])
        for part in old:
            path, fs = self._at("parts", part)
            fs.delete(path, True)
