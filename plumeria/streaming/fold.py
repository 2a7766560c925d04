"""Folding a stream of comments into a lookup table, by state and deltas.

A streaming aggregation keyed by the text keeps, of each different text, who came with it first and when; the state
lies in the state store, so a batch reads and writes only the texts that it holds. What a batch adds (its comments,
and the texts that are new with it, under the next numbers) is one part of a ledger each; nothing written
before is written again. The table is a view over the parts, and compaction joins parts without changing it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import lookup_id
from ..ledger import Ledger
from ..operators.dedup import ANALYSIS, TEXTS, combined, numbered, text_key

COMMENTS = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()), *(T.StructField(t, T.StringType()) for t in TEXTS), T.StructField("full_text_length", T.IntegerType())])
ENTRIES = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("first_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("number", T.LongType())])


class FoldedStream:
    """A lookup table below ``base`` that a stream of (id, seq, comment, attachment_texts) is folded into.

    Texts are numbered by the batch that brought them, then by seq. An id counts once for each text. Both
    queries have their own checkpoint below ``base`` and repeat a batch without adding it twice.
    """

    def __init__(self, spark: SparkSession, base: str, truncate: int | None = 1000):
        self.base, self.truncate = base.rstrip("/"), truncate
        self.comments = Ledger(spark, f"{self.base}/comments", COMMENTS, "id")
        self.entries = Ledger(spark, f"{self.base}/entries", ENTRIES, "text_key")

    def _comments(self, batch: DataFrame, number: int) -> None:
        self.comments.append(batch, f"batch-{number:09d}")

    def _entries(self, batch: DataFrame, number: int) -> None:
        """``batch`` has a row for each text that the stream's batch holds; new are those that came first with it."""
        name = f"batch-{number:09d}"
        if name in {n for _, *names in self.entries.commits().values() for n in names}:
            return
        start = self.entries.read().agg(F.max("number")).first()[0] or 0  # of a column's statistics, no texts
        fresh = batch.filter("came = seen").select("text_key", "first.id", "first.seq")
        self.entries.append(numbered(fresh.withColumnRenamed("id", "first_id"), ["seq", "text_key"], "number", start), name)

    def start(self, stream: DataFrame, **trigger) -> list[StreamingQuery]:
        """Two queries over the stream's rows: one adds comments, the other numbers new texts. ``trigger`` as for ``writeStream.trigger``; by default all that is there is taken."""
        texts = combined(stream, self.truncate).withColumn("full_text_length", F.length("full_text"))
        keyed = texts.select(text_key().alias("text_key"), F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), *TEXTS, "full_text_length")
        came = keyed.select("text_key", "id", "seq").withColumn("at", F.current_timestamp())  # one time for each batch
        first = F.min(F.struct("at", "seq", "id")).alias("first")
        known = came.groupBy("text_key").agg(first, F.min("at").alias("came"), F.max("at").alias("seen"))
        run = lambda df, put, name, mode: df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{self.base}/checkpoints/{name}").trigger(**(trigger or {"availableNow": True})).start()
        return [run(keyed, self._comments, "comments", "append"), run(known, self._entries, "entries", "update")]

    def members(self) -> DataFrame:
        """(id, lookup_id) of each comment."""
        named = self.entries.read().select("text_key", lookup_id(F.col("number")).alias("lookup_id"))
        return self.comments.read().select("id", "text_key").distinct().join(named, "text_key").select("id", "lookup_id")

    def lookup(self) -> DataFrame:
        """The lookup rows, without lists of ids; analysis fields are empty."""
        counts = self.comments.read().select("text_key", "id").distinct().groupBy("text_key").agg(F.count(F.lit(1)).cast("int").alias("comment_count"))
        first = self.entries.read().select("text_key", F.col("first_id").alias("id"), "seq", lookup_id(F.col("number")).alias("lookup_id"))
        fields = F.struct(*TEXTS, "full_text_length").alias("f")
        rows = self.comments.read().select("text_key", "id", "seq", fields).join(first, ["text_key", "id", "seq"])
        rows = rows.groupBy("text_key", "lookup_id").agg(F.min("f").alias("f")).join(counts, "text_key")
        rows = rows.select("lookup_id", "comment_count", "f.*").withColumn("truncated_text_length", F.length("truncated_text"))
        return rows.withColumns({k: F.lit(None).cast(v) for k, v in ANALYSIS.items()})

    def compact(self) -> None:
        """Join the parts of both ledgers; to be run while no query of this table runs."""
        self.comments.compact()
        self.entries.compact()
