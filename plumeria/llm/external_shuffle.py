"""Sharding by a two-pass external shuffle.

The first pass scatters records by seeded hashes, evenly, into buckets that fit in a task's memory; the second
shuffles each bucket there by Fisher and Yates' method and writes it. Buckets in order, each in its shuffled
order, are one random order of all records, and equal runs of it are the shards: their counts differ by one
at most (law ``rows``), whatever the sizes, ids and copies are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Production parameters. A bucket is held twice while it is shuffled; at 100 TB, 1 GB a bucket keeps their number near 100,000.
SHARDS, SEED, BUCKET_BYTES = 40, 42, 48 << 20
#: Bytes of a record besides its text, by the contract.
OVERHEAD = 16
LAW = "rows"
#: Buckets up to which their sizes, a row of two numbers each, are broadcast; more are joined.
BROADCAST_BUCKETS = 1_000_000
#: Rows of a batch that leaves a task.
BATCH_ROWS = 2_000


def _bytes(docs: DataFrame) -> Column:
    """About how large a row is: its texts' bytes, and 16 for each column."""
    long = [F.coalesce(F.octet_length(f"`{c}`").cast("long"), F.lit(0)) for c, kind in docs.dtypes if kind in ("string", "binary")]
    return sum(long, F.lit(16 * len(docs.columns)).cast("long"))


def order_of(keys: np.ndarray, seed: int, bucket: int) -> np.ndarray:
    """A bucket's rows, by place, in shuffled order: sorted by their keys, so that the order in which they came is forgotten, then Fisher-Yates."""
    order = np.argsort(keys, kind="stable")
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(row, bucket, place) of each record of ``docs``, a written table, and the number of buckets.

    ``row`` holds all columns, so no name can clash. A record's key hashes its id, its text and its place in
    the input, so copies scatter like any others. Places in the input must be repeatable, as those of files
    are: an executor that is lost has its records scattered alike again.
    """
    total = docs.agg(F.sum(_bytes(docs))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text").cast("string"), F.monotonically_increasing_id())
    keyed = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), key.alias("key"))
    schema = keyed.select("row", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("place")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        bucket = TaskContext.get().partitionId()
        whole = pa.Table.from_batches(held)
        del held
        order = order_of(whole["key"].to_numpy(), seed, bucket)
        for at in range(0, len(order), BATCH_ROWS):
            part = whole.take(pa.array(order[at : at + BATCH_ROWS])).combine_chunks()
            n = len(part)
            yield pa.RecordBatch.from_arrays([part["row"].chunk(0), pa.array(np.full(n, bucket, np.int32)), pa.array(np.arange(at, at + n))], ["row", "bucket", "place"])

    dealt = keyed.repartitionById(buckets, F.pmod("key", F.lit(buckets)).cast("int"))
    return written(dealt.mapInArrow(run, schema), "shuffled"), buckets


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with shard (0 up to ``shards`` - 1) and slot (0 on in each shard); columns of those names are replaced.

    With fewer records than shards, some shards are empty; an empty table gives no rows. Null ids and texts
    are values like others; repeated rows each have a place of their own; ties of keys keep the order of input.
    The same files, seed and bucket size give the same order.
    """
    rows, buckets = shuffled(docs, seed, bucket_bytes)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    n = rows.count()
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.join(F.broadcast(before) if buckets <= BROADCAST_BUCKETS else before, "bucket")
    shard = placed.withColumn("at", F.col("before") + F.col("place")).withColumn("shard", F.expr(f"cast((at * {shards}) div {max(1, n)} as int)"))
    first = F.expr(f"(cast(shard as long) * {n} + {shards - 1}) div {shards}")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return shard.select(*kept, "shard", (F.col("at") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``sharded`` records as folders ``shard=<k>`` of files in slot order, replacing what is there, and read them back. A shard is a run of whole buckets but for its ends, so nothing is shuffled again."""
    sharded(docs, shards, seed, bucket_bytes).sortWithinPartitions("shard", "slot").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def shard_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of ``sharded`` records: size is the text's UTF-8 bytes (null: none) and ``OVERHEAD``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
