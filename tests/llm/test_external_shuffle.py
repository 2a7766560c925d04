"""Sharding: one random order of all records, cut into equal runs."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.llm import external_shuffle as x
from plumeria.llm import queries
from plumeria.llm.shared import new_path

from .conftest import ODD, ODD_IDS


def held(rows, n, shards):
    """Slots are gapless, counts at most one apart, and no record is lost."""
    by = rows.groupby("shard")["slot"].apply(lambda s: sorted(s))
    assert all(list(s) == list(range(len(s))) for s in by)
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_fisher_yates_is_a_permutation_that_forgets_the_input_order():
    keys = np.random.default_rng(0).permutation(1000)
    order, again = x.order_of(keys, 1, 0), x.order_of(keys[::-1].copy(), 1, 0)
    assert sorted(order) == list(range(1000)) and (keys[order] == keys[::-1][again]).all()
    assert (order != x.order_of(keys, 2, 0)).any() and (order != x.order_of(keys, 1, 1)).any()


@pytest.mark.parametrize(("shards", "bucket_bytes"), [(3, 20_000), (40, 100_000), (1, 1 << 20)])
def test_odd_rows(docs, shards, bucket_bytes):
    df = docs(ODD, ODD_IDS).withColumn("slot", F.lit(7)).withColumn("bucket", F.lit("b"))
    rows = x.sharded(df, shards, bucket_bytes=bucket_bytes)
    assert rows.columns == [c for c in df.columns if c != "slot"] + ["shard", "slot"]
    got = rows.toPandas()
    held(got, len(ODD), shards)
    assert Counter(zip(got.doc_id.map(str), got.text.map(str), strict=True)) == Counter(zip(df.toPandas().doc_id.map(str), map(str, ODD), strict=True))


def test_empty_table(docs):
    empty = docs(["a"]).limit(0)
    assert x.shard_digests(x.sharded(empty)).count() == 0


def test_copies_scatter(spark):
    """One record in two thirds of the rows fills no bucket beyond its share, and two seeds differ."""
    df = spark.range(0, 30_000, numPartitions=3).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text " * 4).alias("text"))
    rows, buckets = x.shuffled(df, bucket_bytes=200_000)
    sizes = [r.n for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert buckets > 8 and len(sizes) == buckets and max(sizes) < 1.2 * min(sizes)
    one, two = (x.sharded(df, 5, seed=k).filter("doc_id % 3 = 0").toPandas().sort_values("doc_id") for k in (1, 2))
    assert (one["shard"].to_numpy() != two["shard"].to_numpy()).mean() > 0.5


def test_order_is_random(spark):
    """Neither neighbours nor halves of the input stay together."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = x.sharded(df, 4, bucket_bytes=100_000).toPandas().sort_values(["shard", "slot"])["doc_id"].to_numpy()
    assert abs(np.corrcoef(got, np.arange(len(got)))[0, 1]) < 0.03
    assert (np.abs(np.diff(got)) == 1).mean() < 0.001


def test_same_seed_same_order(docs):
    df = docs([f"text {k}" for k in range(500)])
    one, two = (x.sharded(df, 7, bucket_bytes=5_000).select("doc_id", "shard", "slot").toPandas().sort_values("doc_id").to_numpy().tolist() for _ in range(2))
    assert one == two


def test_written_shards(docs, spark):
    df = docs([f"text {k}" for k in range(100)])
    path = new_path(spark, "shards")
    got = x.write_shards(df, path, 6, bucket_bytes=2_000)
    held(got.select("shard", "slot").toPandas(), 100, 6)
    want = x.sharded(df, 6, bucket_bytes=2_000)
    assert sorted(got.select("doc_id", "shard", "slot").collect()) == sorted(want.select("doc_id", "shard", "slot").collect())


def test_query(spark, sf):
    got, d = queries.op11_external_shuffle(spark, sf).toPandas(), queries.documents(spark, sf).toPandas()
    held(got, len(d), 40)
    texts = d.set_index("doc_id")["text"]
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
