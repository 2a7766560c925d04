"""A stream folded into a lookup table equals folding its batches one after another."""

import os
import time

import pytest
from pyspark.sql import functions as F

from plumeria.operators import dedup
from plumeria.streaming.fold import FoldedStream

SCHEMA = "id string, seq long, comment string, attachment_texts array<string>"
BATCHES = [
    [("C-3", 3, "Two", None), ("C-1", 1, "one", None), ("C-2", 2, "ONE ", None), ("C-4", 4, " ", None), ("C-4", 4, None, None)],
    [("C-0", 0, "two", None), ("C-5", 5, "three", ["with more"]), ("C-1", 1, "one", None), ("C-6", 6, "three", None)],
    [("C-7", 7, "one", None), ("C-8", 8, "x" * 1500, None), ("C-9", 9, "x" * 1600, None)],
]


def put(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/tmp{k}")
    part = next(f for f in os.listdir(f"{folder}/tmp{k}") if f.startswith("part"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/tmp{k}/{part}", f"{folder}/in/{k}.parquet")
    time.sleep(0.05)


def drain(spark, folder, folded):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for q in folded.start(stream):
        q.awaitTermination()


def view(lookup, members):
    rows = {r.lookup_id: (r.truncated_text, r.comment_count, r.full_text_length, r.truncated_text_length, r.text_source) for r in lookup.collect()}
    return rows, sorted(map(tuple, members.select("id", "lookup_id").collect()))


def expected(spark, batches):
    """The fold of each batch into what was there."""
    rows, ids = None, None
    for batch in batches:
        texts = dedup.combined(spark.createDataFrame(batch, SCHEMA), 1000)
        if rows is None:
            found, ids = dedup.entries(texts)
            rows, ids = dedup.lookup_rows(texts, found).drop("seq"), ids.select("id", "lookup_id")
        else:
            rows, ids = dedup.fold_members(rows, ids, texts)
    return view(rows, ids)


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store each
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_equal_to_folding_batches(spark, tmp_path, two_partitions):
    folder = str(tmp_path)
    folded = FoldedStream(spark, f"{folder}/table")
    put(spark, folder, 0, BATCHES[0])
    put(spark, folder, 1, BATCHES[1])
    drain(spark, folder, folded)
    assert view(folded.lookup(), folded.members()) == expected(spark, BATCHES[:2])
    times = lambda: {p: os.path.getmtime(p) for d, _, fs in os.walk(f"{folder}/table/entries/parts") for p in (os.path.join(d, f) for f in fs)}
    held = times()
    put(spark, folder, 2, BATCHES[2])
    drain(spark, folder, FoldedStream(spark, f"{folder}/table"))  # begun again, from its checkpoint
    want = expected(spark, BATCHES)
    assert view(folded.lookup(), folded.members()) == want
    assert held.items() <= times().items()  # a batch writes its own part only
    added = folded.entries.read().groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    assert [r.n for r in added] == [2, 2, 1]
    folded.compact()
    assert len(folded.entries.parts()) == 1 and view(folded.lookup(), folded.members()) == want


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    folded = FoldedStream(spark, f"{tmp_path}/table")
    rows = spark.createDataFrame([(b"k", "C-1", 1, "t", "comment", "t", "", 1)], folded.comments.schema)
    for _ in range(2):
        folded._comments(rows, 0)
    assert folded.comments.read().count() == 1
