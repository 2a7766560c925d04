"""Ledgers: commits, killed runs, growing tables, compaction; and what counts on them."""

import pytest
from pyspark.sql import functions as F

from plumeria.ledger import Ledger
from plumeria.operators import enrich
from plumeria.sources import readers, writers


def fixed(stance):
    return lambda text: {"stance": stance, "key_quote": "", "rationale": "r", "themes": []}


def lookup(spark, ids):
    rows = [(f"lookup_{k:06d}", f"text {k}", None, None, None, None) for k in ids]
    return spark.createDataFrame(rows, "lookup_id string, truncated_text string, stance string, key_quote string, rationale string, themes string")


def stances(df):
    return {int(r.lookup_id[7:]): r.stance for r in df.select("lookup_id", "stance").collect()}


def test_rows_new_since_a_finished_run_are_analysed(spark, tmp_path):
    path = str(tmp_path / "a")
    assert stances(enrich.analyse_resumable(lookup(spark, range(20)), fixed("For"), path)) == dict.fromkeys(range(20), "For")
    got = stances(enrich.analyse_resumable(lookup(spark, range(30)), fixed("Against"), path, every=4))
    assert got == dict.fromkeys(range(20), "For") | dict.fromkeys(range(20, 30), "Against")
    ledger = enrich.analysis_ledger(spark, path)
    assert ledger.read().count() == 30 and ledger.pending(lookup(spark, range(30)).withColumn("text_hash", enrich.text_hash())).count() == 0


def test_a_killed_run_repeats_no_committed_row(spark, tmp_path, monkeypatch):
    path, commit, seen = str(tmp_path / "a"), Ledger._commit, []

    def dies(self, number, lines):
        if len(seen) == 2:
            raise KeyboardInterrupt  # after the third part's files are written
        seen.append(number)
        commit(self, number, lines)

    monkeypatch.setattr(Ledger, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        enrich.analyse_resumable(lookup(spark, range(40)), fixed("For"), path, every=10)
    monkeypatch.setattr(Ledger, "_commit", commit)
    before = enrich.analysis_ledger(spark, path).read().count()
    assert 0 < before < 40
    got = stances(enrich.analyse_resumable(lookup(spark, range(40)), fixed("Against"), path, every=10))
    assert len(got) == 40 and sum(s == "For" for s in got.values()) == before and set(got.values()) == {"For", "Against"}
    assert enrich.analysis_ledger(spark, path).read().count() == 40


def test_failed_rows_are_tried_again_when_asked(spark, tmp_path):
    path, config = str(tmp_path / "a"), enrich.EnrichConfig(retries=0)
    assert set(stances(enrich.analyse_resumable(lookup(spark, range(3)), lambda t: 1 / 0, path, config)).values()) == {""}
    assert set(stances(enrich.analyse_resumable(lookup(spark, range(3)), fixed("For"), path, config)).values()) == {""}
    assert set(stances(enrich.analyse_resumable(lookup(spark, range(3)), fixed("For"), path, config, again=True)).values()) == {"For"}


def test_another_text_under_a_known_number_is_analysed(spark, tmp_path):
    path = str(tmp_path / "a")
    enrich.analyse_resumable(lookup(spark, range(3)), fixed("For"), path)
    changed = lookup(spark, range(3)).withColumn("truncated_text", F.when(F.col("lookup_id") == "lookup_000001", "other").otherwise(F.col("truncated_text")))
    assert stances(enrich.analyse_resumable(changed, fixed("Against"), path)) == {0: "For", 1: "Against", 2: "For"}


def test_parts_commits_and_compaction(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    ledger = Ledger(spark, str(tmp_path / "l"), rows(0, 1).schema, "k")
    assert ledger.read().count() == 0 and ledger.parts() == []
    assert ledger.append(rows(0, 5), "batch-0") and not ledger.append(rows(0, 5), "batch-0") and ledger.append(rows(3, 8).withColumn("v", F.lit(-1)))
    assert ledger.read().count() == 10 and ledger.parts() == ["batch-0", "000000002"]
    ledger.compact()
    assert len(ledger.parts()) == 1 and ledger.read().count() == 10 and not ledger.append(rows(0, 5), "batch-0")
    ledger.append(rows(8, 9))
    assert sorted(ledger.read().select("k").distinct().toPandas()["k"]) == list(range(9)) and len(ledger.parts()) == 2


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), spark.range(1).schema, "id")
    ledger.append(spark.range(1))
    with pytest.raises(RuntimeError):
        ledger._commit("000000001", ["add", "x"])
    assert ledger.read().count() == 1


def test_checkpoint_adds_only_new_rows(spark, tmp_path):
    path, df = str(tmp_path / "c"), lookup(spark, range(4))
    for part in (df.limit(0), df, df, lookup(spark, range(2, 6))):
        writers.checkpoint(part, path)
    assert readers.checkpoint(spark, path, df.schema).count() == 6
    with pytest.raises(Exception, match="lookup_id"):  # a table without the key is no first batch
        writers.checkpoint(df.drop("lookup_id"), path)


def test_texts_reach_a_classifier_a_few_at_a_time(spark):
    """An Arrow batch is cut before its texts become Python's; all rows get the classifier's answers."""
    rows = spark.range(25).selectExpr("concat('L', id) AS lookup_id", "if(id = 7, null, concat('we support ', id)) AS truncated_text", *(f"cast(null AS string) AS {n}" for n in enrich.NAMES))
    found = enrich.analyse(rows, enrich.KeywordClassifier(), enrich.EnrichConfig(batch_size=4))
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert {r.lookup_id: r.stance for r in found.collect()} == {f"L{k}": "" if k == 7 else "For" for k in range(25)}
