"""Operators on fixtures of our own."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.operators import clusters, dedup, enrich, filters, joins, quality, quotes, stats, ward
from plumeria.operators.filters import QueryOptions
from plumeria.plans.batch import batch, resume
from plumeria.plans.cache import ResultCache
from plumeria.schemas import LOOKUP, RAW_COMMENT
from plumeria.sources import readers, writers


def texts(spark, rows):
    return dedup.combined(spark.createDataFrame([(f"C-{i}", i, t, None) for i, t in rows], "id string, seq long, comment string, attachment_texts array<string>"))


def members(lookup):
    return {r.truncated_text: r.comment_ids for r in lookup.collect()}


ROWS = [(1, "Same text"), (2, "other"), (3, " same  TEXT "), (4, None), (5, " "), (6, "third")]


def test_lookup(spark):
    made = {r.lookup_id: (r.truncated_text, r.comment_ids, r.comment_count) for r in dedup.create_lookup(texts(spark, ROWS)).collect()}
    assert made == {"lookup_000001": ("Same text", ["C-1", "C-3"], 2), "lookup_000002": ("other", ["C-2"], 1), "lookup_000003": ("third", ["C-6"], 1)}


def test_fold_is_a_full_recompute_and_idempotent(spark):
    old = dedup.create_lookup(texts(spark, ROWS[:2])).drop("seq", "normalized")
    once = dedup.fold(old, texts(spark, ROWS[1:]))
    assert members(once) == members(dedup.create_lookup(texts(spark, ROWS)))
    assert members(dedup.fold(once, texts(spark, ROWS))) == members(once)


@pytest.mark.parametrize("partitions, coalesce", [(8, True), (8, False), (64, True)])
def test_lookup_over_many_partitions(spark, partitions, coalesce):
    """Every text once and numbers 1..N once, with all columns written, however shuffles are cut."""
    names = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": str(coalesce).lower()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        raw = spark.range(12_000).select(F.concat(F.lit("C-"), F.col("id").cast("string")).alias("id"), F.col("id").alias("seq"), F.concat(F.lit("Text  number "), (F.col("id") % 5000).cast("string"), F.repeat(F.lit(" word"), 50)).alias("comment"), F.lit(None).cast("array<string>").alias("attachment_texts"))
        all_ = dedup.combined(raw)
        half = all_.filter("seq < 6000")
        made, old = dedup.create_lookup(all_).toPandas(), dedup.entries(half)
        rows, ids = dedup.fold_members(dedup.lookup_rows(half, old[0]), old[1], all_.filter("seq >= 6000"))
        rows, ids = rows.toPandas(), ids.toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [f"lookup_{k + 1:06d}" for k in range(5000)]
    for table in (made, rows):
        assert sorted(table.lookup_id) == want and table.truncated_text.nunique() == 5000 and table.comment_count.sum() == 12_000
    assert len(ids) == 12_000 and ids.id.nunique() == 12_000
    listed = made.set_index("lookup_id").comment_ids
    assert all(list(listed[f"lookup_{k + 1:06d}"]) == [f"C-{i}" for i in range(k, 12_000, 5000)] for k in (0, 17, 4999))


def test_save_keeps_what_it_reads(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        writers.save(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"))
    writers.promote(spark, "v1", str(tmp_path))
    assert writers.current(spark, str(tmp_path)) == "v1"


def test_resumable_analysis(spark, tmp_path):
    df = spark.createDataFrame([(f"lookup_{k:06d}", "I support it", None, None, None, None) for k in range(20)], "lookup_id string, truncated_text string, stance string, key_quote string, rationale string, themes string")
    path = str(tmp_path / "analysis")
    df = df.withColumn("truncated_text", F.concat_ws(" ", "truncated_text", "lookup_id"))
    first = enrich.analyse_resumable(df, enrich.KeywordClassifier(), path, every=7).collect()
    again = enrich.analyse_resumable(df, lambda text: 1 / 0, path, every=7).collect()
    assert len(first) == 20 and {r.stance for r in first} == {"For"} and sorted(first) == sorted(again)
    slow = enrich.classify_text(lambda t: time.sleep(2), "x", enrich.EnrichConfig(retries=0, timeout=0.1))
    assert slow["rationale"].startswith("Error:")


def test_backslash_is_a_character(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",)], "title string")
    assert filters.apply_filters(df, QueryOptions(search="a\\b", search_fields=("title",))).count() == 1


def test_truncation_rules(spark):
    cut = spark.createDataFrame([(500, 103), (20, 20)], "full_text_length int, truncated_text_length int")
    assert quality.truncation_gate(cut, 103, exact=True) == 103
    for requested, exact in ((100, True), (50, False), (200, False)):
        with pytest.raises(quality.TruncationError):
            quality.truncation_gate(cut, requested, exact)
    whole = cut.filter("full_text_length = 20")
    assert quality.truncation_gate(whole, None) is None and quality.truncation_gate(whole, 100) == 100
    with pytest.raises(quality.TruncationError):
        quality.truncation_gate(whole, 10)


def test_empty_lookup(spark):
    assert dedup.create_lookup(texts(spark, [])).count() == 0


def test_merge_and_orphans(spark):
    lookup = spark.createDataFrame([("lookup_000002", ["a"], "For"), ("lookup_000001", ["a", "z"], "Against")], "lookup_id string, comment_ids array<string>, stance string")
    comments = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {r.id: (r.lookup_id, r.stance, r.comment_count) for r in joins.merge(comments, lookup).collect()}
    assert got == {"a": ("lookup_000001", "Against", 1), "b": (None, None, 1)}
    assert [r.id for r in joins.orphans(lookup, comments).collect()] == ["z"]
    assert [r.id for r in joins.unmatched(comments, lookup).collect()] == ["b"]


def test_primary_collapses_unmatched(spark):
    comments = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "gone")], "id long, lookup_id string")
    lookup = spark.createDataFrame([("x",)], "lookup_id string")
    assert sorted(r.id for r in joins.primary_ids(comments, lookup).collect()) == [1, 3]


def test_options():
    o = filters.options_from_url({"filter_stance": '["For"]', "filter_title": "plain", "page": "2", "sort": "postedDate"})
    assert o.filters == {"stance": ["For"], "title": "plain"} and o.page == 2 and o.page_size == 10 and o.sort == ("postedDate", "asc")
    assert filters.column_name("keyQuote", ["key_quote"]) == "key_quote" and filters.column_name("nope", ["a"]) is None
    assert filters.total_pages(21, 10) == 3
    assert filters.normalize_value({"values": ["2-10"]}, "count") == "2-10"


def test_filters_commute_and_pages_cover(spark, sf):
    from plumeria.plans.catalog import comments

    df = comments(spark, sf).select("id", "stance", "category", "comment")
    a = filters.apply_filters(df, QueryOptions({"stance": "For", "category": ["en"]}))
    b = filters.apply_filters(df, QueryOptions({"category": ["en"], "stance": "For"}))
    assert sorted(r.id for r in a.select("id").collect()) == sorted(r.id for r in b.select("id").collect())
    pages = [r.id for k in range(1, 12) for r in filters.page(df, QueryOptions(sort=("stance", "desc"), page=k, page_size=20)).select("id").collect()]
    assert len(pages) == len(set(pages)) == df.count()


def test_literal_like(spark):
    df = spark.createDataFrame([("a%b",), ("axb",)], "title string")
    assert filters.apply_filters(df, QueryOptions({"title": "a%b"})).count() == 2
    assert filters.apply_filters(df, QueryOptions({"title": "a%b"}), literal=True).count() == 1


def test_pushdown(spark, sf):
    df = filters.apply_filters(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts"), QueryOptions({"ts": {"mode": "before", "endDate": "2024-01-10"}}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts" in plan and "Python" not in plan


@pytest.mark.parametrize("quote, text, want", [
    ("abc", "xx abc", "exact"), ("„abc", 'x "abc', "exact"), ("The  QUICK brown fox jumps", "so the quick brown fox jumps on", "similar"), ("exactly twenty chars", "EXACTLY TWENTY CHARS", "missing"),
    ("one two three four five six", "six five. four three two one", "missing"), ("one two three four five six", "x. six five four three two y", "similar"), ("gone", "text", "missing"), ("", "text", None), ("q", None, None),
])
def test_quotes(spark, quote, text, want):
    df = spark.createDataFrame([(quote, text)], "key_quote string, truncated_text string")
    assert quotes.verify(df).first().match_type == want


def test_no_quotes_no_rates(spark):
    df = spark.createDataFrame([(None, "t")], "key_quote string, truncated_text string")
    assert quotes.rates(quotes.verify(df)).first().exact_rate is None


def test_ward_against_brute_force():
    x = np.random.default_rng(1).normal(size=(30, 3))
    groups = [[i] for i in range(30)]
    while len(groups) > 4:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    labels = clusters.cut(clusters.ward_linkage(x), 30, 4)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == k)) for k in range(4)}


def test_elbow():
    assert clusters.elbow([2], [5.0]) == 2 and clusters.elbow([2, 3], [5.0, 4.0]) == 2
    assert clusters.elbow([2, 3, 4], [9.0, 5.0, 4.0]) == 4
    assert clusters.elbow([2, 3, 4, 5], [900.0, 500.0, 350.0, 300.0]) in (4, 5)


def test_clusters_label_every_row(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    exact = clusters.ward_clusters(rows, k=3)
    assert exact.count() == rows.count() and exact.select("cluster_id").distinct().count() == 3
    assert clusters.ward_clusters(rows, most=50, k=3).count() == rows.count()


def agreement(a, b):
    """Adjusted Rand index of two labellings."""
    table = np.zeros((len(set(a)), len(set(b))))
    np.add.at(table, (np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]), 1)
    pairs = lambda t: (t * (t - 1) / 2).sum()
    rows, columns = pairs(table.sum(axis=1)), pairs(table.sum(axis=0))
    by_chance = rows * columns / pairs(np.array([len(a)]))
    return (pairs(table) - by_chance) / ((rows + columns) / 2 - by_chance)


def test_repeated_vectors_keep_the_exact_path(spark):
    """40 different vectors, 1 to 4 times each: exact with ``most`` = 40, and as Ward over all rows says."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 3)), rng.integers(1, 5, 40), axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = [r.cluster_id for r in clusters.ward_clusters(df, most=40, k=4).orderBy("id").collect()]
    assert agreement(got, clusters.cut(clusters.ward_linkage(x), len(x), 4)) == 1


def grouped(n, d, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) * 0.5 + rng.normal(size=(7, d))[rng.integers(0, 7, n)] * 2


def test_rounds_are_exact_ward(spark):
    """2,400 vectors, of which one task ends at most 600, in blocks of at most 400: the labels of exact Ward."""
    x = grouped(2400, 8, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = [r.cluster_id for r in clusters.ward_clusters(df, most=600, block=400, k=5).orderBy("id").collect()]
    assert agreement(got, clusters.cut(clusters.ward_linkage(x), len(x), 5)) == 1


def test_rounds_search_like_one_task(spark):
    """All levels' codes agree, copies of vectors among them, whether groups are merged in rounds or by one task."""
    x = grouped(260, 4, 8)
    rows = [(i, x[i % 260].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    one, rounds = ([r.cluster_id for r in clusters.ward_clusters(df, most=m, block=40).orderBy("id").collect()] for m in (260, 90))
    assert one == rounds and len(set(one)) > 8 and max(map(len, one)) == 3


def test_nearest_across_blocks(spark):
    """Blocks and bounds find what comparing all pairs finds, ties too, and groups stay apart."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.integers(0, 4, (150, 3)) + 0.0])
    x = np.unique(x, axis=0)
    g, w = rng.integers(0, 2, len(x)), rng.integers(1, 5, len(x)) + 0.0
    df = spark.createDataFrame([(str(a), i, float(b), v.tolist()) for i, (a, b, v) in enumerate(zip(g, w, x, strict=True))], "g string, id long, w double, v array<double>")
    for block in (7, 1000):
        got = {r.id: (r.who, r.price) for r in ward.nearest(df, block).collect()}
        for i in range(len(x)):
            d = ((x - x[i]) ** 2).sum(axis=1) * w * w[i] / (w + w[i])
            d[(g != g[i]) | (np.arange(len(x)) == i)] = np.inf
            assert np.isclose(got[i][1], d.min()) and np.isclose(d[got[i][0]], d.min())


def test_blocks_are_read_by_tasks_and_trees_made_once(spark, monkeypatch):
    """No join sends blocks to their visitors, and deeper levels take their parts of the first tree."""
    x = grouped(260, 4, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    active = df.selectExpr("'' AS g", "id", "1.0D AS w", "embedding AS v")
    assert "Join" not in ward._met(ward._blocks(active, 260, 40))._jdf.queryExecution().executedPlan().toString()
    made, real = [], ward.merges
    monkeypatch.setattr(ward, "merges", lambda *a: made.append(a) or real(*a))
    codes = {r.cluster_id for r in clusters.ward_clusters(df, most=60, block=40).collect()}
    assert len(made) == 1 and max(map(len, codes)) == 3


def test_hubs_take_few_rounds(spark, monkeypatch):
    """A hub that each vector in turn comes nearest to, and vectors without any groups: few rounds, and exact Ward's prices."""
    rng = np.random.default_rng(6)
    sphere = rng.normal(size=(240, 12))
    sphere /= np.sqrt((sphere**2).sum(axis=1, keepdims=True))
    hub = np.concatenate([np.zeros((1, 60)), np.diag(np.linspace(1, 2, 60))])
    rounds, real = [], ward._blocks
    monkeypatch.setattr(ward, "_blocks", lambda *a: rounds.append(a) or real(*a))
    for x, weight, most in ((hub, np.array([1000.0] + [1.0] * 60), 10), (sphere, np.ones(240), 20)):
        points = spark.createDataFrame([("", i, float(w), v.tolist()) for i, (w, v) in enumerate(zip(weight, x, strict=True))], "g string, id long, w double, v array<double>")
        rounds.clear()
        tree = ward.merges(points, most, 30).collect()
        linkage = clusters.ward_linkage(x, weight)
        assert np.allclose(sorted(r.price for r in tree), linkage[:, 2] ** 2 / 2) and len({r.child for r in tree}) == len(x) - 1
        assert len(rounds) <= 14


def test_equal_prices_in_a_circle_end(spark):
    """Three clusters, each the next one's nearest: the cheapest merge is made, and one task's rounds end as well."""
    met = spark.createDataFrame([("", 1, 1.0, [0.0], 2, 1.0), ("", 2, 1.0, [4.0], 3, 1.0), ("", 3, 1.0, [8.0], 1, 1.0)], "g string, id long, w double, v array<double>, who long, price double")
    paired = ward._paired(met)
    assert {r.n for r in paired.collect()} == {1}
    assert {(r.a.id, r.b.id, r.n) for r in ward._cheapest(paired).collect()} == {(1, 2, 2), (3, 3, 1)}


def test_plane_keeps_distances(spark):
    x = np.random.default_rng(2).normal(size=(20, 2)) @ np.array([[3, 1, 0], [0, 1, 2.0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    p = np.array([(r.pca_x, r.pca_y) for r in clusters.plane(df).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(p[0] - p[1:], axis=1), np.linalg.norm(x[0] - x[1:], axis=1))


def test_sample_is_the_same_each_time(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    a, b = (sorted(r.id for r in stats.sample_by_group(df, "g", 0.5).collect()) for _ in range(2))
    assert a == b and len(a) == 17 + 16 + 16


def test_enrich(spark):
    calls = []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return {"stance": "For", "key_quote": "q", "rationale": "r", "themes": ["a", "b"]}

    assert enrich.classify_text(flaky, "x", enrich.EnrichConfig(), sleep=lambda _: None) == {"stance": "For", "key_quote": "q", "rationale": "r", "themes": "a, b"}
    failed = enrich.classify_text(lambda t: 1 / 0, "x", enrich.EnrichConfig(retries=1), sleep=lambda _: None)
    assert failed["stance"] == "" and failed["rationale"].startswith("Error:")
    assert enrich.classify_text(flaky, " ", enrich.EnrichConfig())["rationale"] == "Error: no text"
    with pytest.raises(quality.ConfigurationError):
        enrich.EnrichConfig(batch_size=0)


def test_truncation_gate(spark):
    cut = spark.createDataFrame([(50, 103)], "full_text_length int, truncated_text_length int").withColumn("full_text_length", F.lit(500))
    assert quality.truncation_gate(cut, 100) == 100
    with pytest.raises(quality.TruncationError):
        quality.truncation_gate(cut, None)


def test_repair_and_violations(spark):
    df = spark.createDataFrame([("lookup_000001", "x" * 2000, None, ["A-2024-0001-0002"], 1, "For", True)], "lookup_id string, truncated_text string, text_source string, comment_ids array<string>, comment_count int, stance string, corrected boolean")
    fixed = quality.repair_lookup(df)
    assert fixed.first().truncated_text_length == 1003 and "corrected" not in fixed.columns
    assert fixed.select(quality.lookup_violations().alias("v")).first().v == ["text_source"]


def test_csv_to_pipeline_and_resume(spark, tmp_path):
    head = "Document ID,Title,Comment,First Name,Last Name,Attachment Files,Posted Date,Received Date,Agency ID"
    lines = ['X-2024-0001-0001,Rule,,,,,,,X', 'X-2024-0001-0002,T,"I support, fully",Ann,Lee,"http://h/a.pdf,http://h/b.txt",2024-01-01T00:00Z,2024-01-01T00:00Z,X', 'X-2024-0001-0003,T,I SUPPORT,  fully,,,2024-01-01T00:00Z,2024-01-01T00:00Z,X', 'X-2024-0001-0004,T,I oppose this,,,,2024-01-01T00:00Z,2024-01-01T00:00Z,X']
    (tmp_path / "d.csv").write_text("\n".join([head, *lines]))
    csv = readers.docket_csv(spark, str(tmp_path / "d.csv"))
    raw = readers.comments_from_csv(csv, rule_ids=("X-2024-0001-0001",))
    assert raw.count() == 3
    flat = {r.id: r for r in joins.flatten(raw).collect()}
    assert flat["X-2024-0001-0002"].submitter_name == "Ann Lee" and flat["X-2024-0001-0002"].attachment_titles == "a.pdf; b.txt" and flat["X-2024-0001-0002"].attachment_count == 2
    raw = writers.save(raw, str(tmp_path / "raw"))
    first = raw.filter("id != 'X-2024-0001-0004'")
    done = batch(first, str(tmp_path / "r1"), classifier=enrich.KeywordClassifier())
    assert done["data"].count() == 2 and done["report"].first().total == 2
    again = resume(first, done["lookup"], raw, str(tmp_path / "r2"), classifier=enrich.KeywordClassifier())
    assert again["data"].count() == 3
    assert {r.stance for r in again["lookup"].collect()} == {"For", "Against"}


def test_json_and_missing_files(spark, tmp_path):
    assert readers.raw_comments(spark, str(tmp_path / "none.json"), required=False).count() == 0
    (tmp_path / "l.json").write_text('[{"lookup_id": "lookup_000001", "comment_ids": ["a"], "truncated_text": "t", "comment_count": 1}]')
    table = readers.lookup_table(spark, str(tmp_path / "l.json"))
    assert table.schema == LOOKUP and readers.clusterable(table).count() == 1
    (tmp_path / "c.json").write_text('{"0": ["short", "long"], "0a": ["s", "l"]}')
    assert {r.cluster_id: r.title for r in readers.cluster_descriptions(spark, str(tmp_path / "c.json")).collect()} == {"0": "short", "0a": "s"}
    assert RAW_COMMENT["attributes"].dataType["attachments"]


def test_attachments(spark, tmp_path):
    for name, text in (("C1/a.pdf", "x"), ("C1/a.pdf.extracted.txt", "y" * 200), ("C1/b.png", "x"), ("C1/b.png.extracted.txt", "short"), ("C2/c.pdf", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = readers.attachments(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.failed_attachments(files).collect()) == ["b.png", "c.pdf"]


def test_cache():
    now = [0.0]

    class Frame:
        held = 0

        def persist(self):
            Frame.held += 1
            return self

        def unpersist(self):
            Frame.held -= 1

    cache = ResultCache(2, 10, lambda: now[0])
    a = cache.get("a", Frame)
    assert cache.get("a", Frame) is a
    cache.get("b", Frame)
    cache.get("c", Frame)
    assert len(cache) == Frame.held == 2
    now[0] = 11
    assert cache.get("c", Frame) is not a
    cache.clear("^c")
    assert len(cache) == 1


def test_stream(spark, tmp_path):
    from plumeria.streaming.series import stance_windows

    e = spark.createDataFrame([("2024-01-01 10:00:00", "For"), ("2024-01-05 10:00:00", None)], "at string, stance string").withColumn("at", F.to_timestamp("at"))
    e.write.parquet(str(tmp_path / "ev"))
    w = stance_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev")), "at").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert {(r.for_count, r.neutral_count) for r in spark.table("w").collect()} == {(1, 0), (0, 1)}
