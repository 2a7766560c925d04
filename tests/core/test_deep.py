"""Deep pages and silhouettes of many rows, against what one sort and one matrix say."""

import numpy as np
from pyspark.sql import functions as F

from plumeria.operators import clusters, filters, silhouette, ward
from plumeria.operators.filters import QueryOptions
from plumeria.operators.pages import Pages, pages


def test_pages_are_those_of_one_sort(spark):
    df = spark.range(0, 1003, numPartitions=7).select(F.col("id"), F.when(F.col("id") % 10 > 0, F.col("id") % 5).alias("stance"), F.col("id").alias("place"), F.lit(1).alias("range"))
    options = QueryOptions(sort=("stance", "desc"))
    found = pages(df, options)
    whole = [tuple(r) for r in filters.order(df, options).collect()]
    assert found.total == 1003 and found.count(50) == 21
    for size in (1, 50, 400, 2000):
        for number in (1, 2, found.count(size), found.count(size) + 1):
            assert [tuple(r) for r in found.page(number, size).collect()] == whole[(number - 1) * size : number * size]
    assert len(found.ranges(21, 50)) == 1 and found.ranges(22, 50) == []
    plan = found.page(21, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "range#" in plan.split("PartitionFilters: [")[1].split("]")[0]  # other folders aren't read
    found.close()


def test_pages_of_nothing(spark):
    found = Pages(spark.range(0), [F.col("id").asc()])
    assert found.total == 0 and found.count(10) == 0 and found.page(1, 10).count() == 0


def test_silhouettes_equal_the_matrix(spark):
    """Three clusterings in one pass, in several stripes and blocks; a weighted point counts as that many rows."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1, (60, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 6, 1), (4, 4, 4))])
    fragment, weight = np.repeat(np.arange(4), 60), rng.integers(1, 4, 240)
    weight[180:], fragment[-1] = 1, 4  # the last is alone
    df = spark.createDataFrame([(i, float(w), v.tolist(), int(f)) for i, (w, v, f) in enumerate(zip(weight, x, fragment, strict=True))], "id long, w double, v array<double>, fragment int")
    maps = {2: [0, 0, 0, 0, 1], 3: [0, 1, 1, 2, 2], 5: [0, 1, 2, 3, 4]}
    got = silhouette.silhouettes(df, maps, stripe=70, block=16)
    for k, to in maps.items():
        assert np.isclose(got[k], clusters.silhouette(np.repeat(x, weight, axis=0), np.repeat(np.array(to)[fragment], weight)), atol=1e-7)


def test_best_number_equals_the_local_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * 0.4 + rng.normal(size=(6, 3))[rng.integers(0, 6, 300)] * 3
    df = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    best, tried = silhouette.best_number(df, most=120, block=60, stripe=90)
    assert best == clusters.best_k(x) and {3, 5, 8, 12, 15, 20} <= set(tried)
    linkage = clusters.ward_linkage(x)
    assert all(np.isclose(s, clusters.silhouette(x, clusters.cut(linkage, 300, k))) for k, s in tried.items())
    assert silhouette.best_number(df.limit(0))[0] == 0


def test_best_number_with_a_hub_takes_few_rounds(spark, monkeypatch):
    """Sixty vectors that come nearest to a hub of 200 equal ones, one after another: few rounds, and the silhouettes of exact Ward."""
    x = np.concatenate([np.zeros((1, 60)), np.diag(np.linspace(1, 2, 60))])
    weight = np.array([200] + [1] * 60)
    df = spark.createDataFrame([(v.tolist(),) for v in np.repeat(x, weight, axis=0)], "embedding array<double>")
    rounds, real = [], ward._blocks
    monkeypatch.setattr(ward, "_blocks", lambda *a: rounds.append(a) or real(*a))
    _, tried = silhouette.best_number(df, coarse=(3, 5), around=1, most=10, block=30)
    assert 0 < len(rounds) <= 14
    linkage = clusters.ward_linkage(x, weight)
    assert set(tried) >= {2, 3, 4, 5} or set(tried) >= {3, 4, 5, 6}
    assert all(np.isclose(s, clusters.silhouette(np.repeat(x, weight, axis=0), np.repeat(clusters.cut(linkage, 61, k), weight))) for k, s in tried.items())
