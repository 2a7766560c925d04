"""Ranked search against scoring every document for every query."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from plumeria.llm import queries
from plumeria.llm import ranked_search as r

from .conftest import ODD, ODD_IDS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    """docs: (doc_id, text); items: (item_id, text)."""
    bags = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, length = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, size in bags:
            m = 100 - 50 + (50 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(words(text)) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_terms():
    texts = [*ODD, "Ab1-cD_é\x7fÉX\x00y ÀÉ", " a\u0085b c"]
    assert [[t.decode() for t in r.terms(x)] for x in texts] == [words(x) for x in texts]


@pytest.mark.parametrize("shard", [1, 7, 512])
def test_all_hits_in_order(spark, shard):
    """Small shards, several blocks to a leaf, many ties and copies."""
    rng = np.random.default_rng(shard)
    vocabulary = [f"w{k}" for k in range(60)]
    draw = lambda n: " ".join(vocabulary[int(60 * x**3)] for x in rng.random(n))
    docs = [(int(k), draw(rng.integers(1, 30))) for k in range(300)] + [(int(k) + 300, "w1 w2 w3 W1") for k in range(100)] + [(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2"), (900, None), (901, "- .")]
    items = [(k, draw(8)) for k in range(12)] + [(3, "w1"), (None, "w2 w2 unknown"), (50, None), (51, "..."), (52, "unknown")]
    got = r.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 20, sample=100, levels=2, block=40, shard=shard)
    assert key([tuple(x) for x in got.collect()]) == key(brute(docs, items, 20))


def test_odd_rows_and_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "same word HERE don t"), (2, "é 漢字 STOP")], "item_id long, text string")
    got = [tuple(x) for x in r.ranked_search(docs(ODD, ODD_IDS), items).collect()]
    assert key(got) == key(brute(list(zip(ODD_IDS, ODD, strict=True)), [tuple(x) for x in items.collect()], 50))
    assert r.ranked_search(docs(ODD).limit(0), items).count() == 0 and r.ranked_search(docs(ODD), items.limit(0)).count() == 0
    assert r.ranked_search(docs([None, ""]), items).count() == 0


def test_blocks_of_items(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, f"t{k} common") for k in range(7)], "item_id long, text string")
    texts = [f"t{k} common t{k + 1}" for k in range(6)]
    monkeypatch.setattr(r, "ITEMS_AT_ONCE", 3)
    got = [tuple(x) for x in r.ranked_search(docs(texts), items).collect()]
    assert key(got) == key(brute(list(enumerate(texts)), [tuple(x) for x in items.collect()], 50))


def test_bisection_brings_topics_together():
    """Documents of two topics, mixed, end in different halves, and shards' bounds fall."""
    rng = np.random.default_rng(0)
    topic = rng.integers(0, 2, 400)
    own = [np.unique(rng.integers(0, 30, 12) + 30 * t) for t in topic]
    starts, flat = np.concatenate([[0], np.cumsum([len(x) for x in own])]), np.concatenate(own)
    one, two, _ = r.Bisector(starts, flat).halves(np.arange(400))
    assert abs(topic[one].mean() - topic[two].mean()) > 0.85
    parts = list(r.Bisector(starts, flat).order(np.arange(400), 64))
    assert sorted(np.concatenate(parts)) == list(range(400)) and max(map(len, parts)) <= 64
    leaves = r.Tree(starts, flat, 60, 1).leaves(np.diff(starts), flat)
    assert abs(topic[leaves == 0].mean() - topic[leaves == 1].mean()) > 0.85


def test_copies_do_not_fill_one_shard(spark):
    df = spark.range(3_000).selectExpr("id as doc_id", "'alpha beta' as text")
    vocabulary = {b"alpha": 0, b"beta": 1}
    index = r.clustered_index(r.postings(df, vocabulary), 2, 3_000, 6_000, shard=100)
    assert max(len(x.ids) // 8 for x in index.select("ids").collect()) <= 100


def test_query_matches_sql(spark, sf):
    got = [tuple(x) for x in queries.op13_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()]
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    assert key(got) == key(db.execute(queries.ORACLE_SQL["op13_ranked_search"]).fetchall())
