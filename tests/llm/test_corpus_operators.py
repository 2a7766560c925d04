"""Rules, near-duplicates, classifiers, extraction, URL rules and the pipeline."""

import random
import re
import time
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plumeria.llm import html_extract as H
from plumeria.llm import labelled, mil_quality, quality_rules, simhash, toxicity, url_rules
from plumeria.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ODD, ODD_IDS
from .test_near_copies import slow_kept


# Quality rules

def test_quality_rules_equal_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(repr, c.execute(ORACLE_SQL["op2_quality_rules"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES["op2_quality_rules"](spark, sf).collect()) == want


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_by_brute_force(docs):
    rng = random.Random(4)
    texts = [*ODD[:3], *ODD[4:], "a b c a b c a b", "x\nx\n\n x\nx|y #", *(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(texts)).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_measures(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_of_odd_rows(docs):
    got = quality_rules.quality_rules(docs(ODD, ODD_IDS)).collect()
    assert len(got) == 8 and all(r.base_failed and not r.kept for r in got)
    assert next(r for r in got if r.doc_id == 4).n_repeat_words == 40_000
    assert quality_rules.quality_rules(docs([])).count() == 0


def test_js_distance(spark):
    at = lambda c, q: spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, c)), F.lit(float(sum(c))), q).alias("x")).first().x
    assert at([1.0, 0.0], (1.0, 0.0)) == 0 and abs(at([1.0, 0.0], (0.0, 1.0)) - 1) < 1e-12
    p, q = np.array([0.5, 0.5]), np.array([0.9, 0.1])
    m = (p + q) / 2
    assert abs(at([5.0, 5.0], (0.9, 0.1)) - np.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)) < 1e-9


def test_rules_part_prose_from_symbols(docs):
    rng = random.Random(5)
    prose = [" ".join(rng.choice("the of and to in is that for it was with as river stone walk green window letter morning teacher".split()) for _ in range(120)) + "." for _ in range(30)]
    junk = [" ".join(f"{rng.choice('abcdefgh')}{k}##$$%%|" for k in range(120)) for _ in range(3)]
    kept = {r.doc_id for r in quality_rules.quality_rules(docs(prose + junk)).filter("kept").collect()}
    assert kept == set(range(30))


# SimHash

def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    up = list(range(len(prints)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            up[root(i)] = root(j)
    return {ids[k]: min(ids[j] for j in range(len(prints)) if root(j) == root(k)) for k in range(len(prints))}


def near_copies():
    rng = random.Random(6)
    words = lambda n: [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randint(0, 400)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = words(300)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            copy[rng.randrange(300)] = "changed"
            texts.append(" ".join(copy))
    return [*texts, *(x for x in ODD if x is not None and len(x) < 1000), "two words", "Two WORDS", None, texts[0]]


def test_near_duplicates_by_brute_force(docs):
    texts = near_copies()
    prints = [slow_fingerprint(t) for t in texts]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(texts)).collect()}
    want = slow_components(list(range(len(texts))), prints)
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in range(len(texts))}
    assert len(set(want.values())) < len(texts) - 10


def test_links_at_every_distance(spark):
    """Pairs at 0 to 6 differing bits, wherever the bits lie, and chains of them."""
    rng = random.Random(7)
    prints = []
    for _ in range(60):
        f = rng.getrandbits(64)
        prints.append(f)
        for _ in range(3):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.append(f)
    prints = list(dict.fromkeys(prints))
    want = slow_components(prints, prints)
    df = spark.createDataFrame([(k, int(np.uint64(f).view(np.int64))) for k, f in enumerate(prints)], "doc_id long, fp long")
    got = {int(np.int64(r.fp).view(np.uint64)): r.root for r in simhash.classes(df).collect()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_links_in_a_large_group():
    """Fewer comparisons, the same components as comparing all pairs."""
    rng = np.random.default_rng(10)
    for bits, size in ((14, 900), (40, 700), (10, 1500)):
        flips = rng.integers(0, 2, (size, bits)) & rng.integers(0, 2, (size, bits))
        group = np.unique((flips.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
        forest, want = simhash._Forest(), simhash._Forest()
        simhash._links(group, forest)
        for i, j in zip(*np.nonzero(np.bitwise_count(group[:, None] ^ group[None, :]) <= 3), strict=True):
            want.join(int(group[i]), int(group[j]))
        assert [forest.root(x) for x in group.tolist()] == [want.root(x) for x in group.tolist()]


def test_hot_groups_are_dealt_again(spark, monkeypatch):
    """The same components when almost every group counts as hot, and groups go on over many batches."""
    rng = random.Random(12)
    centre, prints = rng.getrandbits(64), set()
    while len(prints) < 600:
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(rng.choice([8, 22, 64])), rng.randint(1, 6))))
    prints = sorted(prints)
    df = spark.createDataFrame([(k, int(np.uint64(f).view(np.int64))) for k, f in enumerate(prints)], "doc_id long, fp long")
    want = slow_components(prints, prints)
    monkeypatch.setattr(simhash, "HOT", 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {int(np.int64(r.fp).view(np.uint64)): r.root for r in simhash.classes(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want) and 1 < len(set(want.values())) < 600


def test_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('a b c') x").first().x == int(np.uint64(xxhash.xxh64_intdigest("a b c", 42)).view(np.int64))


def test_one_of_each(docs):
    texts = near_copies()
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs(texts)).collect())
    assert kept == sorted(set(slow_components(list(range(len(texts))), [slow_fingerprint(t) for t in texts]).values()))
    odd = simhash.one_of_each(docs(ODD, ODD_IDS))
    assert odd.columns == ["doc_id", "text", "lang", "source", "fp", "score"] and odd.filter("doc_id = 5").count() == 1
    assert simhash.one_of_each(docs([])).count() == 0 and simhash.near_duplicates(docs([])).count() == 0


# Classifiers

def test_held_out(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", labelled.held_out(F.col("id")).alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(200)}


def test_machine_weighs_context():
    g = toxicity.Grammar({("idiot", False): ("insult", 4.0), ("vequ", True): ("insult", 4.0)})
    score = lambda t: sum(s for *_, s in g.clauses(t))
    assert score("an idiot here") == 4 and score("you idiot") == 5 and score("not an idiot") == 1 and score("she said idiot") == 2.5
    assert score("no. an idiot") == 4 and score("idiotic things") == 0 and score("vequaire but xvequ") == 4
    assert score("not one two three four idiot") == 4
    h = toxicity.Grammar({("kill", False): ("threat", 4.0), ("idiot", False): ("insult", 4.0)})
    assert sum(s for *_, s in h.clauses("will kill")) == 6 and sum(s for *_, s in h.clauses("kill idiot idiot")) == 11
    assert g.clauses("nothing") == [] and toxicity.Grammar({}).clauses("idiot") == []


def held_out_accuracy(scored, labels, column):
    rows = scored.join(labels, "doc_id").filter("held_out").toPandas()
    return (rows.predicted == rows[column]).mean(), rows


@pytest.mark.parametrize("data", ["/root/testdata/sf0.1"])
def test_toxicity_on_held_out_rows(spark, data):
    docs_, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    share, rows = held_out_accuracy(QUERIES["op6_toxicity"](spark, data), labels, "toxic")
    assert share > 0.97 and rows[rows.toxic == 1].predicted.mean() > 0.85 and docs_.count()


def test_quality_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    share, rows = held_out_accuracy(QUERIES["op10_mil_quality"](spark, data), spark.read.parquet(f"{data}/labels.parquet"), "quality")
    assert share > 0.97 and rows[rows.quality == 1].predicted.mean() > 0.97


def test_classifiers_take_odd_rows(docs, spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, None, None), (None, 1, 1), (4, 1, 0), (5, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    odd = docs(ODD, ODD_IDS)
    toxic = toxicity.score_toxicity(odd, toxicity.fit_grammar(odd, labels)).collect()
    assert len(toxic) == 8 and all(0 <= r.score <= 1 for r in toxic)
    good = mil_quality.score_quality(odd, mil_quality.fit_quality(odd, labels)).collect()
    assert len(good) == 8 and all(0 <= r.score <= 1 for r in good)
    none = labels.limit(0)
    assert mil_quality.fit_quality(odd, none) is None and mil_quality.score_quality(odd, None).first().score == 0.5
    assert toxicity.score_toxicity(docs([]), toxicity.fit_grammar(docs([]), none)).count() == 0
    assert mil_quality.score_quality(docs([]), None).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    bags, of, y = rng.normal(size=(40, mil_quality.FEATURES)), np.repeat(np.arange(10), 4), (np.arange(10) % 2).astype(float)
    bags[of % 2 == 1, 0] += 3
    model = mil_quality.train(bags, of, y)
    assert ((model.forward(bags, of, 10)["p"] > 0.5) == y).all()
    assert np.allclose(np.bincount(of, model.forward(bags, of, 10)["att"]), 1)
    loss = lambda m: -np.log(np.where(y > 0, m.forward(bags, of, 10)["p"], 1 - m.forward(bags, of, 10)["p"])).mean()
    for name in "wvuac":  # a shorter way, so that no gradient vanishes
        setattr(model, name, getattr(model, name) * 0.3)
    for name, grad in mil_quality.gradients(model, bags, of, y).items():
        weights = getattr(model, name)
        for at in list(np.ndindex(weights.shape))[:: max(1, weights.size // 7)]:
            was, change = weights[at], []
            for step in (1e-5, -1e-5):
                weights[at] = was + step
                change.append(loss(model))
            weights[at] = was
            assert abs((change[0] - change[1]) / 2e-5 - grad[at]) < 1e-6, (name, at)


def test_scores_are_each_documents_own(docs):
    rng = np.random.default_rng(1)
    model = mil_quality.train(rng.normal(size=(40, mil_quality.FEATURES)), np.repeat(np.arange(10), 4), (np.arange(10) % 2).astype(float))
    texts = [None, "", "a b c", "word " * 1000, "x " * 300]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def test_guard_keeps_short_texts(docs):
    """With a lower least number of words, texts below the guard are judged by the base limits alone."""
    rng = random.Random(5)
    prose = [" ".join(rng.choice("the of and to in is that for it was with as river stone walk green window".split()) for _ in range(120)) + "." for _ in range(30)]
    junk = [" ".join(f"{rng.choice('abcdefgh')}{k}##$$%%|" for k in range(n)) for n in (30, 49, 50, 90)]
    kept = {r.doc_id for r in quality_rules.quality_rules(docs(prose + junk), quality_rules.QualityLimits(min_words=5)).filter("kept").collect()}
    assert kept == {*range(30), 30, 31}


def test_verdict_leaves_callers_columns(docs):
    own = docs(["a b c"]).withColumn("quality_verdict", F.lit(7)).withColumn("kept", F.lit("old"))
    row = quality_rules.quality_rules(own).first()
    assert row.quality_verdict == 7 and row.kept is False


# Main text

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><a href=/>home</a></nav><div class="cookie-notice">We use cookies</div>
<main><h2>Title</h2><p>One &amp; two<br>three&nbsp;&#x41;</p><div class="ad">Buy</div><ul><li>a point<li><a href=x>link</a> and text</ul><section class="comments"><p>Great post, thank you very much for this long explanation</p></section></main>
<aside><p>Related things that are very long and go on and on and on</p></aside><form><input>Sign up<button>Go</button></form><footer>&copy; x</footer>"""


def test_main_text():
    assert H.main_text(PAGE) == "Title\nOne & two three A\na point\nlink and text"
    assert H.main_text(None) == H.main_text("") == H.main_text("<script>x</script>") == ""
    assert H.main_text("<p>No container here but a paragraph of decent length for sure.</p><p>Short.</p><ul><li><a href=1>a</a></ul>") == "No container here but a paragraph of decent length for sure.\nShort."
    assert H.main_text("<article><p>" + "x" * 200_000 + "</p></article>") == "x" * 200_000
    assert H.main_text("<article><p>a < b <i title='>'>c</i></article>") == "a < b c"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a \"" * 250_001, "<a '\">" * 200_000, "<div>" * 100_000, "<div>word " * 50_000, "<p><table>" + "<div>x" * 50_000, "<" * 1_000_000, "<!x " * 250_000, "<!--" * 250_000, "<p>" + "<b>" * 200_000 + "</i>" * 50_000])
def test_long_pages_take_linear_time(page):
    at = time.process_time()
    H.main_text(page)
    assert time.process_time() - at < 8  # a quadratic scan would take hours


def test_articles_between_links():
    """Paragraphs that alternate with links, without a container, are all kept."""
    pages = "".join(f"<p>Paragraph {k} tells at some length what happened there and who saw it, with names.</p><p><a href=/{k}>Read more of this</a></p>" for k in range(6))
    assert H.main_text(pages) == "\n".join(f"Paragraph {k} tells at some length what happened there and who saw it, with names." for k in range(6))


def test_cut_by_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randint(1, 8)
        good, bad = ([float(rng.randint(0, 9)) for _ in range(n)] for _ in range(2))
        ties = {(i, j): float(rng.randint(1, 5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}
        cost = lambda keep: sum(b if k else g for k, g, b in zip(keep, good, bad)) + sum(w for (i, j), w in ties.items() if keep[i] != keep[j])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(H.minimum_cut(good, bad, dict(ties))) - best) < 1e-9


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x"), (2, "v", "", "z")], "page_id long, url string, html string, text string")
    got = H.extract_main_text(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.n_chars > 0 for r in got) == 2
    assert H.extract_main_text(pages.limit(0)).count() == 0


# URLs

def test_host_path_and_listed_rules(spark):
    urls = {
        "http://WWW.Example.com/en/7x?q#f": ("www.example.com", "/en/7x", "example.com/en/7", "allow"), "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"), "http://examplexcom/en/": ("examplexcom", "/en/", None, "allow"),
        "x://b.net/de/": ("b.net", "/de/", "net/de/", "allow"), "x://a.example.net/de/88": ("a.example.net", "/de/88", "example.net/de/8", "block"), "http://o.org/es": ("o.org", "/es", None, "allow"), "http://h?x=/en/": ("h", "", None, "allow"),
        "no host": ("", "", None, "allow"), "": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    rows = spark.createDataFrame([*((k, u) for k, u in enumerate(urls)), (99, None), (99, None)], "page_id long, url string")
    got = url_rules.judge_urls(rows, []).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == dict(enumerate(urls.values())) | {99: ("", "", None, "allow")} and len(got) == len(urls) + 2
    assert url_rules.judge_urls(rows.limit(0), []).count() == 0


def test_mined_rules_by_brute_force(spark):
    rng = random.Random(9)
    urls = [(f"http://{rng.choice(['www', 'm'])}.{h}.example.{rng.choice(['com', 'org'])}/en/{rng.randint(1, 99)}", b) for h, b, n in (("free-bets", True, 40), ("free-books", False, 60), ("news", False, 200), ("win-bets", True, 25)) for _ in range(n)]
    rules = url_rules.mine_rules(spark.createDataFrame(urls, "url string, blocked boolean"))
    sets = [(set(url_rules.tokens(u)), b) for u, b in urls]
    for r in rules:
        own = [b for s, b in sets if r.tokens <= s]
        assert abs(sum(own) / len(own) - r.confidence) < 1e-9 and r.confidence >= url_rules.MIN_CONFIDENCE and sum(own) >= url_rules.MIN_SUPPORT * len(urls)
    assert frozenset({"h:bets"}) in {r.tokens for r in rules}
    index = url_rules.RuleIndex(rules)
    assert all(index.blocked(u) == any(r.tokens <= s for r in rules) for (u, _), (s, _) in zip(urls, sets, strict=True))
    assert all(index.blocked(u) == b for u, b in urls)
    assert url_rules.mine_rules(spark.createDataFrame([], "url string, blocked boolean")) == []


def test_url_query_blocks_listed_words(spark, sf):
    rows = QUERIES["op8_url_rules"](spark, "/root/testdata/sf0.1").filter("rule is null").toPandas()
    bad = rows.host.str.contains("casino|pills|spam-farm|bets|ads-track|adult")
    assert (rows[bad].verdict == "block").all() and (rows[~bad].verdict == "allow").all()


# Pipeline

def test_pipeline_by_stages(spark, sf):
    """Each stage against what the operators and brute force say of its own input."""
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs_.columns, docs_
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        if k < 3:
            assert out.columns == columns
            ids = {r.doc_id for r in out.select("doc_id").collect()}
        if k == 0:
            assert ids == {r.doc_id for r in quality_rules.quality_rules(kept).filter("kept").collect()}
        if k == 1:
            model = mil_quality.fit_quality(docs_, spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == {r.doc_id for r in mil_quality.score_quality(kept, model).filter("predicted = 1").collect()}
        if k == 2:
            rows = kept.select("doc_id", "text").orderBy("doc_id").collect()
            assert ids == {rows[k].doc_id for k in slow_kept([r.text for r in rows])[0]}  # five words and similarity 0.8
        if k == 3:
            got = out.toPandas()
            assert set(got.doc_id) == {r.doc_id for r in kept.collect()} and (got.bin_used <= got.bin_capacity).all()
        kept = out.persist()
    assert corpus_pipeline.run(spark, sf).count() == kept.count()
