"""Near-copies of the pipeline against brute-force Jaccard."""

import random

import numpy as np
import pandas as pd
import pytest

from plumeria.llm import near_copies, simhash

from .conftest import ODD, ODD_IDS


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(texts):
    sets, up = [slow_shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    pairs = 0
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {root(k) for k in range(len(texts))}, pairs


def texts_at_all_similarities(seed, bases, copies, changes):
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([60, 112, 248]))]
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, changes)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("seed", "bases", "copies", "changes"), [(1, 30, 5, 4), (2, 2, 150, 8)])
def test_one_of_each_by_brute_force(docs, seed, bases, copies, changes):
    texts = texts_at_all_similarities(seed, bases, copies, changes)
    want, pairs = slow_kept(texts)
    assert pairs > 100 and len(texts) > len(want) > bases  # some copies are too far
    assert {r.doc_id for r in near_copies.one_of_each(docs(texts)).collect()} == want


def test_one_changed_word(docs):
    """As documents 783 and 3006 of sf0.1: 112 words, one differs; their fingerprints are too far for operator 5."""
    rng = random.Random(3)
    base = [f"w{k}" for k in rng.sample(range(5000), 112)]
    assert near_copies.one_of_each(docs([" ".join(base), " ".join([*base[:50], "changed", *base[51:]])])).count() == 1


def test_odd_rows(docs):
    odd = near_copies.one_of_each(docs(ODD, ODD_IDS))
    assert odd.columns == ["doc_id", "text", "lang", "source", "fp", "score"]
    assert sorted(r.doc_id or 0 for r in odd.collect()) == [0, 0, 1, 4, 5]  # the wordless are one, and both rows of id 5
    assert near_copies.one_of_each(docs([])).count() == 0


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 3000):
        for _ in range(20):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            gone = rng.integers(0, max(1, n // 5) + 1)
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, rng.integers(0, max(1, n // 9) + 1)).astype(np.uint64)]))
            x = np.unique(x)
            apart = sum((a ^ b).bit_count() for a, b in zip(near_copies.sketch(x), near_copies.sketch(y), strict=True))
            assert not near_copies.similar(x, y) or 9 * apart <= len(x) + len(y)


def test_similar_is_exact():
    at = lambda n: np.arange(n, dtype=np.uint64)
    assert near_copies.similar(at(8), at(10)) and not near_copies.similar(at(79), at(99))


def test_large_groups_by_brute_force(spark):
    """Of a common passage's texts, exactly the pairs across roots that can be similar, whatever is compared at once."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(80)]
    rows = [(1, k, len(s), 0, k % 7, bytearray(near_copies.sketch(s))) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "token long, id long, n int, pos int, root long, bits binary")
    got = {(r.a, r.b) for r in near_copies.across(members).collect()}
    cells = near_copies.across(members, 16)  # five blocks, so fifteen cells
    assert got == {(r.a, r.b) for r in cells.collect()}
    alike = {(a, b) for a in range(80) for b in range(a) if a % 7 != b % 7 and near_copies.similar(sets[a], sets[b])}
    apart = {(a, b): sum((x ^ y).bit_count() for x, y in zip(near_copies.sketch(sets[a]), near_copies.sketch(sets[b]), strict=True)) for a in range(80) for b in range(a) if a % 7 != b % 7}
    can = {(a, b) for (a, b), d in apart.items() if 9 * d <= len(sets[a]) + len(sets[b]) and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))}
    assert got == can and alike <= got and alike and len(got) < len(apart)


def test_forests_of_near_copies_grow_with_the_texts(spark):
    """Any two of 300 near copies make a pair; their forest has fewer rows than they, and joins all of them; so does the whole stage."""
    base = np.unique(np.random.default_rng(3).integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.delete(base, k % len(base)) for k in range(300)]
    rows = [(1, k, len(s), 0, k, bytearray(near_copies.sketch(s))) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "token long, id long, n int, pos int, root long, bits binary")
    assert near_copies.across(members).count() == 300 * 299 // 2
    pairs = near_copies.across(members, spanning=True)
    assert pairs.count() == 299 and {r.root for r in simhash.components(pairs).collect()} == {0}


def test_groups_come_whole_from_any_batches():
    rng = np.random.default_rng(7)
    keys = np.sort(rng.integers(0, 12, 200))
    second = np.concatenate([np.sort(rng.integers(0, 3, n)) for n in np.unique(keys, return_counts=True)[1]])
    frame = pd.DataFrame({"k": keys, "j": second, "v": np.arange(200)})
    want = [g["v"].tolist() for _, g in frame.groupby(["k", "j"])]
    for size in (1, 7, 200):
        batches = [frame.iloc[:0], *(frame.iloc[at : at + size] for at in range(0, 200, size))]
        got = [v[s:e].tolist() for (_, _, v), starts, ends in near_copies._groups(iter(batches), ["k", "j", "v"], 2) for s, e in zip(starts, ends, strict=True)]
        assert got == want


def test_tallies_tell_long_sets_apart_and_lose_no_similar_pair(spark):
    """Sketches of sets of 3,000 are half full by chance, so they tell nothing; a common passage of 100 is no likeness."""
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    passage = draw(100)
    sets = [np.unique(np.concatenate([passage, draw(2_900)])) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[k : 2_990], draw(4 * k)])) for k, s in enumerate(sets)]
    rows = [(1, k, len(s), 0, k, bytearray(near_copies.sketch(s)), bytearray(near_copies.tally(s))) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "token long, id long, n int, pos int, root long, bits binary, counts binary")
    alike = {(a, b) for a in range(80) for b in range(a) if near_copies.similar(sets[a], sets[b])}
    assert {(r.a, r.b) for r in near_copies.across(members).collect()} == alike == {(k + 40, k) for k in range(40)}
    assert len(near_copies.across(members.drop("counts")).collect()) > 1_000
    assert near_copies.tally(sets[0][:511]) is None


def test_links_of_a_dense_group_become_one_for_each_node(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 400, (2, 20_000))
    pairs = spark.createDataFrame(pd.DataFrame({"a": np.maximum(a, b) * 3, "b": np.minimum(a, b) * 3})).filter("a != b")
    kept = simhash.spanned(pairs.repartition(3)).collect()
    assert all(r.a > r.b for r in kept) and len(kept) <= 4 * 400
    assert {(r.node, r.root) for r in simhash.components(pairs).collect()} == {(3 * k, 0) for k in range(1, 400)}
    chain = pd.DataFrame({"a": np.arange(1, 3_000), "b": np.arange(2_999)}).sample(frac=1, random_state=1)
    assert {r.root for r in simhash.components(spark.createDataFrame(chain)).collect()} == {0}


def test_salts_make_no_more_rows_than_links(spark):
    both = spark.createDataFrame([(u, v, v % simhash.SALTS) for u, v in [(5, 2), (5, 7), (9, 1), (1, 9), *((3, k) for k in range(100, 400))]], "u long, v long, salt long")
    got = {r.u: (r.m, len(r.salts)) for r in simhash.leasts(both).collect()}
    assert got == {5: (2, 2), 9: (1, 1), 1: (1, 1), 3: (3, simhash.SALTS)}
