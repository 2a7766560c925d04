"""SimHash near-dedup at a given shingle similarity: operator 5's ball hashing over five-word fingerprints, and what lies beyond its ball.

Texts of similarity 0.8 or more (Jaccard, of sets of five-word shingles) have fingerprints that differ in up
to some 14 of 64 bits, and no ball of that radius can be enumerated. So ball hashing links the bulk, copies
and near-copies within 3 bits, each candidate checked by its whole sets; and the pairs whose fingerprints
lie further apart are found by prefixes: two such sets have a member in common among the first fifth (and
one) of each, in one order of all shingles. Only sets that the fingerprints left in different components
meet there. Any order finds all pairs; this one puts shingles that many texts have last, so few sets meet
for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, discard, written
from .simhash import SEED, _Forest, components, links, majority, shingle_hashes

SHINGLE_WORDS = 5
#: The least similarity, as a fraction: 4 / 5.
OVER, UNDER = 4, 5
#: One of so many sets is asked for shingles that others have too, and so many of these are kept at most (8 MB); they set the order, not the result.
ASKED, FREQUENT = 8, 1_000_000
#: Bits of a set's sketch.
SKETCH_BITS = 512
#: Residues by which a set of so many members or more is counted too, as half of a long set's sketch bits are set by chance.
COUNTED = 512
#: Pairs whose counts are compared at once (100 MB).
COUNTS_AT_ONCE = 50_000
#: Sets of one shingle beyond which they are compared with a few of them first, and then only across what that left apart.
LARGE, HUBS = 64, 3
#: Texts of one end that are compared in a cell, about.
TEXTS_AT_ONCE = 1_000
#: Members of such a group that are compared in one cell with each other, and with those of another block; about.
ACROSS = 4_096
#: Pairs of a large group whose sketches are compared at once, about (16 MB for each side).
PAIRS_AT_ONCE = 250_000
#: Links of large groups' forests beyond which another forest is asked for before all other pairs are.
MANY = 1_000


def shingles(text: str | None) -> np.ndarray:
    """Ascending hashes of the different runs of five words; of all words where there are fewer; none without words."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two ascending sets reaches the least; exact, in whole numbers."""
    if UNDER * min(len(x), len(y)) < OVER * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")  # two runs, merged
    both = int(np.count_nonzero(both[1:] == both[:-1]))
    return UNDER * both >= OVER * (len(x) + len(y) - both)


def sketch(own: np.ndarray) -> bytes:
    """A bit for each residue of the set's members: whether their number is odd."""
    counts = np.bincount((own % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def tally(own: np.ndarray) -> bytes | None:
    """Of a large set, how many members each residue has, 255 at most; None of a small one, whose sketch tells as much."""
    if len(own) < COUNTED:
        return None
    return np.minimum(np.bincount((own % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED), 255).astype(np.uint8).tobytes()


def _words(bits) -> np.ndarray:
    """Sketches as rows of words."""
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), SKETCH_BITS // 64)


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of these sketches, a row each, and of these sizes together can be similar."""
    return (OVER + UNDER) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (UNDER - OVER) * n


def _alike(x: list, y: list, n: np.ndarray) -> np.ndarray:
    """Whether sets of these tallies, a pair each, and of these sizes together can be similar; one without a tally can.

    What two tallies differ by, summed up, is no more than the members that only one of the sets has.
    """
    out = np.ones(len(n), bool)
    both = np.flatnonzero([a is not None and b is not None for a, b in zip(x, y, strict=True)])
    for at in range(0, len(both), COUNTS_AT_ONCE):
        k = both[at : at + COUNTS_AT_ONCE]
        a, b = (np.frombuffer(b"".join([side[i] for i in k.tolist()]), np.uint8).reshape(len(k), COUNTED).astype(np.int16) for side in (x, y))
        out[k] = (OVER + UNDER) * np.abs(a - b).sum(axis=1, dtype=np.int64) <= (UNDER - OVER) * n[k]
    return out


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (id, n, bits) can be similar; none that is similar is lost.

    Each bit in which two sketches differ stands for a member that only one set has, and sets of similarity
    0.8 have at most a ninth of both sizes of these. So few texts have to be read again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[_close(_words(batch["bits_a"]), _words(batch["bits_b"]), batch["n"].to_numpy(np.int64)), ["a", "b"]]

    end = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "bits_a", "bits_b")
    return written(both.mapInPandas(run, "a long, b long"), "plausible")


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The members of a set that decide whom it meets, frequent ones last."""
    at = np.minimum(np.searchsorted(frequent, own), max(0, len(frequent) - 1))
    common = frequent[at] == own if len(frequent) else np.zeros(len(own), bool)
    return np.concatenate([own[~common], own[common]])[: len(own) - -(-OVER * len(own) // UNDER) + 1 if len(own) else 0]


def _may(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs that first meet at these places of their prefixes can have enough in common."""
    a, b = n[i], n[j]
    most = np.minimum(a - pos[i], b - pos[j])
    return (UNDER * np.minimum(a, b) >= OVER * np.maximum(a, b)) & ((OVER + UNDER) * most >= OVER * (a + b))


def _groups(batches: Iterator[pd.DataFrame], columns: list[str], keys: int = 1) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of whole groups of the first ``keys`` columns, with the groups' starts and ends; each row is copied once."""
    held: list[list[np.ndarray]] = []
    whole = lambda: _bounded([np.concatenate(x) for x in zip(*held, strict=True)], keys)
    for batch in batches:
        now = [batch[c].to_numpy() for c in columns]
        if not len(now[0]):
            continue
        last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in now[:keys]]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
        if cut:
            held.append([x[:cut] for x in now])
        elif held and all(h[0] == c[0] for h, c in zip(held[0][:keys], now, strict=False)):
            held.append(now)
            continue
        if held:
            yield whole()
        held = [[x[cut:] for x in now]]
    if held:
        yield whole()


def _bounded(now: list[np.ndarray], keys: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in now[:keys]])) + 1
    return now, np.concatenate([[0], change]), np.concatenate([change, [len(now[0])]])


def _pairs(sets: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    a, b = np.maximum(sets[i], sets[j]), np.minimum(sets[i], sets[j])
    return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def meetings(rows: DataFrame) -> DataFrame:
    """(token, a, b, n, pos): pairs to compare (token null), and the members (token, a) of large groups.

    ``rows`` are (token, id, n, pos, root). Small groups give all pairs of different roots that can be
    similar, large ones each member with their ``HUBS`` least.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (token, sets, n, pos, root), starts, ends in _groups(batches, ["token", "id", "n", "pos", "root"]):
            sizes = ends - starts
            left, right = [starts[sizes == 2]], [starts[sizes == 2] + 1]
            for s, e in zip(starts[(sizes > 2) & (sizes <= LARGE)].tolist(), ends[(sizes > 2) & (sizes <= LARGE)].tolist(), strict=True):
                i, j = np.triu_indices(e - s, 1)
                left.append(i + s)
                right.append(j + s)
            for s, e in zip(starts[sizes > LARGE].tolist(), ends[sizes > LARGE].tolist(), strict=True):
                for hub in (np.argsort(sets[s:e], kind="stable")[:HUBS] + s).tolist():
                    rest = np.delete(np.arange(s, e), hub - s)
                    left.append(rest)
                    right.append(np.full(len(rest), hub))
                yield pd.DataFrame({"token": token[s:e], "a": sets[s:e], "b": sets[s:e], "n": n[s:e], "pos": pos[s:e]}).astype({"token": "Int64"})
            i, j = np.concatenate(left), np.concatenate(right)
            fits = (root[i] != root[j]) & _may(n, pos, i, j)
            yield _pairs(sets, i[fits], j[fits]).assign(token=pd.array([None], "Int64")[0], n=0, pos=0)[["token", "a", "b", "n", "pos"]].astype({"token": "Int64"})

    return rows.repartition("token").sortWithinPartitions("token", "id").mapInPandas(run, "token long, a long, b long, n int, pos int")


def across(members: DataFrame, block: int = ACROSS, spanning: bool = False) -> DataFrame:
    """(a, b) of the pairs of ``members`` (token, id, n, pos, root, bits, and counts if known) that share a token, have different roots and can be similar.

    Texts that have a common passage but little else meet here in large groups, so their sketches are compared
    before a pair becomes a row, and the tallies (counts) of those that are too long for a sketch to tell. A group of over ``block`` members is cut into blocks of about so many, and each
    pair of blocks is a cell of its own, so that many tasks share the group; of a cell, some ``PAIRS_AT_ONCE``
    are looked at together. With ``spanning``, a cell gives only pairs that would join its roots if all were
    similar, closer sketches first: fewer than the roots, where near copies of one text make a pair of any two.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, low, high, own, sets, n, pos, root, bits, counts), starts, ends in _groups(batches, ["token", "low", "high", "own", "id", "n", "pos", "root", "bits", "counts"], 3):
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                kinds, of, sizes = np.unique(root[s:e], return_inverse=True, return_counts=True)
                if len(kinds) == 1:
                    continue
                joined = of == sizes.argmax()  # pairs within the largest are linked already
                order = np.concatenate([np.flatnonzero(~joined), np.flatnonzero(joined)]) + s
                words = _words(bits[s:e])
                rest, step, forest = len(order) - int(joined.sum()), max(1, PAIRS_AT_ONCE // len(order)), _Forest()
                for at in range(0, rest, step):
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + step, rest)), np.arange(at, len(order)), indexing="ij"))
                    i, j = order[i[i < j]], order[j[i < j]]
                    fits = (root[i] != root[j]) & _may(n, pos, i, j)
                    if low[s] != high[s]:  # pairs of one block have a cell of their own
                        fits &= own[i] != own[j]
                    i, j = i[fits], j[fits]
                    both = n[i].astype(np.int64) + n[j]
                    close = _close(words[i - s], words[j - s], both)
                    i, j, both = i[close], j[close], both[close]
                    close = _alike(counts[i].tolist(), counts[j].tolist(), both)
                    i, j = i[close], j[close]
                    if spanning and len(i):
                        nearer = np.argsort(np.bitwise_count(words[i - s] ^ words[j - s]).sum(axis=1, dtype=np.int64), kind="stable")
                        i, j = i[nearer], j[nearer]
                        kept = [forest.join(a, b) for a, b in zip(root[i].tolist(), root[j].tolist(), strict=True)]
                        i, j = i[kept], j[kept]
                    if len(i):
                        yield _pairs(sets, i, j)

    if "counts" not in members.columns:
        members = members.withColumn("counts", F.lit(None).cast("binary"))

    large = members.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
    placed = members.join(large, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "n", "pos", "root", "bits", "counts")
    return dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "id").mapInPandas(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``texts`` (id, text) are similar, of those that are ``plausible``.

    Pairs are dealt into cells by the hashes of both ends, so a text goes to a cell once for all its pairs there,
    and what a cell holds doesn't grow with the table.
    """

    def run(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        sets = {k: shingles(t) for k, t in zip(own["id"], own["text"], strict=True)}
        fits = [similar(sets[a], sets[b]) for a, b in zip(some["a"], some["b"], strict=True)]
        return some.loc[np.array(fits, bool), ["a", "b"]]

    pairs = plausible(pairs, sets)
    ends = F.explode(F.array("a", "b")).alias("id")
    side = 8 + pairs.select(ends).distinct().count() // TEXTS_AT_ONCE
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    dealt = pairs.select((part("a") * side + part("b")).alias("cell"), "a", "b")
    sent = dealt.select(F.col("cell").alias("to"), ends).distinct().join(texts, "id")
    both = dealt.groupBy("cell").cogroup(sent.groupBy("to"))
    return written(both.applyInPandas(run, "a long, b long"), "similar")


def near_sets(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Similar pairs (a, b) among those that ball hashing joins, of ``sets`` (id, fp, n, bits) with their ``texts`` (id, text).

    Sets of one fingerprint, and the least sets of fingerprints that link, are checked as wholes.
    """
    least = written(sets.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    alike = sets.join(least, "fp").filter("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    named = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"set_{c}"))
    near = links(least.select("fp")).join(named("a"), "a").join(named("b"), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    return linked(alike.unionByName(near).distinct(), sets, texts)


def similar_sets(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of every set that similar pairs link to a lesser root; ``sets`` (id, fp, n, bits, counts) and ``texts`` (id, text) have a row for each different set."""
    near = near_sets(sets, texts)
    roots = components(near)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                yield pd.DataFrame({"token": np.concatenate([shingles(t) for t in batch["text"].iloc[at : at + 500]]).view(np.int64)})

    counted = texts.filter(F.pmod(F.xxhash64("id"), F.lit(ASKED)) == 0).mapInPandas(own, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    listed = counted.filter("c >= 2").orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()["token"]
    frequent = np.sort(listed.to_numpy(np.int64).view(np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = [shingles(t) for t in part["text"]]
                firsts = [prefix(s, frequent) for s in found]
                sizes = [len(f) for f in firsts]
                pos = np.concatenate([np.arange(k) for k in sizes])
                yield pd.DataFrame({"token": np.concatenate(firsts).view(np.int64), "id": np.repeat(part["id"].to_numpy(), sizes), "n": np.repeat([len(s) for s in found], sizes), "pos": pos, "root": np.repeat(part["root"].to_numpy(), sizes)})

    placed = lambda df, found: df.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    met = written(meetings(placed(texts, roots).mapInPandas(run, "token long, id long, n int, pos int, root long")), "meetings")
    first = written(met.filter("token is null").select("a", "b").distinct(), "pairs")
    found = near.unionByName(linked(first, sets, texts))
    members = met.filter("token is not null").select("token", F.col("a").alias("id"), "n", "pos")
    roots = components(found)
    if members.limit(1).count():
        tried, spanning = first, True
        while True:  # forests of large groups as long as they find many links; then all pairs that these leave apart
            asked = across(placed(members, roots).join(sets.select("id", "bits", "counts"), "id"), spanning=spanning)
            pairs = written(asked.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            more = linked(pairs, sets, texts)
            n = more.count()
            if n:
                found = found.unionByName(more)
                roots = components(found)
            tried = tried.unionByName(pairs)
            if not spanning:
                break
            spanning = n >= MANY
        discard(tried)
    discard(met)
    discard(first)
    return roots


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group that similarities of 0.8 or more link: that of the smallest doc_id (null last), then of the least text hash.

    Texts of one set of shingles, texts without words among them, are copies. The columns are packed into
    one meanwhile, so no name of theirs can clash. An empty table gives no rows.
    """

    @F.pandas_udf("kept_set long, fp long, n int, bits binary, counts binary")
    def mark(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            hashes = [shingle_hashes(t, SHINGLE_WORDS) for t in batch]
            sets = list(map(np.unique, hashes))
            own = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            fp = np.fromiter(map(majority, hashes), np.uint64, len(hashes)).view(np.int64)
            yield pd.DataFrame({"kept_set": own, "fp": fp, "n": list(map(len, sets)), "bits": list(map(sketch, sets)), "counts": list(map(tally, sets))})

    keys = ["kept_null", "kept_id", "kept_hash"]
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    named = rows.select("row", F.struct(F.col("row.doc_id").isNull().alias("kept_null"), F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-1)).alias("kept_id"), F.xxhash64(text).alias("kept_hash")).alias("k"), mark(text).alias("m"))
    first = F.min(F.struct(*keys)).alias("k")
    # rows move once, by their sets, of which each task sends one row; what joins them later comes to their buckets
    unique = bucketed(named.groupBy("m.kept_set").agg(F.min("k").alias("k"), F.min_by("row", "k").alias("row"), *(F.min(f"m.{c}").alias(c) for c in ("fp", "n", "bits", "counts"))), "unique", "kept_set")
    firsts = written(unique.select("kept_set", "fp", "n", "bits", "counts", "k.*"), "firsts")
    sets = firsts.select(F.col("kept_set").alias("id"), "fp", "n", "bits", "counts")
    roots = similar_sets(sets, unique.select(F.col("kept_set").alias("id"), F.col("row.text").cast("string").alias("text")))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # a root is no node of its own
    placed = firsts.join(roots.withColumnRenamed("node", "kept_set"), "kept_set")
    best = placed.groupBy("root").agg(first).select("root", "k.*")
    dropped = placed.select("kept_set").join(best.join(firsts, keys).select("kept_set"), "kept_set", "left_anti")
    return unique.join(dropped, "kept_set", "left_anti").select("row.*")
