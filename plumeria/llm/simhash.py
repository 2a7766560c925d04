"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within a radius have a variant in common that lies within half the radius of both.
The radius is 3, so half leaves one bit over. Of three differing bits, at least one lies in one of
three blocks of the 64; with that block blanked at most two differ, and variants within 1 of each
meet. So each fingerprint is blanked in each block in turn and emits all variants within 1 of the rest:
133 rows, where variants within 2 of all 64 bits would be 2,081. Fingerprints that share a variant are
compared in full, so the links found are exactly those within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, written

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: The three blocks of bits, the first one longer by a bit.
BLOCKS = (range(0, 22), range(22, 43), range(43, 64))
#: Fingerprints that are compared with all later ones of their group at a time.
COMPARED_AT_ONCE = 512
#: A group of more fingerprints is dealt out again by parts of the blanked block.
HOT = 2048
#: Ways in which a node's links are dealt in a star step, so that no task holds all links of a hub.
SALTS = 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the runs of so many words, repeats included; of all words where there are fewer; none without words."""
    found = (text or "").encode().lower().split()  # of bytes: lower-cases A-Z, splits at ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) > words else [b" ".join(found)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) of each row; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array, "text_hash": batch["text_hash"].array, "fp": fp.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def variants(fp: Column) -> Column:
    """Array of (block, variant) structs: the fingerprint with a block blanked, and each other bit flipped or none."""
    out = []
    for k, block in enumerate(BLOCKS):
        keep = ((1 << 64) - 1) ^ sum(1 << b for b in block)
        kept = fp.bitwiseAND(F.lit(_signed(keep)))
        flips = [0, *(1 << b for b in range(64) if b not in block)]
        out += [F.struct(F.lit(k).cast("byte").alias("block"), kept.bitwiseXOR(F.lit(_signed(x))).alias("variant")) for x in flips]
    return F.array(*out)


class _Forest:
    """Union-find over the fingerprints of a task; the least one is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _links(group: np.ndarray, forest: _Forest) -> None:
    """Join all fingerprints of a group that are within the radius.

    In a large group, those that differ in one bit are found first by looking each flipped bit up. Pairs
    that are already in the largest component need no comparison; all others are compared, block by
    block.
    """
    if len(group) > COMPARED_AT_ONCE:
        group = np.sort(group)
        for bit in range(64):
            flipped = group ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(group, flipped), len(group) - 1)
            for k in np.flatnonzero((group[at] == flipped) & (group < flipped)).tolist():
                forest.join(int(group[k]), int(flipped[k]))
    roots = np.fromiter((forest.root(x) for x in group.tolist()), np.uint64, len(group))
    kinds, sizes = np.unique(roots, return_counts=True)
    if len(kinds) == 1:
        return
    joined = roots == kinds[sizes.argmax()]
    group = np.concatenate([group[~joined], group[joined]])
    rest = len(group) - int(joined.sum())
    for at in range(0, rest, COMPARED_AT_ONCE):
        head = group[at : min(at + COMPARED_AT_ONCE, rest)]
        for to in range(at, len(group), 16 * COMPARED_AT_ONCE):
            other = group[to : to + 16 * COMPARED_AT_ONCE]
            x, y = np.nonzero(np.bitwise_count(head[:, None] ^ other[None, :]) <= RADIUS)
            ordered = x + at < y + to
            for a, b in zip(head[x[ordered]].tolist(), other[y[ordered]].tolist(), strict=True):
                forest.join(a, b)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that span every component of ``distinct`` (fp): each task keeps a forest of its links, not all pairs.

    A group of over ``HOT`` fingerprints is not compared by the task that meets it: it is dealt out again.
    Its members differ in 3 bits at most only if they agree on one of four parts of their blanked block,
    so each goes to the four groups of its parts; of those, large ones are compared in blocks.
    """
    emitted = distinct.select("fp", F.explode(variants(F.col("fp"))).alias("v")).select("v.block", "v.variant", "fp")
    found = written(_met(emitted, ["block", "variant"], HOT), "met")
    hot = found.filter("a is null")
    pairs = found.filter("a is not null").select("a", "b")
    if not hot.limit(1).count():
        return pairs
    parts = []
    for k, block in enumerate(BLOCKS):
        for j in range(RADIUS + 1):
            bits = sum(1 << b for b in block[j :: RADIUS + 1])
            parts.append(F.when(F.col("block") == k, F.struct(F.lit(k * 8 + j).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(bits))).alias("value"))))
    again = hot.select("variant", "fp", F.explode(F.array_compact(F.array(*parts))).alias("p")).select("variant", "p.part", "p.value", "fp")
    return pairs.unionByName(_met(again, ["variant", "part", "value"], None).select("a", "b"))


def _met(rows: DataFrame, keys: list[str], hot: int | None) -> DataFrame:
    """(a, b, block, variant, fp): links between the fingerprints of each group of ``rows``; of groups over ``hot``, the members instead."""
    met = rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
    longs = lambda x: pd.array(x, "Int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held, passed = _Forest(), [], None  # held: pieces of the group that may go on; passed: the hot group being passed on

        def members(columns: list[np.ndarray]) -> pd.DataFrame:
            n = len(columns[-1])
            none = longs([None] * n)
            return pd.DataFrame({"a": none, "b": none, "block": longs(columns[0].astype(np.int64)), "variant": longs(columns[1]), "fp": longs(columns[-1])})

        def compare(columns: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            fp = columns[-1].view(np.uint64)
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(fp)]])
            sizes = ends - starts
            for s in starts[sizes == 2].tolist():  # most groups
                if (int(fp[s]) ^ int(fp[s + 1])).bit_count() <= RADIUS:
                    forest.join(int(fp[s]), int(fp[s + 1]))
            for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                if hot and e - s > hot:
                    yield members([c[s:e] for c in columns])
                else:
                    _links(fp[s:e], forest)

        for batch in batches:
            now = [batch[c].to_numpy() for c in (*keys, "fp")]
            if not len(now[0]):
                continue
            first, last = tuple(c[0] for c in now[:-1]), tuple(c[-1] for c in now[:-1])
            opened = int(np.flatnonzero(np.logical_and.reduce([c == x for c, x in zip(now[:-1], last, strict=True)]))[0])  # where the last group begins
            if passed is not None:
                own = np.logical_and.reduce([c == x for c, x in zip(now[:-1], passed, strict=True)])
                if n := int(own.sum()):
                    yield members([c[:n] for c in now])
                    now, opened = [c[n:] for c in now], opened - n
                if not len(now[0]):
                    continue
                passed, first = None, tuple(c[0] for c in now[:-1])
            if opened > 0 or (held and first != tuple(c[0] for c in held[0][:-1])):
                done = [np.concatenate(x) for x in zip(*held, [c[: max(opened, 0)] for c in now], strict=True)]
                yield from compare(done)
                held = [[c[max(opened, 0) :] for c in now]]
            else:
                held.append(now)
            if hot and sum(len(h[0]) for h in held) > hot:
                passed = last
                for h in held:
                    yield members(h)
                held = []
        if held:
            yield from compare([np.concatenate(x) for x in zip(*held, strict=True)])
        pairs = np.array([(x, forest.root(x)) for x in list(forest.up) if forest.root(x) != x], np.uint64).reshape(-1, 2).view(np.int64)
        none = longs([None] * len(pairs))
        yield pd.DataFrame({"a": longs(pairs[:, 0]), "b": longs(pairs[:, 1]), "block": none, "variant": none, "fp": none})

    return met.mapInPandas(run, "a long, b long, block long, variant long, fp long")


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of the links (a, b) to the least one that they reach, instead of all of them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def spanned(edges: DataFrame) -> DataFrame:
    """Links (a, b) of the same components as ``edges`` (a, b), a > b: each task has all links of its nodes a, and keeps one for each node.

    In a group of near copies most members meet with several others, in as many rows; what goes on grows
    with the nodes only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches]
        if held:
            a, b = _spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pd.DataFrame({"a": a, "b": b})

    return edges.repartition("a").mapInPandas(run, "a long, b long")


def leasts(both: DataFrame) -> DataFrame:
    """(u, m, salts) of each node u of ``both`` (u, v, salt): the least of it and its neighbours, and only the salts that its links have, so that they make no more rows than links."""
    return both.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("salt").alias("salts")).withColumn("m", F.least("m", "u"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of ``pairs`` (a, b): alternating large-star and small-star steps until none changes a link.

    Each step moves every link towards its component's least node; a link that a step made twice is
    kept once. Before, each task keeps only links that span what its own links join. The links are written in the shared folder after each round.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        least = leasts(both)
        out = both.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"])
        if large:
            out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    edges, before = written(spanned(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")).distinct(), "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, old = now, edges
        edges = written(star(star(edges, True), False), "links")
        discard(old)


def classes(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each different fingerprint of ``marked`` (doc_id, fp); a table in the shared folder."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    nodes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(nodes.select("fp", "root").join(named, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    Fingerprints link at ``RADIUS`` or fewer differing bits; component_id is the smallest doc_id that
    links reach. Equal fingerprints meet before anything is emitted, so copies cost one row. Texts
    without words have fingerprint zero and link like any other. A null doc_id counts for no
    component's smallest; a component of null ids alone has a null component_id. Repeated rows come
    back as often; an empty table gives no rows; other columns are ignored.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    return marked.join(classes(marked), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then of the least text hash.

    Rows that share both are copies, and one of them stays. The columns are packed into one meanwhile, so
    no name of theirs can clash.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    kept = marked.join(classes(marked), "fp").groupBy("root").agg(first.alias("k"))
    kept = kept.select(F.coalesce("k.doc_id", F.lit(-1)).alias("kept_id"), F.col("k.unnamed").alias("kept_null"), F.col("k.text_hash").alias("kept_hash"))
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("kept_hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("kept_id"), F.col("doc_id").isNull().alias("kept_null"))
    keys = ["kept_id", "kept_null", "kept_hash"]
    return rows.join(kept, keys).dropDuplicates(keys).select("row.*")
