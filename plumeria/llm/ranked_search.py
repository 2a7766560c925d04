"""Ranked lexical search over a clustered index of reordered documents.

Recursive graph bisection puts documents that share terms side by side: its upper levels are fitted on a bounded
sample and every document is sent down them, and below them the documents themselves are bisected, in blocks of
bounded size. Runs of the new order are the shards. A shard knows the most that each term can be worth in
it, so a query has a bound for each shard. Shards are visited in bands of falling bounds until no shard's bound
reaches the last score that counts, so no hit is missed; hits are named and ties are broken by doc_id.

All scores are whole numbers. They are summed in doubles, exactly, as they stay below 2**53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written

TOP = 50
#: Queries, and their different terms together, that are searched for at a time; each such block reads the documents once.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 1_000, 200_000
#: Documents that the upper levels are fitted on, at most, and those levels. It decides how well shards prune, not what is found.
SAMPLE, LEVELS = 8_192, 6
#: Documents that are bisected together below them, and those of a shard.
BLOCK_DOCS, SHARD_DOCS = 4_096, 512
#: Exchanges of a bisection.
EXCHANGES = 6
#: Shards that a query visits first, and bands in which it visits what can still count after that.
FIRST, BANDS = 4, 4
#: Separators as blanks, A-Z in lower case; digits, letters and all beyond ASCII stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return (text or "").encode().translate(TABLE).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, before the term's weight."""
    m = 100 - 50 + (50 * n.astype(np.int64) * documents) // length
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def gather(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all entries of these runs, one run after another."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    return degree * np.log2(size / (degree + 1.0))


class Bisector:
    """Documents as runs of terms (``starts`` and ``flat``), which bisections divide."""

    def __init__(self, starts: np.ndarray, flat: np.ndarray):
        self.starts, self.flat = starts, flat

    def halves(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """Two halves of ``docs``: those are exchanged whose move lowers the cost of both halves' lists most."""
        n = len(docs)
        sizes = self.starts[docs + 1] - self.starts[docs]
        used, flat = np.unique(self.flat[gather(self.starts[docs], self.starts[docs + 1])], return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        left = np.arange(n) < n // 2
        nl, nr = n // 2, n - n // 2
        degree = np.bincount(flat, minlength=len(used))
        dl = np.bincount(flat[left[owner]], minlength=len(used))
        for _ in range(EXCHANGES):
            dr = degree - dl
            now = _cost(dl, nl) + _cost(dr, nr)
            to_right = now - _cost(np.maximum(dl - 1, 0), nl) - _cost(dr + 1, nr)
            to_left = now - _cost(dl + 1, nl) - _cost(np.maximum(dr - 1, 0), nr)
            gain = np.bincount(owner, np.where(left[owner], to_right[flat], to_left[flat]), n)
            one, two = np.flatnonzero(left), np.flatnonzero(~left)
            one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
            m = min(len(one), len(two))
            moved = int(np.count_nonzero(gain[one[:m]] + gain[two[:m]] > 1e-9))  # both fall, so these come first
            if not moved:
                break
            left[one[:moved]], left[two[:moved]] = False, True
            dl = np.bincount(flat[left[owner]], minlength=len(used))
        dr = degree - dl
        return docs[left], docs[~left], {"terms": used, "dl": dl, "dr": dr, "nl": max(1, nl), "nr": max(1, nr), "flat": flat, "owner": owner, "n": n}

    def order(self, docs: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """Runs of at most ``least`` documents, side by side as the recursion leaves them."""
        if len(docs) <= least:
            yield docs
            return
        one, two, _ = self.halves(docs)
        yield from self.order(one, least)
        yield from self.order(two, least)


class Tree:
    """The upper levels: at each node, what each term adds to the price of going left, and the middle of the sample's prices."""

    def __init__(self, starts: np.ndarray, flat: np.ndarray, vocabulary: int, levels: int = LEVELS):
        self.levels = levels
        self.prices = np.zeros(((1 << levels) - 1, vocabulary), np.float32)
        self.middles = np.zeros((1 << levels) - 1)
        bisector, nodes = Bisector(starts, flat), {0: np.arange(len(starts) - 1)}
        for node in range((1 << levels) - 1):
            docs = nodes.pop(node, np.empty(0, np.int64))
            if len(docs) < 2:
                continue
            one, two, x = bisector.halves(docs)
            price = _cost(x["dl"] + 1, x["nl"]) + _cost(x["dr"], x["nr"]) - _cost(x["dl"], x["nl"]) - _cost(x["dr"] + 1, x["nr"])
            self.prices[node, x["terms"]] = price
            self.middles[node] = np.median(np.bincount(x["owner"], price[x["flat"]], x["n"]))
            nodes[2 * node + 1], nodes[2 * node + 2] = one, two

    def leaves(self, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The leaf of each document of these sizes, whose terms stand one after another."""
        owner, node = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes), np.int64)
        for _ in range(self.levels):
            price = np.bincount(owner, self.prices[node[owner], flat], len(sizes))
            node = 2 * node + 1 + (price > self.middles[node])
        return node - ((1 << self.levels) - 1)


def _u4(column) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all cells, their counts) of a column of packed numbers."""
    cells = [bytes(c) for c in column]
    return np.frombuffer(b"".join(cells), "<u4").astype(np.int64), np.array([len(c) // 4 for c in cells], np.int64)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: n counts all of its terms, the packed numbers only those of ``vocabulary``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                found = terms(text)
                if found:
                    own, counts = np.unique(np.fromiter((k for k in map(get, found) if k is not None), np.int64), return_counts=True)
                    rows.append((doc_id, len(found), own.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"])
            yield out.astype({"doc_id": "Int64", "n": "int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, n long, terms binary, counts binary")


def statistics(found: DataFrame, vocabulary: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and how many documents hold each term of the vocabulary, of all ``postings``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, documents, length = np.zeros(vocabulary, np.int64), 0, 0
        for frame in frames:
            df += np.bincount(_u4(frame["terms"])[0], minlength=vocabulary)
            documents, length = documents + len(frame), length + int(frame["n"].sum())
        held = np.flatnonzero(df)
        yield pd.DataFrame({"term": [-1, -2, *held.tolist()], "n": [documents, length, *df[held].tolist()]})

    sums = {r.term: r.n for r in found.select("n", "terms").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(-1, 0), sums.pop(-2, 0), np.array([sums.get(k, 0) for k in range(vocabulary)], np.int64)


def clustered_index(found: DataFrame, vocabulary: int, documents: int, length: int, sample: int = SAMPLE, levels: int = LEVELS, block: int = BLOCK_DOCS, shard: int = SHARD_DOCS) -> DataFrame:
    """A row for each shard of the reordered ``postings``, a written table.

    terms and most are its terms and the most each is worth there; starts, docs and impacts are their lists, by
    places of documents in the shard; ids and named are those documents' ids. Documents without a term of the
    vocabulary are left out, as nothing finds them.
    """
    held = found.filter("octet_length(terms) > 0")
    share = min(1.0, 0.95 * sample / max(1, documents)) * (1 << 31)  # no task sends more than its share of the sample
    drawn = held.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31)) < share).select("terms").limit(sample).toPandas()["terms"]
    flat, sizes = _u4(drawn)
    tree = Tree(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat, vocabulary, levels)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat, sizes = _u4(frame["terms"])
            yield frame.assign(leaf=tree.leaves(sizes, flat).astype(np.int32)).astype({"doc_id": "Int64"})

    def pack(rows: pd.DataFrame) -> Iterator[tuple]:
        flat, sizes = _u4(rows["terms"])
        counts, n = _u4(rows["counts"])[0], rows["n"].to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ids, named = rows["doc_id"].fillna(0).to_numpy(np.int64), rows["doc_id"].notna().to_numpy()
        for own in Bisector(starts, flat).order(np.arange(len(rows)), shard):
            at = gather(starts[own], starts[own + 1])
            place = np.repeat(np.arange(len(own)), sizes[own])
            worth = impacts(counts[at], np.repeat(n[own], sizes[own]), documents, length)
            by = np.argsort(flat[at], kind="stable")
            term, first = np.unique(flat[at][by], return_index=True)
            packed = (term, np.maximum.reduceat(worth[by], first), np.concatenate([first, [len(by)]]), place[by], worth[by])
            yield (*(x.astype("<u4").tobytes() for x in packed), ids[own].astype("<i8").tobytes(), named[own].tobytes())

    def shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, made = [], 0, 0
        names = ["terms", "most", "starts", "docs", "impacts", "ids", "named"]

        def full(rows: list[pd.DataFrame]) -> pd.DataFrame:
            nonlocal made
            out = pd.DataFrame(pack(pd.concat(rows, ignore_index=True)), columns=names)
            out.insert(0, "shard", (TaskContext.get().partitionId() << 32) + made + np.arange(len(out)))
            made += len(out)
            return out

        for frame in frames:
            frame = frame.astype({"doc_id": "Int64"})
            at, leaf = 0, frame["leaf"].to_numpy()
            while at < len(frame):
                if held and held[0]["leaf"].iat[0] != leaf[at]:
                    yield full(held)
                    held, count = [], 0
                to = min(int(np.searchsorted(leaf, leaf[at], "right")), at + block - count)
                held.append(frame.iloc[at:to])
                count, at = count + to - at, to
                if count == block:
                    yield full(held)
                    held, count = [], 0
        if held:
            yield full(held)

    placed = held.mapInPandas(route, "doc_id long, n long, terms binary, counts binary, leaf int")
    order = ["leaf", F.xxhash64("doc_id", "n", "terms")]  # copies are spread like any others
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id")
    return written(placed.mapInPandas(shards, "shard long, terms binary, most binary, starts binary, docs binary, impacts binary, ids binary, named binary"), "index")


class Queries:
    """A block of queries: each one's terms and their weights, one query after another."""

    def __init__(self, own: list[np.ndarray], weights: np.ndarray):
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.terms = np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64)
        self.weights = weights[self.terms]
        self.owner = np.repeat(np.arange(len(own)), self.sizes)

    def bounds(self, term: np.ndarray, most: np.ndarray, vocabulary: int) -> np.ndarray:
        """The most that each query can score in a shard."""
        full = np.zeros(vocabulary, np.int64)
        full[term] = most
        return np.bincount(self.owner, self.weights * full[self.terms], len(self.sizes)).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, named: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores; equal ones by ascending id, null last."""
    if len(score) > 4 * most:  # no other can be among them
        some = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
        return some[np.lexsort((ids[some], ~named[some], -score[some]))[:most]]
    return np.lexsort((ids, ~named, -score))[:most]


def visit(index: DataFrame, queries: Queries, vocabulary: int, low: np.ndarray, high: np.ndarray, last: np.ndarray, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): what each task finds best for each query, from a score of ``last``, in the shards whose bound is at least ``low`` and below ``high``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        least = last.copy()
        for frame in frames:
            for row in frame.itertuples(index=False):
                term, most, starts, docs, worth = (np.frombuffer(bytes(x), "<u4").astype(np.int64) for x in (row.terms, row.most, row.starts, row.docs, row.impacts))
                ids, named = np.frombuffer(bytes(row.ids), "<i8"), np.frombuffer(bytes(row.named), bool)
                bound = queries.bounds(term, most, vocabulary)
                for q in np.flatnonzero((bound >= np.maximum(low, least)) & (bound < high)).tolist():
                    s, e = queries.starts[q], queries.starts[q + 1]
                    at = np.minimum(np.searchsorted(term, queries.terms[s:e]), len(term) - 1)
                    there = term[at] == queries.terms[s:e]
                    at, w = at[there], queries.weights[s:e][there]
                    place = gather(starts[at], starts[at + 1])
                    score = np.bincount(docs[place], np.repeat(w, starts[at + 1] - starts[at]) * worth[place], len(ids)).astype(np.int64)
                    some = np.flatnonzero(score >= least[q])
                    if not len(some):
                        continue
                    own = (score[some], ids[some], named[some])
                    if q in kept:
                        own = tuple(np.concatenate(x) for x in zip(kept[q], own, strict=True))
                    pick = best(*own, top)
                    kept[q] = own = tuple(x[pick] for x in own)
                    if len(pick) == top:
                        least[q] = max(least[q], own[0][-1])
        for q, (score, ids, named) in kept.items():
            yield pd.DataFrame({"item": q, "doc_id": pd.array(ids, "Int64").copy(), "score": score}).assign(doc_id=lambda d, named=named: d["doc_id"].where(named))

    return index.mapInPandas(run, "item long, doc_id long, score long")


def _first(index: DataFrame, queries: Queries, vocabulary: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query, the bound of its ``first``-th best shard and one above its best."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(queries.sizes)
        top = np.zeros((first, n), np.int64)
        for frame in frames:
            own = [queries.bounds(np.frombuffer(bytes(t), "<u4").astype(np.int64), np.frombuffer(bytes(m), "<u4").astype(np.int64), vocabulary) for t, m in zip(frame["terms"], frame["most"], strict=True)]
            if own:
                top = np.sort(np.concatenate([top, own]), axis=0)[-first:]
        yield pd.DataFrame({"item": np.tile(np.arange(n), first), "bound": top.ravel()})

    by = Window.partitionBy("item").orderBy(F.desc("bound"))
    rows = index.select("terms", "most").mapInPandas(run, "item long, bound long").withColumn("k", F.row_number().over(by)).filter(F.col("k") <= first)
    low, high = np.zeros(len(queries.sizes), np.int64), np.zeros(len(queries.sizes), np.int64)
    for r in rows.groupBy("item").agg(F.min("bound").alias("low"), F.max("bound").alias("high")).collect():
        low[r.item], high[r.item] = r.low, r.high + 1
    return low, high


def _merged(found: DataFrame, top: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], top: int, sizes: dict[str, int]) -> DataFrame:
    names = sorted({t for _, own in items for t in own})
    vocabulary = {t: k for k, t in enumerate(names)}
    found = written(postings(docs, vocabulary), "postings")
    documents, length, df = statistics(found, len(names))
    queries = Queries([np.array([vocabulary[t] for t in own], np.int64) for _, own in items], np.array([weight(documents, int(x)) for x in df], np.int64))
    index = clustered_index(found, len(names), documents, max(1, length), **sizes)
    discard(found)
    low, high = _first(index, queries, len(names), FIRST)
    kept, last = None, np.ones(len(items), np.int64)  # the score that a further hit has to reach
    for band in range(BANDS + 1):
        seen = visit(index, queries, len(names), low, high, last, top)
        whole = written(_merged(seen if kept is None else kept.drop("rank").unionByName(seen), top), "ranked")
        if kept is not None:
            discard(kept)
        kept, high = whole, low
        for r in kept.filter(F.col("rank") == top).collect():
            last[r.item] = r.score
        if (high <= last).all():  # no shard that is left reaches it
            break
        low = last if band == BANDS - 1 else np.minimum(high, last + (high - last) // 2)
    discard(index)
    item_ids = [None if i is None else int(i) for i, _ in items]

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = pd.array([item_ids[k] for k in frame["item"]], "Int64")
            yield pd.DataFrame({"item_id": ids, "rank": frame["rank"], "doc_id": frame["doc_id"].astype("Int64"), "score": frame["score"]})

    return kept.mapInPandas(named, "item_id long, rank int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, **sizes: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` highest-scoring documents of each item; ``sizes`` go to ``clustered_index``.

    Items (item_id, text) are the stated queries, taken in blocks; each is its own query, so repeated ones are
    answered as often. Null texts, and texts without terms, find nothing and are not found; a document without
    a term counts for nothing. Repeated rows of ``docs`` are documents of their own, null ids come last among
    equal scores; an empty table of either kind gives no rows; other columns are ignored.
    """
    blocks, held, count = [], [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        own = sorted(set(terms(r[1])))
        if not own:
            continue
        if held and (len(held) == ITEMS_AT_ONCE or count + len(own) > TERMS_AT_ONCE):
            blocks.append(_search_block(docs, held, top, sizes))
            held, count = [], 0
        held.append((r[0], own))
        count += len(own)
    if held:
        blocks.append(_search_block(docs, held, top, sizes))
    return reduce(DataFrame.unionByName, blocks) if blocks else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def oracle_sql(documents: str = "documents", items: str = "benchmark", top: int = TOP) -> str:
    """The same rows by DuckDB, without an index."""
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH words AS (SELECT row_number() OVER () AS row_id, doc_id, {words("text")} AS w FROM {documents} WHERE text IS NOT NULL),
held AS (SELECT row_id, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM held),
asked AS (SELECT row_number() OVER () AS item_row, item_id, list_distinct({words("text")}) AS w FROM {items} WHERE text IS NOT NULL),
query AS (SELECT item_row, item_id, unnest(w) AS term FROM asked),
tf AS (SELECT row_id, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_id, doc_id, n, unnest(w) AS term FROM held) WHERE term IN (SELECT term FROM query) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, docs),
worth AS (SELECT row_id, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)) AS x FROM tf, totals),
scores AS (SELECT item_row, item_id, row_id, doc_id, sum(w * x)::BIGINT AS score FROM query JOIN worth USING (term) JOIN weights USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {top}"""
