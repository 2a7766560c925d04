"""URL filtering: listed rules, and association rules mined from labelled URLs by FP-growth.

A URL is a set of tokens, each marked by where it stands. FP-growth finds token combinations of the
labelled URLs that are frequent enough, and those that mean "block" with enough confidence become
rules; one that a part of it implies as well is dropped. The rules are matched by an inverted index:
each hangs on its rarest token, so a URL looks only at the rules of tokens that it has.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path beginning, verdict): the listed rules, which hold for the host and all its subdomains.
LISTED_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Words in a host that label its URLs "block", for want of labels by hand.
BLOCK_WORDS = frozenset("casino bets betting pills viagra pharma porn adult xxx spam ads adserver track tracker".split())
#: Different labelled URLs that rules are mined from, at most, and what a combination needs.
MAX_LABELLED, MIN_SUPPORT, MIN_CONFIDENCE = 40_000, 0.001, 0.9
BLOCK = "=block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=LISTED_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; null for none."""
    text = verdict = None
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return text, verdict


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL: scheme, host words, path words (numbers as #), query keys, fragment."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return []
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", rest, re.S)
    found = {f"s:{scheme.lower()}"}
    found |= {f"h:{w}" for w in re.split(r"[^0-9a-z]+", m[1].lower()) if w}
    found |= {f"p:{re.sub('[0-9]+', '#', w)}" for w in re.split(r"[^0-9a-z]+", m[2].lower()) if w}
    found |= {f"q:{w.partition('=')[0].lower()}" for w in (m[3] or "").split("&") if w}
    if m[4]:
        found.add(f"f:{m[4].lower()}")
    return sorted(found)


@dataclass(frozen=True)
class Rule:
    tokens: frozenset[str]
    confidence: float
    support: float


def weak_labels(urls: DataFrame) -> DataFrame:
    """(url, blocked): whether the host has a word of BLOCK_WORDS."""
    words = F.split(host_of(F.col("url")), "[^0-9a-z]+")
    return urls.select("url", F.arrays_overlap(words, F.array(*(F.lit(w) for w in sorted(BLOCK_WORDS)))).alias("blocked")).filter("url is not null")


def mine_rules(labelled: DataFrame, limit: int = MAX_LABELLED) -> list[Rule]:
    """Block rules of (url, blocked) rows, by FP-growth over at most ``limit`` different ones, drawn by hash.

    A repeated URL counts once, so copies fill no sample; labelled both ways, it counts as blocked. A token
    that too few blocked URLs have is in no rule, and one that is a rule alone makes all longer ones needless;
    combinations are mined of the others only, one for all tokens that the same URLs have, so a path that a
    site's URLs share doesn't multiply. All rules
    reach the driver, but for those that a part of them implies. No labelled row, or no blocked one, gives no
    rules.
    """
    each = labelled.select(F.col("url").cast("string"), F.col("blocked").cast("boolean")).dropna().groupBy("url").agg(F.bool_or("blocked").alias("blocked"))
    drawn = each.orderBy(F.xxhash64("url"), "url").limit(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"tokens": [tokens(u) for u in batch["url"]], "blocked": batch["blocked"]})

    rows = drawn.mapInPandas(run, "tokens array<string>, blocked boolean").persist()
    total = rows.count()
    if not total or not rows.filter("blocked").limit(1).count():
        rows.unpersist()
        return []
    least = math.ceil(MIN_SUPPORT * total)
    each = rows.select(F.explode(F.array_distinct("tokens")).alias("t"), "blocked", F.xxhash64("tokens").alias("h"))
    single = each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("b"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit((1 << 31) - 1))).alias("s"))
    frequent = single.filter(F.col("b") >= least).collect()  # each is in a share of MIN_SUPPORT of all rows
    best = sorted(((r.t,), r.b / r.n, r.b / total) for r in frequent if r.b / r.n >= MIN_CONFIDENCE)
    # tokens of the same URLs can stand for each other, so the least of them does
    open_tokens = sorted({(r.n, r.b, r.x, r.s): r.t for r in sorted(frequent, key=lambda r: r.t, reverse=True) if r.b / r.n < MIN_CONFIDENCE}.values())
    if open_tokens:
        tokens_left = F.filter("tokens", lambda t: t.isin(*open_tokens))
        items = F.when(F.col("blocked"), F.array_append(tokens_left, F.lit(BLOCK))).otherwise(tokens_left)
        model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(rows.select(items.alias("items")))
        mined = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK)))
        best += [(r.antecedent, r.confidence, r.support) for r in mined.orderBy(F.size("antecedent"), F.desc("confidence"), F.desc("support"), F.concat_ws(" ", F.array_sort("antecedent"))).collect()]
    rows.unpersist()
    kept: list[Rule] = []
    index: dict[str, list[Rule]] = defaultdict(list)
    for antecedent, confidence, support in best:  # a rule comes after all rules of fewer tokens
        rule = Rule(frozenset(antecedent), float(confidence), float(support))
        if not any(r.tokens <= rule.tokens and r.confidence >= rule.confidence for t in rule.tokens for r in index[t]):
            kept.append(rule)
            index[min(rule.tokens)].append(rule)
    return sorted(kept, key=lambda r: (-r.confidence, -r.support, sorted(r.tokens)))


class RuleIndex:
    """Rules by their rarest token: the one that fewest rules have."""

    def __init__(self, rules: list[Rule]):
        uses: dict[str, int] = defaultdict(int)
        for rule in rules:
            for t in rule.tokens:
                uses[t] += 1
        self._by_token: dict[str, list[Rule]] = defaultdict(list)
        for rule in rules:
            self._by_token[min(rule.tokens, key=lambda t: (uses[t], t))].append(rule)

    def blocked(self, url: str | None) -> bool:
        own = set(tokens(url))
        return any(rule.tokens <= own for t in own for rule in self._by_token.get(t, ()))


def judge_urls(pages: DataFrame, rules: list[Rule], listed=LISTED_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of each row of ``pages`` (page_id, url).

    The listed rule that fits decides, else whether a mined rule matches (mined). Null URLs and those
    without ``://`` have no host, path or tokens, and are allowed. Rows are judged one by one, so
    repeated rows get the same verdict; of listed rules of one length the first of the list wins; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = RuleIndex(rules)
        for urls in batches:
            yield urls.map(index.blocked).astype(bool)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("mined", F.pandas_udf(run, "boolean")("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
