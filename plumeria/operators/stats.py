"""Grouped statistics, windows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_tags, word_count
from ..functions.values import day
from ..schemas import STANCES

# Words that say nothing about a cluster.
STOP_WORDS = frozenset("the and for are but not you all can this that with have will from they been said each which their time would there what about when".split())
# The same for the flat clustering's keywords.
FLAT_STOP_WORDS = frozenset(
    "the and for are but not you all can this that with have will from they been said each which their time would there what about when "
    "many some these make like into him has two more very after our just first get may way use her than call who now find long down "
    "day did come made part over such case most only could where much too still being going should well before must between under "
    "never same another while last might great since against right three next even both through during".split()
)
PERCENTILES = (25, 75, 90, 95, 99)


def stance_counts(stance: str | Column = "stance") -> list[Column]:
    c = F.col(stance) if isinstance(stance, str) else stance
    return [F.count_if(c == s).alias(n) for s, n in zip(STANCES, ("for_count", "against_count", "neutral_count"), strict=True)]


def stance_stats(df: DataFrame) -> DataFrame:
    """Total and one count for each stance, in one pass; null stances count in the total only."""
    return df.agg(F.count(F.lit(1)).alias("total"), *stance_counts())


def time_series(df: DataFrame, date: str) -> DataFrame:
    """Stance counts by day, zeros filled in; null dates are dropped and null stances are neutral (added to them)."""
    stance = F.coalesce(F.col("stance"), F.lit(STANCES[2]))
    return df.filter(F.col(date).isNotNull()).groupBy(day(F.col(date)).alias("day")).agg(*stance_counts(stance)).orderBy("day")


def cluster_sizes(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def bounds(df: DataFrame, x: str = "pca_x", y: str = "pca_y") -> DataFrame:
    return df.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def cluster_summary(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Counts, percentages, and the stance that outnumbers both others, else neutral; null stances are neutral."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *stance_counts(F.coalesce(F.col("stance"), F.lit(STANCES[2]))))
    f, a, n = (F.col(c) for c in ("for_count", "against_count", "neutral_count"))
    dominant = F.when((f > a) & (f > n), STANCES[0]).when((a > f) & (a > n), STANCES[1]).otherwise(STANCES[2])
    return counted.withColumns({"for_percent": f / F.col("total") * 100, "against_percent": a / F.col("total") * 100, "dominant": dominant})


def interesting_clusters(summary: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Most in favour, most against, largest, most balanced of those over 10 % both ways; ties go to the least key."""
    f, a = F.col("for_percent"), F.col("against_percent")
    pick = lambda df, by, kind: df.orderBy(by, key).limit(1).select(F.lit(kind).alias("kind"), F.col(key))
    out = pick(summary, f.desc(), "most_for").unionByName(pick(summary, a.desc(), "most_against")).unionByName(pick(summary, F.desc("total"), "largest"))
    return out.unionByName(pick(summary.filter((f > 10) & (a > 10)), F.abs(f - a).asc(), "most_balanced"))


def weighted_content(lookup: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Unique texts, comments, the stance with most comments (ties: the one seen first), its share."""
    by = lookup.groupBy(key, F.coalesce("stance", F.lit("Unknown")).alias("stance")).agg(F.sum("comment_count").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("lookup_id").alias("first"))
    best = F.max_by(F.struct("stance", "n"), F.struct("n", F.struct((-F.regexp_extract("first", "([0-9]+)", 1).cast("long")).alias("k"))))
    return by.groupBy(key).agg(F.sum("texts").alias("unique_texts"), F.sum("n").alias("total_comments"), best.alias("b")).select(key, "unique_texts", "total_comments", F.col("b.stance").alias("dominant"), (F.col("b.n") / F.col("total_comments")).alias("purity"))


def keywords(df: DataFrame, key: str, text: str, k: int = 10, stop: frozenset[str] = STOP_WORDS, first: str | None = None) -> DataFrame:
    """Most frequent words of three letters or more in each group; counted before they are ranked.

    Ties go by the word, or to the one that occurs first in the order of the column ``first``.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), F.lit(0))
    if first is None:
        found, seen, tie = df.select(key, F.explode(words).alias("word")), [], F.col("word")
    else:
        found, seen, tie = df.select(key, F.col(first).alias("_row"), F.posexplode(words).alias("_at", "word")), [F.min(F.struct("_row", "_at")).alias("_first")], F.col("_first")
    counted = found.filter(~F.col("word").isin(sorted(stop))).groupBy(key, "word").agg(F.count(F.lit(1)).alias("freq"), *seen)
    return top_n(counted, key, [F.desc("freq"), tie], k, "rank").drop("_first")


def disagreement(lookup: DataFrame, dominant: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Entries whose stance is not their cluster's, null ones among them: number, share, comments."""
    off = ~F.col("stance").eqNullSafe(F.col("dominant"))
    out = lookup.join(dominant.select(key, "dominant"), key).groupBy(key).agg(F.count_if(off).alias("minority"), F.count(F.lit(1)).alias("n"), F.sum(F.when(off, F.col("comment_count")).otherwise(0)).alias("minority_comments"))
    return out.select(key, "minority", (F.col("minority") / F.col("n")).alias("rate"), "minority_comments")


def length_stats(df: DataFrame, text: str) -> DataFrame:
    """min, max, mean, median, population deviation and percentiles of characters, words and estimated tokens."""
    t = F.coalesce(strip_tags(F.col(text)), F.lit(""))
    each = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("v")) for m, v in (("chars", F.length(t)), ("words", word_count(t)), ("tokens", F.length(t) / 4))))).alias("x")).select("x.*")
    ranks = [F.percentile("v", p / 100).alias(f"p{p}") for p in PERCENTILES]
    return each.groupBy("metric").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_pop("v").alias("std"), *ranks, F.count_if(F.col("v") == 0).alias("empty"))


def prefix_duplicates(df: DataFrame, text: str, sizes: tuple[int, ...] = (25, 50, 100)) -> DataFrame:
    """For each prefix length: different prefixes, those shared, the rows that share them, and their share in percent."""
    each = df.select(F.explode(F.array(*map(F.lit, sizes))).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    counted = each.groupBy("n", F.expr("substring(t, 1, n)").alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    shared = F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0))
    return counted.groupBy("n").agg(F.count(F.lit(1)).alias("unique_prefixes"), F.count_if(F.col("c") > 1).alias("duplicate_prefixes"), shared.alias("duplicate_rows"), (shared / F.sum("c") * 100).alias("rate"))


def prefix_examples(df: DataFrame, text: str, n: int, k: int = 5) -> DataFrame:
    """The most shared prefixes with their stances' counts."""
    counted = df.groupBy(F.substring(F.coalesce(F.col(text), F.lit("")), 1, n).alias("prefix")).agg(F.count(F.lit(1)).alias("c"), *stance_counts())
    return counted.filter("c > 1").orderBy(F.desc("c"), "prefix").limit(k)


def stance_duplicates(df: DataFrame, text: str, n: int) -> DataFrame:
    """By stance: rows, and of them those whose prefix is their own or shared."""
    prefix = F.substring(F.coalesce(F.col(text), F.lit("")), 1, n)
    rows = df.groupBy(prefix.alias("prefix"), F.coalesce("stance", F.lit("Unknown")).alias("stance")).agg(F.count(F.lit(1)).alias("c"))
    sizes = rows.groupBy("prefix").agg(F.sum("c").alias("all"))
    own = F.col("all") == 1
    return rows.join(sizes, "prefix").groupBy("stance").agg(F.sum("c").alias("total"), F.sum(F.when(own, F.col("c")).otherwise(0)).alias("unique_rows"), F.sum(F.when(own, 0).otherwise(F.col("c"))).alias("duplicate_rows"))


def top_n(df: DataFrame, key: str, by: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark drops the others before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col(name) <= n)


def sample_by_group(df: DataFrame, key: str, share: float, seed: int = 42, tie: str = "id") -> DataFrame:
    """max(1, floor(n * share)) rows of each group, in an order by hash, so the same ones each time."""
    order = Window.partitionBy(key).orderBy(F.xxhash64(tie, F.lit(seed)), tie)
    marked = df.withColumns({"_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    return marked.filter(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_k", "_n")


def share_of_total(counted: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each row's part of the sum; the sum is one number, taken first."""
    total = counted.agg(F.sum(value)).first()[0]
    return counted.withColumn(name, F.col(value) / F.lit(total))


def remap(df: DataFrame, outer: str, inner: str, name: str = "position") -> DataFrame:
    """Inner labels as 0..k-1 in each outer one."""
    pairs = df.select(outer, inner).distinct()
    return pairs.withColumn(name, F.row_number().over(Window.partitionBy(outer).orderBy(inner)) - 1)
