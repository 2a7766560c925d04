"""Dates, buckets, labels and cluster codes as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STANCES


def known_stance(c: Column) -> Column:
    """Null for anything but the three stances."""
    return F.when(c.isin(*STANCES), c)


def count_bucket(c: Column) -> Column:
    """Label of a count: null counts as 1, and 0 falls into the last bucket."""
    n = F.coalesce(c, F.lit(1))
    return F.when(n == 1, "1").when(n.between(2, 10), "2-10").when(n.between(11, 50), "11-50").otherwise("50+")


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def is_iso_date(c: Column) -> Column:
    """Has a T, ends with Z and parses."""
    body = F.regexp_replace(c, "Z$", "")
    parsed = F.coalesce(F.try_to_timestamp(body, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(body, F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp(body, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")))
    return F.coalesce(F.contains(c, F.lit("T")) & c.endswith("Z") & parsed.isNotNull(), F.lit(False))


def parse_date(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm'Z'"))).cast("timestamp_ntz")


def day(c: Column) -> Column:
    return F.date_format(F.date_trunc("day", c), "yyyy-MM-dd")


def usable_text(c: Column, least: int = 100) -> Column:
    """An extraction worth keeping: long enough, no bracketed message and no error."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)^\\s+|\\s+$", "")
    return (F.length(t) > least) & ~t.startswith("[") & ~F.upper(t).startswith("ERROR")


def cluster_parent(c: Column) -> Column:
    return F.regexp_extract(c, "^([0-9]+)", 1).try_cast("int")


def cluster_suffix(c: Column) -> Column:
    return F.regexp_replace(c, "^[0-9]+", "")


def natural_order(c: Column) -> list[Column]:
    """Numeric parent, then suffix length, then suffix."""
    suffix = cluster_suffix(c)
    return [cluster_parent(c).asc_nulls_last(), F.length(suffix), suffix]


def child_code(parent: Column, index: Column) -> Column:
    return F.concat(parent, F.char(F.lit(97) + index))


def colour_index(parent_rank: Column, suffix: Column) -> Column:
    """Twenty colours for each parent; suffix letters as base-26 digits, at most 15."""
    digits = F.filter(F.split(suffix, ""), lambda x: x != "")
    return parent_rank * 20 + F.least(F.lit(15), F.aggregate(digits, F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 97))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)
