"""Pages of an ordered table, however deep: rows are dealt into ranges of the order once, and a page reads only the ranges that it lies in."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, new_path
from .filters import QueryOptions, apply_filters, order_columns, total_pages

ROW_BITS = 33  #: of monotonically_increasing_id, that number the rows of a partition


class Pages:
    """Pages of ``rows`` in the order ``by``, which should end with a unique column.

    The rows are sorted by ranges and written once, a folder for each range; their sizes, a number for each range,
    tell where a page lies. Pages are read in any order, the last as fast as the first. ``close`` deletes the
    table.
    """

    def __init__(self, rows: DataFrame, by: list[Column]):
        ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.struct(*(f"`{c}`" for c in rows.columns)).alias("row"), F.monotonically_increasing_id().alias("at"))
        placed = ordered.select("row", F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("place"), F.shiftright("at", ROW_BITS).alias("range"))
        path = new_path(rows.sparkSession, "pages")
        placed.write.partitionBy("range").option("compression", "zstd").parquet(path)
        self._table = rows.sparkSession.read.schema(placed.schema).parquet(path)
        sizes = sorted((r.range, r.n) for r in self._table.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
        self._ranges, self._ends = [r for r, _ in sizes], list(accumulate(n for _, n in sizes))
        self.total = self._ends[-1] if sizes else 0

    def count(self, size: int) -> int:
        return total_pages(self.total, size)

    def ranges(self, number: int, size: int) -> list[int]:
        """The ranges that hold the page's rows."""
        low, high = (number - 1) * size, min(number * size, self.total)
        return self._ranges[bisect_right(self._ends, low) : bisect_right(self._ends, high - 1) + 1] if low < high else []

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number``, from 1, in order; one beyond the last is empty."""
        held = self.ranges(number, size)
        starts = dict(zip(self._ranges, [0, *self._ends], strict=False))
        before = F.coalesce(*(F.when(F.col("range") == r, starts[r]) for r in held), F.lit(0))
        at = before + F.col("place")
        rows = self._table.filter(F.col("range").isin(*held)).filter((at >= (number - 1) * size) & (at < number * size))
        return rows.orderBy("range", "place").select("row.*")

    def close(self) -> None:
        discard(self._table)


def pages(df: DataFrame, options: QueryOptions, default: str = "created_at", tie: str = "id") -> Pages:
    """The pages of what ``options`` filter and sort."""
    return Pages(apply_filters(df, options), order_columns(df, options, default, tie))
