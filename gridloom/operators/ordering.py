"""Order statistics over a whole table without moving it into one task.

A window without partitioning sorts everything in a single task.  Here rows are dealt out by
range, numbered within their range, and staged; what one range has to know of those before it
is a row a range, which a small window over the ranges gives.  Few rows are one range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.staging import stage

RANGE, PLACE = "__range", "__place"
#: Rows up to which one range, and so one task, holds them all.
SMALL = 1_000_000


def _within() -> WindowSpec:
    return Window.partitionBy(RANGE).orderBy(PLACE)


def _upto() -> WindowSpec:
    return _within().rowsBetween(Window.unboundedPreceding, 0)


def _earlier() -> WindowSpec:
    return Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Ordered:
    """Rows with the number of their range and their place in it."""

    ranked: DataFrame
    single: bool  # one range only

    def rows(self) -> DataFrame:
        return self.ranked.drop(RANGE, PLACE)

    def with_column(self, name: str, value: Column) -> Ordered:
        return Ordered(self.ranked.withColumn(name, value), self.single)

    def _carry(self, total: Column, over_ranges: Column, name: str, within: Column, joined) -> Ordered:
        """Add ``joined(before, within)``; ``before`` is ``over_ranges`` of the ranges' ``total``."""
        if self.single:
            return self.with_column(name, within)
        totals = self.ranked.groupBy(RANGE).agg(total.alias("__total")).withColumn("__before", over_ranges).drop("__total")
        met = self.ranked.join(F.broadcast(totals), RANGE)  # a row a range
        return Ordered(met.withColumn(name, joined(F.col("__before"), within)).drop("__before"), False)

    def numbered(self, name: str) -> Ordered:
        """Numbers from 0."""
        return self._carry(F.count("*"), F.sum("__total").over(_earlier()), name, F.col(PLACE), lambda before, place: F.coalesce(before, F.lit(0)) + place)

    def previous(self, value: str, name: str) -> Ordered:
        """The value of the row before; null for the first."""
        first = F.col(PLACE) == 0
        return self._carry(F.max_by(value, PLACE), F.lag("__total").over(Window.orderBy(RANGE)), name, F.lag(value).over(_within()), lambda before, lag: F.when(first, before).otherwise(lag))

    def running_sum(self, value: str, name: str) -> Ordered:
        return self._carry(F.sum(value), F.sum("__total").over(_earlier()), name, F.sum(value).over(_upto()), lambda before, s: F.coalesce(before, F.lit(0)) + s)

    def running_max(self, value: str, name: str) -> Ordered:
        return self._carry(F.max(value), F.max("__total").over(_earlier()), name, F.max(value).over(_upto()), F.greatest)


def ordered(rows: DataFrame, *order: str | Column, ranges: int | None = None) -> Ordered:
    """Rows in order; ranges are drawn from a sample, so their rows are staged. Spark chooses how many, if not told."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    if ranges is None:
        rows = stage(rows, "unordered")
        if rows.count() <= SMALL:
            place = (F.row_number().over(Window.orderBy(*by)) - 1).cast("long")
            return Ordered(rows.select("*", F.lit(0).alias(RANGE), place.alias(PLACE)), True)
    dealt = (rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return Ordered(stage(dealt.select("*", F.spark_partition_id().alias(RANGE), place.alias(PLACE)), "ordered"), False)
