"""The place of every row in a total order, and pages of it (O2).

A window over the whole table would sort it in one task.  Here the rows are
range-partitioned by the order, sorted inside each range and stored with their
range and their position in it; a row's place is the number of rows in earlier
ranges -- a table of one row a range -- plus its position.  A page is read from
the ranges it overlaps: their numbers, and the positions, are stored columns with
Parquet statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE, POSITION = "__range", "__position"
IN_PARTITION = (1 << 33) - 1  # of monotonically_increasing_id, the row's part


class Ranked:
    """Rows of ``df`` stored in the order ``order`` (sort expressions).  Rows that
    tie in all of them come in any order, and share a range."""

    def __init__(self, df: DataFrame, order: Sequence[Column], num_partitions: int | None = None):
        from ..sources.store import materialize

        self.columns = df.columns
        dealt = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
        number = F.monotonically_increasing_id()
        stored = dealt.sortWithinPartitions(*order).withColumns(
            {RANGE: F.spark_partition_id(), POSITION: number.bitwiseAND(F.lit(IN_PARTITION))}
        )
        self.rows = materialize(stored, "ranked")
        sizes = self.rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
        # one row a range
        before = F.sum("n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
        self.offsets = sizes.select(RANGE, "n", F.coalesce(before, F.lit(0)).alias("before"))

    def with_place(self, name: str = "place") -> DataFrame:
        """Every row with its place, from 1."""
        # as many rows as the exchange has partitions
        placed = self.rows.join(F.broadcast(self.offsets), RANGE)
        return placed.select(*self.columns, (F.col("before") + F.col(POSITION) + 1).alias(name))

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows, in order, with ``place``; a
        page beyond the last has no row."""
        first, last = (number - 1) * size, number * size
        # the ranges that the page overlaps: one, or as many as it has rows
        found = self.offsets.where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).collect()
        here = F.lit(False)
        place = F.lit(None).cast("long")
        for r in found:
            inside = F.col(RANGE) == r[RANGE]
            here = here | (inside & (F.col(POSITION) >= first - r["before"]) & (F.col(POSITION) < last - r["before"]))
            place = F.when(inside, F.col(POSITION) + (r["before"] + 1)).otherwise(place)
        return self.rows.where(here).select(*self.columns, place.alias("place")).orderBy("place")


def total_rank(df: DataFrame, order: Sequence[Column], name: str = "place", num_partitions: int | None = None) -> DataFrame:
    """``df`` with the place of every row in the order of the whole table."""
    return Ranked(df, order, num_partitions).with_place(name)
