"""Algebra of half-open row ranges, for single ranges and for columns of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.sources.parquet import FILE, ROW


def _checked(begin: int, end: int) -> None:
    if begin >= end:
        raise ValueError(f"empty or inverted bounds [{begin}, {end})")


@dataclass(frozen=True, order=True)
class RowRange:
    """Rows ``begin`` to ``end - 1``, counted from some offset."""

    begin: int
    end: int

    def length(self) -> int:
        return self.end - self.begin

    def covered(self, offset: int, begin: int, end: int) -> RowRange | None:
        """The part of this range inside the absolute bounds [begin, end), counted from ``offset``."""
        _checked(begin, end)
        lo, hi = max(self.begin, begin - offset), min(self.end, end - offset)
        return RowRange(lo, hi) if lo < hi else None

    def left_of(self, offset: int, begin: int, end: int) -> RowRange | None:
        """The part before the bounds; all of a range that ends before them."""
        _checked(begin, end)
        hi = min(self.end, begin - offset)
        return RowRange(self.begin, hi) if self.begin < hi else None

    def right_of(self, offset: int, begin: int, end: int) -> RowRange | None:
        """The part after the bounds; all of a range that begins after them."""
        _checked(begin, end)
        lo = max(self.begin, end - offset)
        return RowRange(lo, self.end) if lo < self.end else None


@dataclass
class RowRangeSet:
    """Sorted disjoint ranges, counted from ``offset``: the rows that a read selects."""

    offset: int = 0
    ranges: list[RowRange] = field(default_factory=list)

    def add(self, r: RowRange) -> None:
        if self.ranges and r.begin < self.ranges[-1].end:
            raise ValueError("ranges must be added in order")
        self.ranges.append(r)

    def __iter__(self) -> Iterator[int]:
        """The absolute row numbers."""
        return (self.offset + i for r in self.ranges for i in range(r.begin, r.end))

    @classmethod
    def of_matches(cls, matches: Iterable[bool], offset: int = 0) -> RowRangeSet:
        """Maximal runs of true."""
        out, start, at = cls(offset), None, -1
        for at, hit in enumerate(matches):
            if hit and start is None:
                start = at
            elif not hit and start is not None:
                out.add(RowRange(start, at))
                start = None
        if start is not None:
            out.add(RowRange(start, at + 1))
        return out


#: Rows of a file in which runs are found at once.
CHUNK = 1 << 20


def islands(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file, begin, end) of the maximal runs of row numbers in positioned rows.

    Rows are dealt out by file and chunk, so that a large file is many tasks.
    Runs that reach a chunk's border, two a chunk at most, are then joined with
    their neighbours, file by file.
    """
    place = F.floor(F.col(ROW) / chunk)
    along = Window.partitionBy(FILE, "_chunk").orderBy(ROW)
    numbered = df.select(FILE, ROW, place.alias("_chunk")).withColumn("_run", F.col(ROW) - F.row_number().over(along))
    runs = numbered.groupBy(FILE, "_chunk", "_run").agg(F.min(ROW).alias("begin"), (F.max(ROW) + 1).alias("end")).select(FILE, "begin", "end")
    at_border = (F.col("begin") % chunk == 0) | (F.col("end") % chunk == 0)
    in_order = Window.partitionBy(FILE).orderBy("begin")
    fresh = F.when(F.lag("end").over(in_order) == F.col("begin"), 0).otherwise(1)
    marked = runs.filter(at_border).withColumn("_fresh", fresh).withColumn("_group", F.sum("_fresh").over(in_order))
    joined = marked.groupBy(FILE, "_group").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_group")
    return runs.filter(~at_border).unionByName(joined)


def _or_null(begin: Column, end: Column) -> Column:
    return F.when(begin < end, F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end")))


def covered(begin: Column, end: Column, low: Column, high: Column) -> Column:
    """Intersection of [begin, end) and [low, high) as a struct, null where empty."""
    return _or_null(F.greatest(begin, low), F.least(end, high))


def left_of(begin: Column, end: Column, low: Column) -> Column:
    return _or_null(begin, F.least(end, low))


def right_of(begin: Column, end: Column, high: Column) -> Column:
    return _or_null(F.greatest(begin, high), end)


def transfer(values: DataFrame, rows: DataFrame) -> DataFrame:
    """Positioned ``values`` at just the positions of ``rows``."""
    return values.join(rows.select(FILE, ROW), [FILE, ROW], "left_semi")


def lookup(df: DataFrame, column: str, row: int, default: Column) -> DataFrame:
    """(validity, value) of one row of each file, null as (false, default); no row where it isn't selected."""
    c = F.col(f"`{column}`")
    return df.filter(F.col(ROW) == row).select(c.isNotNull().alias("validity"), F.coalesce(c, default).alias("value"))


def rows_in(ranges: Iterable[RowRange]) -> Column:
    """Predicate on the row number for a short list of ranges."""
    parts = [(F.col(ROW) >= r.begin) & (F.col(ROW) < r.end) for r in ranges]
    return ~reduce(and_, (~p for p in parts)) if parts else F.lit(False)
