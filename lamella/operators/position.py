"""Rows by physical position: skipping, point queries and fixed-size batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.sources import metadata
from lamella.sources.parquet import FILE, ROW, input_files


def skip(df: DataFrame, rows: int) -> DataFrame:
    """Positioned rows after the first ``rows`` of each file; skipping past the end leaves none."""
    if rows < 0:
        raise ValueError("rows to skip must not be negative")
    return df.filter(F.col(ROW) >= rows)


def point_query(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Per file: skip ``rows`` physical rows, then the first ``limit`` rows of what ``df`` has left.

    ``df`` is positioned and may be filtered. Without a filter this is the
    range of rows from ``rows`` to ``rows + limit - 1``; use ``row_range``,
    which needs no window.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    first = Window.partitionBy(FILE).orderBy(ROW)
    return skip(df, rows).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit).drop("_n")


def row_range(df: DataFrame, begin: int, end: int) -> DataFrame:
    """Positioned rows in [begin, end) of each file."""
    return df.filter((F.col(ROW) >= begin) & (F.col(ROW) < end))


def remaining(df: DataFrame, position: int) -> DataFrame:
    """(file, remaining): rows of each file at or after ``position``."""
    return df.groupBy(FILE).agg(F.sum((F.col(ROW) >= position).cast("long")).alias("remaining"))


def batch_number(size: int, start: Column | int = 0) -> Column:
    """Number of a row's batch of ``size`` physical rows, counted from ``start``."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return F.floor((F.col(ROW) - start) / size)


def with_batches(df: DataFrame, size: int) -> DataFrame:
    """Positioned rows with the number of their batch; for files of one row group."""
    return df.withColumn("_batch", batch_number(size))


def with_row_group_batches(spark: SparkSession, df: DataFrame, size: int, joined_groups: bool = False) -> DataFrame:
    """As ``with_batches``, but batches begin anew in every row group: adds ``_row_group`` and ``_batch``.

    Footers name the row groups' first rows; a file's list of them is joined
    to its rows. With ``joined_groups``, a file's row groups count as one, so
    that the numbers don't depend on how its writer cut it.
    """
    starts = [(f, [g.first_row for g in metadata.footer(spark, f).row_groups]) for f in input_files(df)]
    if joined_groups:
        starts = [(f, first[:1]) for f, first in starts]
    table = spark.createDataFrame(starts, f"`{FILE}` string, starts array<long>")
    group = F.size(F.filter("starts", lambda s: s <= F.col(ROW))) - 1
    joined = df.join(F.broadcast(table), FILE).withColumn("_row_group", group)
    return joined.withColumn("_batch", batch_number(size, F.get("starts", F.col("_row_group")))).drop("starts")
