"""Summaries that tell which batches a filter can match, and which distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.predicates import RangeFilter
from lamella.operators.position import batch_number
from lamella.sources.parquet import FILE


def zone_map(df: DataFrame, column: str, size: int, f: RangeFilter) -> DataFrame:
    """(file, batch, least, greatest, has_null, may_match) for batches of ``size`` physical rows.

    Only an aggregation with partial sums on the map side; NaN counts as
    greatest.
    """
    c, dtype = F.col(f"`{column}`"), df.schema[column].dataType
    zones = df.groupBy(FILE, batch_number(size).alias("batch")).agg(F.min(c).alias("least"), F.max(c).alias("greatest"), F.coalesce(F.bool_or(c.isNull()), F.lit(False)).alias("has_null"))
    return zones.withColumn("may_match", f.may_match_column(F.col("least"), F.col("greatest"), F.col("has_null"), dtype))


def dictionary_selectivity(df: DataFrame, column: str, f: RangeFilter) -> DataFrame:
    """(value, selected, rows): the filter's verdict once for each distinct value."""
    c = F.col(f"`{column}`")
    counted = df.groupBy(c.alias("value")).agg(F.count("*").alias("rows"))
    return counted.select("value", F.coalesce(f.column(F.col("value"), df.schema[column].dataType), F.lit(False)).alias("selected"), "rows")
