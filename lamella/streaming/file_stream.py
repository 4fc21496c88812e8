"""Bounded-memory reading of a growing folder: the scan's filters over micro-batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamella.functions.predicates import RangeFilter
from lamella.sources.parquet import check_names, predicate


def stream_scan(
    spark: SparkSession, folder: str, schema: StructType, columns: Sequence[str], filters: Mapping[str, RangeFilter] | None = None, files_per_batch: int = 1
) -> DataFrame:
    """A stream of the selected columns of rows that pass, ``files_per_batch`` files at a time.

    Stateless, so it needs no watermark; any sink and output mode append works.
    """
    check_names(schema, columns)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    where = predicate(schema, filters or {})
    return (rows if where is None else rows.filter(where)).select(*(F.col(f"`{c}`") for c in columns))
