"""Scans of Parquet files: exact column names, one filter per column, rows by position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamella.errors import ColumnNotFound
from lamella.functions.predicates import RangeFilter

#: Names of the position columns that ``with_position`` adds.
FILE, ROW = "_file", "_row"


def check_names(schema: StructType, names: Sequence[str]) -> None:
    """Names are matched exactly, whatever ``spark.sql.caseSensitive`` says."""
    have = schema.fieldNames()
    for name in names:
        if name not in have:
            raise ColumnNotFound(name, have)


def predicate(schema: StructType, filters: Mapping[str, RangeFilter]) -> Column | None:
    """All filters as one conjunction, in the order given; put the most selective first."""
    check_names(schema, list(filters))
    parts = [f.column(F.col(f"`{name}`"), schema[name].dataType) for name, f in filters.items()]
    return reduce(and_, parts) if parts else None


def read(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def input_files(df: DataFrame) -> list[str]:
    """The files of a scan, named as ``with_position`` names them."""
    return [f"file:/{f.removeprefix('file:///')}" if f.startswith("file:///") else f for f in df.inputFiles()]


def scan(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Mapping[str, RangeFilter | None] | Sequence[str] | None = None,
    filters: Mapping[str, RangeFilter] | None = None,
    position: bool = False,
) -> DataFrame:
    """Selected columns of the rows that pass every filter, in the order asked for.

    ``columns`` is a list of names or a map from name to filter or None;
    ``filters`` may add filters on columns that are not selected. Selection
    and predicate are part of the scan: only these columns are read, and
    comparisons are pushed down. With ``position``, the file's path and the
    row's place in it come along (see ``with_position``).
    """
    df = read(spark, paths)
    named = dict(columns) if isinstance(columns, Mapping) else dict.fromkeys(df.columns if columns is None else columns)
    check_names(df.schema, list(named))
    wanted = {c: f for c, f in named.items() if f is not None} | dict(filters or {})
    where = predicate(df.schema, wanted)
    if position:
        df = with_position(df)
    if where is not None:
        df = df.filter(where)
    return df.select(*(F.col(f"`{c}`") for c in named), *([FILE, ROW] if position else []))


def with_position(df: DataFrame) -> DataFrame:
    """``df``, a plain file scan, with each row's file and its row number in that file.

    Must be called on the scan itself: after a join or an aggregation the
    position is gone. Columns of the file with these names are replaced. Row numbers run on across row groups.
    """
    return df.withColumns({FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
