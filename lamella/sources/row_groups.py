"""Scans that read only the row groups they need.

Spark prunes row groups by the statistics of columns and not by position. Here
footers say which row groups hold the rows wanted; a task opens its file
through Arrow and reads just those, and of them just the columns asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lamella.sources import metadata
from lamella.sources.parquet import FILE, ROW, check_names, input_files, read

#: Rows of one Arrow batch.
BATCH_ROWS = 8192


def row_groups(spark: SparkSession, files: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """(file, ordinal, first row, rows) of every row group."""
    return [(f, g.ordinal, g.first_row, g.rows) for f in files for g in metadata.footer(spark, f).row_groups]


def scan_rows(spark: SparkSession, paths: str | Sequence[str], begin: int, end: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Positioned rows in [begin, end) of each file; row groups outside aren't read.

    Rows have the selected columns, the file's path and the row's place in it,
    as ``scan`` gives them with ``position``. Files must be in a store that
    Arrow opens too. An empty range gives no rows.
    """
    source = read(spark, paths)
    names = list(source.columns if columns is None else columns)
    check_names(source.schema, names)
    wanted = [(f, i, first) for f, i, first, rows in row_groups(spark, input_files(source)) if first < end and first + rows > begin]
    schema = StructType([*(source.schema[c] for c in names), StructField(FILE, StringType()), StructField(ROW, LongType())])
    if not wanted:
        return spark.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(place["file"])
                with store.open_input_file(path) as f:
                    at = place["first"]
                    for part in pq.ParquetFile(f).iter_batches(BATCH_ROWS, row_groups=[place["ordinal"]], columns=names):
                        lo, hi = max(begin - at, 0), min(end - at, part.num_rows)
                        if lo < hi:
                            kept = pa.Table.from_batches([part.slice(lo, hi - lo)]).select(names)
                            rows = pa.array(range(at + lo, at + hi), pa.int64())
                            table = pa.table([*kept.columns, pa.array([place["file"]] * (hi - lo)), rows], names=[*names, FILE, ROW])
                            yield from table.cast(arrow).to_batches()
                        at += part.num_rows

    places = spark.createDataFrame(wanted, "file string, ordinal int, first long").repartition(len(wanted), F.col("file"), F.col("ordinal"))
    return places.mapInArrow(run, schema)
