"""Results as Arrow: whole tables, typed columns, and batches of physical rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.errors import BackwardRead, BridgeTypeError
from lamella.operators.position import row_range
from lamella.sources.parquet import FILE, ROW


class TypedColumn:
    """One result column of a known Arrow type: values, validity and conversion."""

    def __init__(self, name: str, values: pa.ChunkedArray | pa.Array, may_have_null: bool | None = None) -> None:
        self.name = name
        self.values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        self.may_have_null = self.values.null_count > 0 if may_have_null is None else may_have_null

    def __len__(self) -> int:
        return len(self.values)

    def is_empty(self) -> bool:
        return not len(self.values)

    def value_at(self, i: int, default: object = None) -> tuple[bool, object]:
        """(validity, value); a null is (False, default)."""
        if not 0 <= i < len(self.values):
            raise IndexError(f"no row {i} in {len(self.values)}")
        v = self.values[i].as_py()
        return (False, default) if v is None else (True, v)

    def arrow(self, kind: pa.DataType) -> pa.Array:
        """The values, which must be of this type."""
        if self.values.type != kind:
            raise BridgeTypeError(f"column {self.name} is {self.values.type}, not {kind}")
        return self.values

    def append(self, values: Iterable) -> TypedColumn:
        """This column with more values; nulls only where the column may have them."""
        more = pa.array(values, self.values.type)
        if more.null_count and not self.may_have_null:
            raise BridgeTypeError(f"column {self.name} is not nullable")
        return TypedColumn(self.name, pa.concat_arrays([self.values, more]), self.may_have_null)

    def as_nullable(self) -> TypedColumn:
        if self.may_have_null:
            raise BridgeTypeError(f"column {self.name} is nullable already")
        return TypedColumn(self.name, self.values, True)

    def at_rows(self, rows: Iterable[int]) -> TypedColumn:
        """The values at these places."""
        return TypedColumn(self.name, pc.take(self.values, pa.array(rows, pa.int64())), self.may_have_null)

    def __str__(self) -> str:
        shown = ", ".join(map(str, self.values[:10].to_pylist()))
        return f"{self.name}: {self.values.type} [{shown}{', ...' if len(self) > 10 else ''}]"


def columns_of(df: DataFrame) -> dict[str, TypedColumn]:
    """A bounded result as typed columns; it is collected whole."""
    table = df.toArrow()
    return {name: TypedColumn(name, table.column(name)) for name in table.column_names}


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to Arrow batches on the executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fn, batches)

    return df.mapInArrow(run, schema)


class BatchReader:
    """Forward reads of one file in batches of physical rows, as Arrow tables in row order.

    ``df`` is a positioned, possibly filtered scan of one file with
    ``total_rows`` physical rows. A batch holds the rows that pass of the next
    ``size`` physical ones, so it may be smaller or empty. ``read`` is a job of
    its own over a range of rows; ``batches`` reads all that is left in one
    ordered pass, of which the driver holds a partition and a batch.
    """

    def __init__(self, df: DataFrame, total_rows: int) -> None:
        self.df, self.total, self.at = df, total_rows, 0

    @property
    def finished(self) -> bool:
        return self.at >= self.total

    def skip(self, rows: int) -> bool:
        """Move on; true where no row is left."""
        if rows < 0:
            raise BackwardRead("rows to skip must not be negative")
        self.at = min(self.total, self.at + rows)
        return self.finished

    def remaining(self) -> int:
        return self.total - self.at

    def read(self, size: int) -> pa.Table:
        if size <= 0:
            raise ValueError("batch size must be positive")
        end = min(self.total, self.at + size)
        part = row_range(self.df, self.at, end).orderBy(ROW).drop(FILE, ROW)
        self.at = end
        return part.toArrow()

    def __iter__(self) -> Iterator[pa.Table]:
        raise TypeError("use batches(size)")

    def batches(self, size: int) -> Iterator[pa.Table]:
        if size <= 0:
            raise ValueError("batch size must be positive")
        left = row_range(self.df, self.at, self.total).orderBy(ROW)
        schema = to_arrow_schema(self.df.drop(FILE, ROW).schema)
        rows = left.toLocalIterator(prefetchPartitions=True)
        row = next(rows, None)
        while not self.finished:
            self.at = min(self.total, self.at + size)
            held = []
            while row is not None and row[ROW] < self.at:
                held.append({name: row[name] for name in schema.names})
                row = next(rows, None)
            yield pa.Table.from_pylist(held, schema)
