"""Footers of Parquet files: schema tree with levels, row groups, column chunks.

Spark's public API has no row groups, so footers are read by the JVM's own
Parquet reader through Spark's Hadoop configuration: any store that Spark
reads works. Footers are read on the driver, one file at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lamella.errors import NotParquet


@dataclass(frozen=True)
class ColumnSchema:
    """A leaf column: its path, order in the file, physical and logical type, and most levels."""

    path: tuple[str, ...]
    index: int
    physical_type: str
    logical_type: str | None
    max_def: int
    max_rep: int


@dataclass(frozen=True)
class ColumnChunk:
    path: tuple[str, ...]
    physical_type: str
    codec: str
    encodings: tuple[str, ...]
    values: int
    compressed_size: int
    uncompressed_size: int
    first_data_page: int
    dictionary_page: int | None
    least: str | None
    greatest: str | None
    nulls: int | None
    #: Where the chunk's Bloom filter, column index and offset index begin in the file.
    bloom_filter: int | None
    column_index: int | None
    offset_index: int | None


@dataclass(frozen=True)
class RowGroup:
    ordinal: int
    first_row: int
    rows: int
    offset: int
    columns: tuple[ColumnChunk, ...]


@dataclass(frozen=True)
class Footer:
    created_by: str
    key_values: dict[str, str]
    columns: tuple[ColumnSchema, ...]
    row_groups: tuple[RowGroup, ...]

    @property
    def rows(self) -> int:
        return sum(g.rows for g in self.row_groups)


def _strings(java_list: object) -> tuple[str, ...]:
    return tuple(str(x) for x in java_list)


def _chunk(c: object) -> ColumnChunk:
    stats, column_index, offset_index, bloom_filter = c.getStatistics(), c.getColumnIndexReference(), c.getOffsetIndexReference(), c.getBloomFilterOffset()
    valued = stats is not None and stats.hasNonNullValue()
    return ColumnChunk(
        path=tuple(c.getPath().toArray()),
        physical_type=str(c.getPrimitiveType().getPrimitiveTypeName()),
        codec=str(c.getCodec()),
        encodings=tuple(sorted(_strings(c.getEncodings()))),
        values=c.getValueCount(),
        compressed_size=c.getTotalSize(),
        uncompressed_size=c.getTotalUncompressedSize(),
        first_data_page=c.getFirstDataPageOffset(),
        dictionary_page=c.getDictionaryPageOffset() or None,
        least=stats.minAsString() if valued else None,
        greatest=stats.maxAsString() if valued else None,
        nulls=stats.getNumNulls() if stats is not None and stats.isNumNullsSet() else None,
        bloom_filter=bloom_filter if bloom_filter >= 0 else None,
        column_index=None if column_index is None else column_index.getOffset(),
        offset_index=None if offset_index is None else offset_index.getOffset(),
    )


def _leaf(index: int, d: object) -> ColumnSchema:
    kind = d.getPrimitiveType()
    logical = kind.getLogicalTypeAnnotation()
    return ColumnSchema(tuple(d.getPath()), index, str(kind.getPrimitiveTypeName()), None if logical is None else str(logical), d.getMaxDefinitionLevel(), d.getMaxRepetitionLevel())


def footer(spark: SparkSession, path: str) -> Footer:
    """The footer of one file; ``NotParquet`` where it has none, FileNotFoundError where the file is missing."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        if not where.getFileSystem(conf).exists(where):
            raise FileNotFoundError(path)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    except Py4JJavaError as e:
        raise NotParquet(f"{path}: {e.java_exception.getMessage()}") from None
    try:
        meta = reader.getFooter()
        file = meta.getFileMetaData()
        columns = tuple(_leaf(i, d) for i, d in enumerate(file.getSchema().getColumns()))
        groups, first = [], 0
        for i, b in enumerate(meta.getBlocks()):
            groups.append(RowGroup(i, first, b.getRowCount(), b.getStartingPos(), tuple(_chunk(c) for c in b.getColumns())))
            first += b.getRowCount()
        return Footer(str(file.getCreatedBy()), {str(k): str(v) for k, v in file.getKeyValueMetaData().items()}, columns, tuple(groups))
    finally:
        reader.close()


def schema_tree(schema: StructType) -> dict[str, tuple[int, int]]:
    """Most definition and repetition levels of every leaf of a Spark schema, by dotted path.

    A nullable level adds a definition; an array or map level adds a
    definition and a repetition. Spark reads every column as nullable; the
    footer has the levels of required columns.
    """

    def walk(path: str, kind: DataType, nullable: bool, defs: int, reps: int) -> Iterator[tuple[str, tuple[int, int]]]:
        defs += nullable
        if isinstance(kind, StructType):
            for f in kind:
                yield from walk(f"{path}.{f.name}", f.dataType, f.nullable, defs, reps)
        elif isinstance(kind, ArrayType):
            yield from walk(f"{path}.element", kind.elementType, kind.containsNull, defs + 1, reps + 1)
        elif isinstance(kind, MapType):
            yield from walk(f"{path}.key", kind.keyType, False, defs + 1, reps + 1)
            yield from walk(f"{path}.value", kind.valueType, kind.valueContainsNull, defs + 1, reps + 1)
        else:
            yield path, (defs, reps)

    return dict(x for f in schema for x in walk(f.name, f.dataType, f.nullable, 0, 0))
