"""Shared pieces: scratch tables in the cluster's folder, Arrow helpers, word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps A-Z to a-z in UTF-8 bytes and leaves all else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Most rows and bytes of one Arrow batch, so that very long texts don't pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def filter_scans(spark: SparkSession) -> None:
    """Let the optimizer put a Bloom filter of a small side's keys before the shuffle of a large scan of any size."""
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", True)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1m")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "64m")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables that are written meanwhile drop their shuffle files at once, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one in the warehouse, or a temporary one if Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = got.get() if got.isDefined() else None
    if not named:
        if spark.sparkContext.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="lamella-")
            atexit.register(shutil.rmtree, named, True)
        else:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lamella-scratch-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders that this process has named in the scratch folder.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    _MADE.append(f"{scratch_root(spark)}/lamella-{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def scratch_made() -> int:
    """How many scratch folders this process has named; to be given to ``drop_scratch`` later."""
    return len(_MADE)


def drop_scratch(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Delete this process's scratch tables and archives named after the first ``since``, but for ``keep``, once no result that reads them is needed any more."""
    made = [path for path in _MADE[since:] if path != keep]
    _MADE[since:] = [path for path in _MADE[since:] if path == keep]
    gone = 0
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def materialise(df: DataFrame, label: str = "table", group_rows: int | None = None) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: cuts lineage, survives lost executors.

    Tables of rows of megabytes are given ``group_rows``, the rows of a row group: Parquet's writer else looks at a group's
    size only after 100 rows, and Spark's reader takes up to 4096 rows of a group at once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if group_rows is not None:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; used to choose numbers of partitions only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int, least: int = 1, most: int = 1 << 20) -> int:
    return max(least, min(most, -(-plan_bytes(df) // bytes_each)))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, case kept. ``bytes.split`` parts at just the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))
