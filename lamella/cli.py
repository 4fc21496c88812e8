"""Command line: full scans and point queries of Parquet files, timed.

python -m lamella.cli -f "a.parquet;b.parquet" -c "x;y" -l 4096
python -m lamella.cli -p -s 1000 -l 10 -f a.parquet -c "x;y"
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from lamella.operators.position import row_range
from lamella.sources.parquet import FILE, ROW, scan


def parse_list(text: str, mark: str = ";") -> list[str]:
    """Parts of a list argument without the empty ones."""
    return [x for x in text.split(mark) if x]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-f", "--files", required=True, help="paths, parted by ;")
    p.add_argument("-c", "--columns", default="", help="column names, parted by ;; all where missing")
    p.add_argument("-l", "--length", type=int, default=4096, help="rows of a point query; of a full scan, rows of an Arrow batch")
    p.add_argument("-p", "--point", action="store_true", help="point query: skip rows, then read some, in each file")
    p.add_argument("-s", "--skip", type=int, default=0, help="rows to skip")
    a = p.parse_args(args)
    if a.length <= 0:
        p.error("length must be positive")
    spark = spark or SparkSession.builder.getOrCreate()
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", min(a.length, 65536))
    start = time.perf_counter()
    for path in parse_list(a.files):
        began = time.perf_counter()
        df = scan(spark, path, parse_list(a.columns) or None, position=a.point)
        if a.point:
            row_range(df, a.skip, a.skip + a.length).orderBy(ROW).drop(FILE, ROW).show(a.length, truncate=False)
        else:
            df.write.format("noop").mode("overwrite").save()
        print(f"{path}: Time: {(time.perf_counter() - began) * 1000:.0f} ms")
    print(f"Total: Time: {(time.perf_counter() - start) * 1000:.0f} ms")


if __name__ == "__main__":
    main()
