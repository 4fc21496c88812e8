"""Connected components by alternating large-star and small-star steps, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has ``a`` and ``b``; returns a row (node, root) for each node that is not its component's least.

    Each step moves every node's neighbours to the least node it sees, until
    all edges lead to a root. Minima are aggregated before they are shuffled,
    so a node with very many neighbours costs no more than as many nodes with
    few; the join back is split by adaptive execution. Tables between steps
    are written to the shared scratch folder. Only row counts and a checksum
    come to the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = materialise(pairs, "edges")
    seen = _checksum(pairs)
    while seen[0]:
        both = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: neighbours greater than u go to the least node that u sees. Doubles go with the next step's.
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours of a, and a itself, go to the least of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = large.join(lower, F.col("a") == F.col("u"))
        small = joined.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        pairs = materialise(small.filter("a <> b").distinct(), "edges")
        before, seen = seen, _checksum(pairs)
        if before == seen:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _checksum(pairs: DataFrame) -> tuple[int, int]:
    n, total = pairs.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0).cast("long"))).first()
    return n, total
