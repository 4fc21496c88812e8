"""Blocked Bloom filters of bounded size, filled by an aggregation and probed per Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import map_batches

#: 64-bit words of one filter block (512 bits, a cache line); a key sets one bit in each.
BLOCK_WORDS = 8


def _block_and_bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(second, 6 * i) % 64).cast("int")) for i in range(BLOCK_WORDS)]
    return F.pmod(first, F.lit(blocks)), words


def bloom_filter(keys: DataFrame, key: str, n: int, bits_per_key: int = 16, most_bytes: int = 32 << 20) -> np.ndarray:
    """Filter words as an array (blocks, 8), of ``most_bytes`` at most however many keys there are.

    Blocks are filled on the executors; only the words of non-empty blocks come
    to the driver. With more keys than the size allows for, more false
    positives pass, and no key is ever missed.
    """
    blocks = max(1, min(most_bytes // (8 * BLOCK_WORDS), -(-n * bits_per_key // (64 * BLOCK_WORDS))))
    block, words = _block_and_bits(F.col(key), blocks)
    rows = keys.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words)))
    filled = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS))).toArrow()
    out = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    if filled.num_rows:
        at = filled.column("block").to_numpy()
        for i in range(BLOCK_WORDS):
            out[at, i] = filled.column(f"w{i}").to_numpy().view(np.uint64)
    return out


def probe(df: DataFrame, key: str, table: np.ndarray, keep_all: bool = True) -> DataFrame:
    """``df`` plus ``maybe`` (false: surely not a key), or only its rows that may be keys."""
    held = df.sparkSession.sparkContext.broadcast(table)
    block, words = _block_and_bits(F.col(key), len(table))
    probed = df.withColumns({"_block": block} | {f"_w{i}": w for i, w in enumerate(words)})
    kept = df.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = held.value[batch.column("_block").to_numpy(zero_copy_only=False)]
        maybe = np.ones(batch.num_rows, bool)
        for i in range(BLOCK_WORDS):
            w = batch.column(f"_w{i}").to_numpy(zero_copy_only=False).view(np.uint64)
            maybe &= lines[:, i] & w == w
        if keep_all:
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(maybe)], [*kept, "maybe"])
        mask = pa.array(maybe)
        return pa.RecordBatch.from_arrays([pc.filter(batch.column(c), mask) for c in kept], kept)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(probed, run, f"{schema}, maybe boolean" if keep_all else schema)
