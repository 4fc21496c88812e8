"""Sorted 64-bit keys packed into few binary rows, one for each shard of the key space.

A map task turns very many small facts (n-grams, signatures) into a row per
shard instead of a row per fact. Keys are stored as differences whose bytes
are transposed, which the shuffle's codec then shrinks. Keys are hashes, so
shards are even whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def pack_sorted(keys: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes | np.ndarray) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def shard_slices(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the non-empty shards of sorted keys; shard borders cut the key space evenly.

    The work is that of the keys, however many shards there are.
    """
    of = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    yield from zip(of[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True)
