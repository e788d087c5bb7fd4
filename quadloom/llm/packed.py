"""Sorted 64-bit keys packed into binary blocks, one block per task and hash bucket.

A block is one row of a shuffle, so tens of thousands of keys cost one row.  Buckets are equal
ranges of the key space; keys are hashes, so buckets are even.
"""

from __future__ import annotations

import numpy as np
import xxhash

FLUSH = 1_000_000  # keys gathered by a task before its blocks are written
DROP = np.uint64(24)  # keys keep 40 bits where only a candidate or a frequency hangs on them


def pack(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte plane by byte plane: the high planes are zeros, which
    the shuffle compresses away."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").ravel(), dtype=np.uint64)


def splits(sorted_keys: np.ndarray, n: int, bits: int = 40) -> np.ndarray:
    """Positions at which sorted keys of ``bits`` bits are cut into ``n`` equal ranges."""
    edges = np.array([(k << bits) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def signature(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted set of tokens and its size."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).astype(np.int64))


def gather(batches, columns: list[str]) -> dict[int, list[tuple]]:
    """Rows of one task by bucket."""
    out: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *rest in zip(batch.column("bucket").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
            out.setdefault(bucket, []).append(tuple(rest))
    return out
