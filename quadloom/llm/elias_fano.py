"""Elias-Fano coded monotone sequences over memory-mapped files.

A sequence keeps the low bits of every value in byte planes and the high bits in unary, with the
number of zeros before each 64-bit word as a directory.  ``find`` looks up many values at once.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa

from .op4_warc import filesystem


def encode(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    """Arrays of a sorted sequence of values below ``universe``, named after ``name``."""
    n = len(values)
    planes = -(-max(0, (universe // max(n, 1)).bit_length() - 1) // 8)
    low = np.zeros((planes, n), np.uint8)
    for p in range(planes):
        low[p] = (values >> np.uint64(8 * p)) & np.uint64(255)
    high = (values >> np.uint64(8 * planes)).astype(np.int64) if planes < 8 else np.zeros(n, np.int64)
    size = n + (universe >> (8 * planes)) + 2
    bits = np.zeros(-(-size // 64) * 64, bool)
    bits[high + np.arange(n)] = True
    zeros = 64 - np.count_nonzero(bits.reshape(-1, 64), axis=1)
    before = np.concatenate([[0], np.cumsum(zeros)[:-1]]).astype(np.int64)
    return {f"{name}.low": low, f"{name}.bits": np.packbits(bits, bitorder="little").view("<u8"), f"{name}.zeros": before}


class Sequence:
    """Read side of ``encode``."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.bits, self.zeros = (arrays[f"{name}.{x}"] for x in ("low", "bits", "zeros"))
        self.n = self.low.shape[1]

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """Position of the zero with the given rank."""
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        left = rank - self.zeros[word]
        x = ~self.bits[word]
        at = np.zeros(len(rank), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & np.uint64((1 << step) - 1)).astype(np.int64)
            go = left >= count
            left -= count * go
            at += step * go
            x = np.where(go, x >> np.uint64(step), x)
        return word * 64 + at

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for p, plane in enumerate(self.low):
            out |= plane[at].astype(np.uint64) << np.uint64(8 * p)
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of every value in the sequence, -1 where it is absent."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        planes = len(self.low)
        high = (values >> np.uint64(8 * planes)).astype(np.int64) if planes < 8 else np.zeros(len(values), np.int64)
        end = self._zero(high) - high
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        # values with equal high bits are sorted by their low bits: a binary search for all at once
        want = values & np.uint64((1 << (8 * planes)) - 1)
        last = end.copy()
        todo = np.flatnonzero(start < end)
        while len(todo):
            mid = (start[todo] + end[todo]) >> 1
            less = self._low(mid) < want[todo]
            start[todo] = np.where(less, mid + 1, start[todo])
            end[todo] = np.where(less, end[todo], mid)
            todo = todo[start[todo] < end[todo]]
        there = np.flatnonzero(start < last)
        there = there[self._low(start[there]) == want[there]]
        out[there] = start[there]
        return out


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of aligned arrays; written aside and moved, so repeated tasks do no harm."""
    files, where = filesystem(path)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, a.shape, at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    draft = f"{where}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(len(text).to_bytes(8, "little") + text + b"\0" * (-(8 + len(text)) % 64))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))
    files.move(draft, where)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped on a mounted path, read where it is an object store."""
    files, where = filesystem(path)
    if files.type_name == "local":
        whole = pa.memory_map(where).read_buffer()
    else:
        with files.open_input_file(where) as stream:
            whole = stream.read_buffer()
    size = int.from_bytes(whole[:8].to_pybytes(), "little")
    head = json.loads(whole[8:8 + size].to_pybytes())
    base = 8 + size + -(8 + size) % 64
    out = {}
    for name, (dtype, shape, at) in head.items():
        count = int(np.prod(shape))
        out[name] = np.frombuffer(whole, dtype, count, base + at).reshape(shape) if count else np.empty(shape, dtype)
    return out
