"""Shared helpers: words, binary columns, packed blocks, shared scratch tables."""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.session import Scratch, materialise, scratch_path  # noqa: F401

# The white space that separates words.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
NO_SPACE_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 4 << 20  # of text that a worker looks at together


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the white-space separated words of a text; empty for NULL or no words."""
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_CLASS + "+"))


def utf8(c: Column) -> Column:
    """The bytes of a text, empty for NULL."""
    return F.coalesce(c, F.lit("")).cast("binary")


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of columns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x) for x in (columns[n] for n in names)],
                names=names)

    return df.mapInArrow(run, schema)


def by_bytes(batches, size: int = SLICE_BYTES):
    """The rows of the batches in slices of about ``size`` bytes of text, whole texts each, so that
    what a worker holds does not grow with the rows of a batch."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // size)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end > start:
                yield batch.slice(start, end - start)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Vocabulary:
    """Words seen by one batch as small integers, with a 64-bit hash for each."""

    def __init__(self):
        self.ids = defaultdict(count().__next__)

    def encode(self, text: bytes) -> np.ndarray:
        found = text.lower().split()
        return np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found))

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, self.ids), np.uint64, len(self.ids))


def encoded(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Word hashes of every text (A-Z in lower case), computed once per distinct word."""
    vocabulary = Vocabulary()
    ids = [vocabulary.encode(t) for t in texts]
    hashes = vocabulary.hashes()
    return [hashes[i] for i in ids], hashes


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive words, in text order; a shorter text is one
    shingle, an empty one has none."""
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out + h[k:len(h) - width + 1 + k] + np.uint64(k + 1))
    return out


def shingled(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``shingles`` of many texts one after the other, and where each text ends; texts of fewer
    than ``width`` words have none."""
    found = [text.lower().split() for text in texts]
    sizes = np.array([len(words) for words in found], np.int64)
    # a hash costs less than the look-up of its word among those seen
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(found)), np.uint64, int(sizes.sum()))
    counts = np.maximum(sizes - width + 1, 0)
    ends = np.cumsum(counts)
    if not counts.any():
        return h[:0], ends
    # the last words of a text begin shingles that reach into the next one
    inner = np.arange(ends[-1]) + np.repeat(np.cumsum(sizes) - sizes - ends + counts, counts)
    step = 1 << 15  # what the processor keeps at hand
    return np.concatenate([shingles(h[k:k + step + width - 1], width) for k in range(0, len(h) - width + 1, step)])[inner], ends


def buckets_for(df: DataFrame) -> int:
    """Number of hash buckets: as many as input tasks or shuffle partitions, whichever is
    larger, so a bucket stays about as large as an input split."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    """One shuffle that brings the blocks of each bucket into one task."""
    return df.repartition(n, "bucket")
