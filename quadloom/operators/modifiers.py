"""Ordering, limits, paging and duplicate removal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import LOOKUP_ROWS, scratch_path
from ..terms import order_key

# --- fixed values ---
PAGE_SIZE = 10_000
# --- end of fixed values ---

COPY_CHUNK = 65_536
SHALLOW_OFFSET = 1_000_000


class desc:
    """Marks a sort key as descending."""

    def __init__(self, name: str):
        self.name = name


def _is_term(df: DataFrame, name: str) -> bool:
    dtype = df.schema[name].dataType
    return isinstance(dtype, T.StructType) and dtype.names == ["kind", "value", "lang", "dt"]


def with_sort_keys(df: DataFrame, keys) -> tuple[DataFrame, list[Column]]:
    """``df`` with its sort keys as columns, so that each is computed once per row and not
    once per comparison."""
    made, order_by = {}, []
    for i, key in enumerate(keys):
        name = key.name if isinstance(key, desc) else key
        c = F.col(name)
        if _is_term(df, name):
            made[f"__key{i}"] = order_key(c)
            c = F.col(f"__key{i}")
        order_by.append(c.desc_nulls_last() if isinstance(key, desc) else c.asc_nulls_first())
    return df.withColumns(made) if made else df, order_by


def order(bindings: DataFrame, *keys) -> DataFrame:
    keyed, order_by = with_sort_keys(bindings, keys)
    return keyed.orderBy(*order_by).select(*bindings.columns)


def top_k(bindings: DataFrame, keys: list, k: int) -> DataFrame:
    """ORDER BY + LIMIT: each task keeps its best k rows, no full sort."""
    return order(bindings, *keys).limit(k)


def limit(bindings: DataFrame, k: int) -> DataFrame:
    return bindings.limit(k)


def cap(bindings: DataFrame, row_cap: int, user_limit: int | None = None) -> DataFrame:
    """The service's hard row cap: the smaller of the caller's limit and the cap."""
    return bindings.limit(row_cap if user_limit is None else min(user_limit, row_cap))


def distinct(bindings: DataFrame) -> DataFrame:
    return bindings.distinct()


def number_copies(df: DataFrame, count: str, out: str) -> DataFrame:
    """One row per copy, numbered from 0; exact for any count with bounded arrays.

    A large count is first cut into chunks which may be spread over tasks, then each
    chunk is unfolded.
    """
    n = F.col(count).cast("long")
    chunks = df.select("*", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((n - 1) / COPY_CHUNK))).alias("__chunk"))
    # the chunks are few and short before they are unfolded: a number that is given is not made smaller
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _unfold(chunks.repartition(tasks, *df.columns, "__chunk"), count, out)


def _unfold(chunks: DataFrame, count: str, out: str) -> DataFrame:
    first = F.col("__chunk") * COPY_CHUNK
    last = F.least(F.col(count).cast("long"), first + COPY_CHUNK) - 1
    return chunks.select("*", F.explode(F.sequence(first, last)).alias(out)).drop("__chunk")


def file_order(name: str) -> tuple[int, int]:
    """Task and file number of a written file: names are padded to five and three digits only."""
    task, part = re.match(r"part-(\d+)-.*?c(\d+)\.[^-]*$", name).groups()
    return int(task), int(part)


def row_index(df: DataFrame, keys: list, unique_rows: bool = False, out: str = "row_idx") -> DataFrame:
    """Exact 0-based position of every row in the order of ``keys``, without a global window.

    The sorted rows are written once to the shared folder.  Position inside a file is the
    reader's own row index; a file's offset is the sum of the counts of the files before it,
    a table with one row per file.  Equal keys are ordered by the remaining columns so that
    the range partitioning can split them, and identical rows (unless ``unique_rows``) are
    counted first and unfolded afterwards, so no task holds all copies.
    """
    spark = df.sparkSession
    columns = df.columns
    key_names = [k.name if isinstance(k, desc) else k for k in keys]
    rest = [c for c in columns if c not in key_names]
    if unique_rows:
        keyed, sort = with_sort_keys(df, list(keys) + rest)
        ordered = keyed.orderBy(*sort).select(*columns)
    else:
        counted = df.groupBy(*columns).agg(F.count("*").alias("__n"))
        chunks = counted.select("*", F.explode(F.sequence(
            F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPY_CHUNK))).alias("__chunk"))
        keyed, sort = with_sort_keys(chunks, list(keys) + rest)
        ordered = _unfold(keyed.orderBy(*sort, "__chunk"), "__n", "__copy").select(*columns)
    path = scratch_path(spark, "ordered")
    ordered.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = [(r["__file"], r["n"]) for r in
              stored.groupBy("__file").agg(F.count("*").alias("n")).toLocalIterator()]
    offsets, total = [], 0
    for name, n in sorted(counts, key=lambda x: file_order(x[0])):
        offsets.append((name, total))
        total += n
    table = spark.createDataFrame(offsets, "__file string, __offset long")
    if len(offsets) <= LOOKUP_ROWS:
        table = F.broadcast(table)
    return stored.join(table, "__file").select(
        *columns, (F.col("__offset") + F.col("__row")).alias(out))


def paginate(bindings: DataFrame, keys: list, page_size: int = PAGE_SIZE,
             unique_rows: bool = False) -> DataFrame:
    """Every row with its page number; pages hold exactly ``page_size`` rows."""
    if page_size <= 0:
        raise ValueError("page size must be greater than 0")
    indexed = row_index(bindings, keys, unique_rows, "__idx")
    return indexed.withColumn("page", F.floor(F.col("__idx") / page_size)).drop("__idx")


def slice_rows(bindings: DataFrame, keys: list, offset: int, count: int) -> DataFrame:
    """ORDER BY + OFFSET + LIMIT; a deep offset goes through the distributed row index.

    Equal keys are ordered by the remaining columns at every offset, so slices fit together.
    """
    if offset + count <= SHALLOW_OFFSET:
        named = [k.name if isinstance(k, desc) else k for k in keys]
        rest = [c for c in bindings.columns if c not in named]
        return order(bindings, *keys, *rest).limit(offset + count).offset(offset)
    indexed = row_index(bindings, keys, out="__idx")
    wanted = indexed.filter(F.col("__idx").between(offset, offset + count - 1))
    return wanted.orderBy("__idx").drop("__idx")
