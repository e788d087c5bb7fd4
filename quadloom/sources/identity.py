"""Content hashes, the input manifest, and what changed since the last load."""

from __future__ import annotations

import hashlib
import json

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import workers
from .catalog import listed

# tasks get these helpers by value: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(workers)

MANIFEST = ("source_idx int, file_idx int, path string, graph string, format string, "
            "sha256 string, size bigint, mtime timestamp")


def spread(files: DataFrame, files_per_task: int = 1) -> DataFrame:
    """Files over tasks by size order, so that no task gets several large ones."""
    parallelism = files.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(files.count() // files_per_task, 20 * parallelism))
    return files.repartition(n, "path")


def content_hash(spark: SparkSession, files: DataFrame) -> DataFrame:
    """SHA-256 of the decompressed bytes of every file, read in 1 MiB blocks."""
    paths = spread(files.select("source_idx", "file_idx", "path"))
    return paths.mapInPandas(
        workers.hash_files, "source_idx int, file_idx int, path string, sha256 string")


def build_manifest(files: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per input file with graph, format and content hash.

    Written to the shared folder once, so that later steps never hash the files again and
    all see the same state of the inputs.
    """
    hashes = content_hash(files.sparkSession, files).select("source_idx", "file_idx", "sha256")
    return materialise(listed(files, sources).join(hashes, ["source_idx", "file_idx"]).select(
        "source_idx", "file_idx", "path", "graph", "format", "sha256", "size", "mtime"), "manifest")


def input_hash(manifest: DataFrame) -> str:
    """SHA-256 of the compact JSON of the manifest, in source and file order.

    The rows (file metadata only) are streamed through one digest, never held together.
    """
    rows = manifest.select("path", "graph", "format", "sha256", "source_idx", "file_idx").orderBy(
        "source_idx", "file_idx").select("path", "graph", "format", "sha256")
    digest = hashlib.sha256(b'{"sources":[')
    for i, row in enumerate(rows.toLocalIterator()):
        text = json.dumps(row.asDict(), ensure_ascii=False, separators=(",", ":"))
        digest.update((("," if i else "") + text).encode())
    digest.update(b'],"input_hash":""}')
    return digest.hexdigest()


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.orderBy("source_idx", "file_idx").write.mode("overwrite").option(
        "ignoreNullFields", "false").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """Listed files whose path, size or time differs from what was seen before."""
    return new.join(old.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def refresh_manifest(files: DataFrame, sources: DataFrame, old: DataFrame) -> DataFrame:
    """The new manifest, hashing only files whose size or time changed."""
    # one row for each file, though it may stand under several sources
    seen = old.select("path", "size", "mtime", "sha256").dropDuplicates(["path", "size", "mtime"])
    kept = files.join(seen, ["path", "size", "mtime"])
    fresh = changed_files(files, old)
    hashed = fresh.join(
        content_hash(files.sparkSession, fresh).select("source_idx", "file_idx", "sha256"),
        ["source_idx", "file_idx"])
    columns = ["source_idx", "file_idx", "path", "size", "mtime", "sha256"]
    both = kept.select(*columns).unionByName(hashed.select(*columns))
    return materialise(listed(both, sources).select(
        "source_idx", "file_idx", "path", "graph", "format", "sha256", "size", "mtime"), "manifest")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per input (path, graph, format): added, removed, changed or same."""
    keys = ["path", "graph", "format"]
    a = old.select(*keys, F.col("sha256").alias("__old"))
    b = new.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("sha256").alias("__new"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = a.join(b, on[0] & on[1] & on[2], "full_outer")
    change = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed")
        .when(F.col("__old") == F.col("__new"), "same").otherwise("changed"))
    in_new = F.col("__new").isNotNull()
    return joined.select(
        *[F.when(in_new, F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        change.alias("change"))


def load_decision(stamp: str | None, wanted: str, exists: bool) -> str:
    """``keep`` when the stamp equals the wanted hash; ``reset`` stale data; else ``build``."""
    if stamp is None:
        return "reset" if exists else "build"
    return "keep" if stamp == wanted else "reset"
