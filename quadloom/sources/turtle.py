"""Turtle files to quads, in parallel over byte ranges of the files.

A plain file is cut into ranges of whole lines.  Three things have to be known where a range
starts: whether it lies inside a long string, which prefixes are in force, and whether a
statement is under way.  Each range tells what it does to the ranges after it, one small
row per range is carried along the file, and then all ranges are parsed independently; a
statement belongs to the range in which it begins.  Compressed files are one range each.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..terms import term
from . import turtle_workers as tw
from . import workers
from .catalog import compression

# tasks get these helpers by value: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(tw)
cloudpickle.register_pickle_by_value(workers)

RANGE_BYTES = 64 << 20
RANGES_PER_FILE = 50_000
TASK_BYTES = 4 << 20
RANGE = 'source_idx int, file_idx int, path string, start bigint, end bigint'
START = '{"base": "", "prefixes": {}}'
PARSED = ("source_idx int, file_idx int, range bigint, statement bigint, s string, s_kind tinyint, p string, "
          "o_kind tinyint, o_value string, o_lang string, o_dt string, error string, start bigint, end bigint")
REJECTS = "source_idx int, file_idx int, start bigint, end bigint, error string, piece int, line string"


def _spread(df: DataFrame, tasks: int) -> DataFrame:
    return df.repartition(max(1, tasks), "source_idx", "file_idx", "start")


def parse_turtle(spark: SparkSession, files: DataFrame, mode: str = "failfast",
                 range_bytes: int | None = None):
    """Quads of Turtle files.  ``failfast`` stops the job at the first faulty statement.

    ``quarantine`` returns ``(quads, rejects)``: every statement has an address (source, file,
    range, number), no quad of a faulty one is kept however long it is, and a reject names the
    bytes it stands at and carries its text, one row for each piece of it.
    """
    if mode not in ("failfast", "quarantine"):
        raise ValueError("mode must be 'failfast' or 'quarantine'")
    packed = compression(F.col("path")) != ""
    files = files.select("source_idx", "file_idx", "path", "size")
    size = files.agg(F.sum("size")).first()[0] or 0
    slots = spark.sparkContext.defaultParallelism
    if range_bytes is None:  # some ranges for every core, so that the last of them is not waited for
        range_bytes = int(min(RANGE_BYTES, max(TASK_BYTES, size / (4 * slots))))
    # a task takes many short ranges: neither tasks nor the files they write grow with the ranges
    at_most = min(100_000, max(4 * slots, int(size / TASK_BYTES)))
    single = files.filter(packed | (F.col("size") <= range_bytes)).select(
        "source_idx", "file_idx", "path", F.lit(0).cast("long").alias("start"),
        F.lit(-1).cast("long").alias("end"), F.lit("N").alias("state"), F.lit(START).alias("env"),
        F.lit(0).alias("running"))
    large = files.filter(~packed & (F.col("size") > range_bytes))
    ranges = single
    if not large.isEmpty():
        step = F.greatest(F.lit(range_bytes).cast("long"), F.ceil(F.col("size") / RANGES_PER_FILE))
        starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("step"))
        cut = large.withColumn("step", step).select(
            "source_idx", "file_idx", "path", F.explode(starts).alias("start"), "step")
        cut = cut.select("source_idx", "file_idx", "path", "start", (F.col("start") + F.col("step")).alias("end"))
        tasks = min(cut.count(), at_most)
        # carried per file: one small row per range, and at most RANGES_PER_FILE of them
        states = _spread(cut, tasks).mapInPandas(
            tw.range_states, RANGE + ", from_n string, from_d string, from_s string"
        ).groupBy("source_idx", "file_idx").applyInPandas(tw.carry_states, RANGE + ", state string")
        states = materialise(states, "turtle-states")
        declared = _spread(states, tasks).mapInPandas(
            tw.range_directives, RANGE + ", state string, declared string, open int"
        ).groupBy("source_idx", "file_idx").applyInPandas(
            tw.carry_declarations, RANGE + ", state string, env string, running int")
        ranges = single.unionByName(materialise(declared, "turtle-ranges"))
    tasks = min(ranges.count(), at_most)
    parsed = _spread(ranges, tasks).mapInPandas(tw.parse_ranges, PARSED)
    quads = F.col("error").isNull()
    if mode == "failfast":
        message = F.concat(F.lit("cannot parse statement of source "), F.col("source_idx").cast("string"),
                           F.lit(" file "), F.col("file_idx").cast("string"), F.lit(" at byte "),
                           F.col("start").cast("string"), F.lit(": "), F.col("error"))
        return _quads(parsed.filter(F.when(quads, F.lit(True)).otherwise(F.raise_error(message))))
    parsed = materialise(parsed, "turtle-statements")
    address = ["source_idx", "file_idx", "range", "statement"]
    bad = materialise(parsed.filter(~quads).select(*address, "error", "start", "end"), "turtle-rejects")
    good = parsed.filter(quads).join(bad.select(*address), address, "left_anti")
    places = bad.join(files.select("source_idx", "file_idx", "path"), ["source_idx", "file_idx"])
    places = places.sortWithinPartitions("path", "start")
    return _quads(good), places.mapInPandas(tw.reject_texts, REJECTS)


def _quads(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        F.lit(None).cast("string").alias("g"), "s", "s_kind", "p",
        term(F.col("o_kind"), F.col("o_value"), F.col("o_lang"), F.col("o_dt")).alias("o"),
        "source_idx", "file_idx")
