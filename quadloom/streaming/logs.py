"""Service logs and events: the same column expressions for batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import key_values
from ..session import scratch_path
from ..sources.readers import read_nquads, read_ntriples
from ..terms import QUADS

# --- fixed values: limits of the log view and the restart rule ---
LOG_LINES = 500
EVENTS = 20
FAST_FAILURE_MS = 3_000
BACKOFF_MS = {1: 1_000, 2: 2_000, 3: 3_000}
LONGEST_BACKOFF_MS = 5_000
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
LINE = r"^(\S+) \[([^\]]*)\] (.*)$"
# --- end of fixed values ---


# ---------------------------------------------------------------- lines
def merge_logs(*streams: tuple[DataFrame, str, str]) -> DataFrame:
    """Lines of several services in one frame, tagged with service and output stream."""
    tagged = [df.select("at", F.lit(service).alias("service"), F.lit(stream).alias("stream"), "line")
              for df, service, stream in streams]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def clean_lines(df: DataFrame) -> DataFrame:
    """Without line ends (all line feeds, then all carriage returns) and without empty lines."""
    line = F.regexp_replace("line", r"\r*\n*\z", "")
    return df.withColumn("line", line).filter(F.col("line") != "")


def decode_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Raw bytes as text; bytes that are not UTF-8 become the replacement character."""
    return df.withColumn("line", F.expr(f"make_valid_utf8(cast({raw} as string))")).drop(raw)


def format_log(at: Column, service: Column, line: Column) -> Column:
    return F.concat(F.date_format(at, TIME_FORMAT), F.lit(" ["), service, F.lit("] "), line)


def parse_log(df: DataFrame, column: str = "value") -> DataFrame:
    """``at``, ``service`` and ``line`` of the combined log."""
    c = F.col(column)
    return df.filter(c.rlike(LINE)).select(
        F.try_to_timestamp(F.regexp_extract(c, LINE, 1), F.lit(TIME_FORMAT)).alias("at"),
        F.regexp_extract(c, LINE, 2).alias("service"),
        F.regexp_extract(c, LINE, 3).alias("line"))


def parse_events(df: DataFrame, column: str = "line") -> DataFrame:
    """Event fields of ``service=... event=... key=value`` lines next to what ``df`` has."""
    fields = df.filter(F.contains(F.col(column), F.lit("event="))).withColumn("__kv", key_values(F.col(column)))

    def get(name: str) -> Column:
        return F.try_element_at("__kv", F.lit(name))

    keep = [c for c in df.columns if c not in (column, "service")]
    return fields.select(
        *keep, get("service").alias("service"), get("event").alias("event"),
        get("code").try_cast("int").alias("code"), get("pid").try_cast("int").alias("pid"),
        get("restarts").try_cast("int").alias("restarts"),
        get("runtime_ms").try_cast("long").alias("runtime_ms"),
        get("restart_in_ms").try_cast("long").alias("restart_in_ms"), get("error").alias("error"))


# ---------------------------------------------------------------- summaries
def tail(df: DataFrame, n: int = LOG_LINES, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The last n rows: each task keeps its own last n, then they are merged."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def latest_status(df: DataFrame, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The most recent event of every service; state of fixed size per service."""
    fields = [c for c in df.columns if c != "service"]
    last = F.max_by(F.struct(*fields), F.struct(*order))
    return df.groupBy("service").agg(last.alias("last")).select("service", "last.*")


def restart_stats(df: DataFrame) -> DataFrame:
    """Exit history per service: exits, fast failures, last exit code, total and mean runtime."""
    is_exit = F.col("event") == "exit"
    runtime = F.when(is_exit, F.col("runtime_ms"))
    return df.groupBy("service").agg(
        F.count(F.when(is_exit, 1)).alias("exits"),
        F.count(F.when(is_exit & (F.col("runtime_ms") < FAST_FAILURE_MS), 1)).alias("fast_failures"),
        # of exits at one time the longer run, then the greater code, counts as the last
        F.max_by(F.when(is_exit, F.col("code")), F.when(is_exit, F.struct("at", "runtime_ms", "code"))).alias("last_code"),
        F.sum(runtime).alias("total_runtime_ms"), F.avg(runtime).alias("mean_runtime_ms"))


def backoff(runtime_ms: Column, restart_count: Column) -> Column:
    """Milliseconds until the next start: short after a long run, else by restart count."""
    wait = F.when((runtime_ms >= FAST_FAILURE_MS) | (restart_count <= 1), F.lit(BACKOFF_MS[1]))
    for count in (2, 3):
        wait = wait.when(restart_count == count, F.lit(BACKOFF_MS[count]))
    return wait.otherwise(F.lit(LONGEST_BACKOFF_MS))


def event_rates(df: DataFrame, window: str = "1 day", watermark: str | None = "1 day",
                at: str = "at", keys: tuple[str, ...] = ("service", "event")) -> DataFrame:
    """Events per time window; the watermark bounds the state of a running stream."""
    timed = df.withColumn("__at", F.col(at).cast("timestamp"))
    if watermark is not None and df.isStreaming:
        timed = timed.withWatermark("__at", watermark)
    counted = timed.groupBy(F.window("__at", window), *keys).agg(F.count("*").alias("events"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "events")


# ---------------------------------------------------------------- running streams
def append_log(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Append every batch to one combined log, then stop when the input is used up."""
    if fmt == "text":
        stream = stream.select(format_log(F.col("at"), F.col("service"), F.col("line")).alias("value"))
    query = (stream.writeStream.format(fmt).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start(path))
    query.awaitTermination()
    return query


def _batches(spark: SparkSession, path: str) -> list[int]:
    try:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.parquet").load(path).select(
            F.regexp_extract("path", r"/batch=(\d+)/", 1).cast("long").alias("b")).distinct()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    return sorted(r["b"] for r in names.collect())


def run_tail(stream: DataFrame, path: str, checkpoint: str, n: int = LOG_LINES,
             order: tuple[str, ...] = ("at",)) -> DataFrame:
    """Keep the last n rows of a stream in a small stored table.

    Each batch is merged with the table of the batch before it and written under its own
    number, so a repeated batch replaces its own result only.
    """
    schema = stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in _batches(spark, path) if b < batch_id]
        rows = batch
        if before:
            rows = batch.unionByName(spark.read.schema(schema).parquet(f"{path}/batch={before[-1]}"))
        tail(rows, n, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    spark = stream.sparkSession
    done = _batches(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/batch={done[-1]}") if done else spark.createDataFrame([], schema)


def run_summary(stream: DataFrame, summarise: Callable[[DataFrame], DataFrame], path: str,
                checkpoint: str) -> DataFrame:
    """Run an aggregation over a stream and keep its complete result after the last batch."""
    summary = summarise(stream)
    schema = summary.schema

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (summary.writeStream.outputMode("complete").foreachBatch(store)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    spark = stream.sparkSession
    done = _batches(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/batch={done[-1]}") if done else spark.createDataFrame([], schema)


def stream_sources(spark: SparkSession, folder: str, path: str, checkpoint: str, fmt: str = "nt",
                   graph: str | None = None) -> DataFrame:
    """Pick up new line-format files of a folder and add their quads to a table as a set.

    Quads already stored by other batches are left out.  Blank node labels are scoped by the
    path of their file.
    """
    lines = spark.readStream.text(folder).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("scope"),
        F.lit(0).alias("source_idx"), F.lit(0).alias("file_idx"))
    quads = read_nquads(lines) if fmt == "nq" else read_ntriples(lines, graph)

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        new = batch.dropDuplicates(["g", "s", "s_kind", "p", "o"])
        before = [f"{path}/batch={b}" for b in _batches(session, path) if b != batch_id]
        if before:
            known = session.read.schema(QUADS).parquet(*before)
            on = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("g", "s", "s_kind", "p", "o")]
            new = new.alias("n").join(known.alias("k"), reduce(lambda a, b: a & b, on), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (quads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    stored = [f"{path}/batch={b}" for b in _batches(spark, path)]
    return spark.read.schema(QUADS).parquet(*stored) if stored else spark.createDataFrame([], QUADS)


def run_folder(spark: SparkSession, label: str) -> tuple[str, str]:
    """A fresh result folder and checkpoint folder in the shared scratch space."""
    base = scratch_path(spark, label)
    return f"{base}/out", f"{base}/checkpoint"
