"""Service logs: the events table as log lines, in batch and as a stream."""

from pyspark.sql import functions as F

from quadloom.fixtures import EX, table_quads
from quadloom.session import scratch_path
from quadloom.sources import writers
from quadloom.streaming import logs

from .registry import CUST, query

C = F.col
SVC = "'svc-' || user_id"
EVENT = "CASE event_type WHEN 'error' THEN 'exit' ELSE event_type END"
RUN = "CAST(floor(value * 100) AS BIGINT)"


def _events(df):
    """Events as log lines; an ``error`` event is a service exit."""
    service = F.concat(F.lit("svc-"), C("user_id").cast("string"))
    is_exit = C("event_type") == "error"
    line = F.concat(
        F.lit("service="), service, F.lit(" event="), F.when(is_exit, "exit").otherwise(C("event_type")),
        F.when(is_exit, F.concat(F.lit(" code="), (C("user_id") % 3).cast("string"))).otherwise(""),
        F.lit(" runtime_ms="), F.floor(C("value") * 100).cast("string"))
    return df.select(C("ts").cast("timestamp").alias("at"), C("event_id"), service.alias("service"),
                     F.when(is_exit, "stderr").otherwise("stdout").alias("stream"), line.alias("line"))


def batch(spark, sf):
    return _events(spark.read.parquet(f"{sf}/events.parquet"))


def stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return _events(source)


def parsed(df):
    return logs.parse_events(df.select("at", "event_id", "service", "line"))


@query("merged_logs", f"""
    SELECT {SVC} AS service, CASE event_type WHEN 'error' THEN 'stderr' ELSE 'stdout' END AS stream, count(*) AS n
    FROM events GROUP BY 1, 2""")
def merged_logs(spark, sf):
    b = batch(spark, sf)
    out = logs.merge_logs((b.filter("stream = 'stdout'"), "all", "stdout"), (b.filter("stream = 'stderr'"), "all", "stderr"))
    service = F.regexp_extract("line", r"service=(\S+)", 1)
    return out.groupBy(service.alias("service"), "stream").agg(F.count("*").alias("n"))


@query("clean_log_lines", """
    SELECT event_id, CASE event_id % 4 WHEN 1 THEN event_type || chr(10) ELSE event_type END AS line FROM events WHERE event_id % 4 < 3""")
def clean_log_lines(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = C("event_id") % 4  # every line end form, and lines that are empty without it
    raw = (F.when(kind == 0, F.concat("event_type", F.lit("\r\n"))).when(kind == 1, F.concat("event_type", F.lit("\n\r\n")))
           .when(kind == 2, C("event_type")).otherwise("\r\n"))
    return logs.clean_lines(e.select("event_id", raw.alias("line")))


@query("parsed_log_lines", f"""
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, {SVC} AS service, 'value [' || event_type || '] seen' AS line FROM events""")
def parsed_log_lines(spark, sf):
    b = spark.read.parquet(f"{sf}/events.parquet")
    text = logs.format_log(C("ts").cast("timestamp"), F.concat(F.lit("svc-"), C("user_id").cast("string")),
                           F.concat(F.lit("value ["), C("event_type"), F.lit("] seen")))
    p = logs.parse_log(b.select(text.alias("value")))
    return p.select(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "service", "line")


@query("parsed_events", f"""
    SELECT event_id, {SVC} AS service, {EVENT} AS event, CASE event_type WHEN 'error' THEN user_id % 3 END AS code, {RUN} AS runtime_ms FROM events""")
def parsed_events(spark, sf):
    return parsed(batch(spark, sf)).select("event_id", "service", "event", "code", "runtime_ms")


@query("combined_log_stream", f"SELECT {SVC} AS service, {EVENT} AS event, count(*) AS n FROM events GROUP BY 1, 2")
def combined_log_stream(spark, sf):
    out, checkpoint = logs.run_folder(spark, "log")
    logs.append_log(stream(spark, sf), out, checkpoint, "text")
    lines = logs.parse_log(spark.read.text(out))
    return logs.parse_events(lines).groupBy("service", "event").agg(F.count("*").alias("n"))


TAIL_SQL = "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500"


@query("log_tail", TAIL_SQL)
def log_tail(spark, sf):
    return logs.tail(batch(spark, sf), logs.LOG_LINES, ("at", "event_id")).select("event_id")


@query("log_tail_stream", TAIL_SQL)
def log_tail_stream(spark, sf):
    out, checkpoint = logs.run_folder(spark, "tail")
    return logs.run_tail(stream(spark, sf), out, checkpoint, logs.LOG_LINES, ("at", "event_id")).select("event_id")


@query("event_tail", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def event_tail(spark, sf):
    exits = parsed(batch(spark, sf)).filter("event = 'exit'")
    return logs.tail(exits, logs.EVENTS, ("at", "event_id")).select("event_id")


LATEST_SQL = f"""
    SELECT service, event_id, event, runtime_ms FROM (SELECT {SVC} AS service, event_id, {EVENT} AS event, {RUN} AS runtime_ms,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def _latest(df):
    return logs.latest_status(parsed(df), ("at", "event_id")).select("service", "event_id", "event", "runtime_ms")


@query("latest_status", LATEST_SQL)
def latest_status(spark, sf):
    return _latest(batch(spark, sf))


@query("latest_status_stream", LATEST_SQL)
def latest_status_stream(spark, sf):
    out, checkpoint = logs.run_folder(spark, "latest")
    return logs.run_summary(stream(spark, sf), _latest, out, checkpoint)


RESTART_SQL = f"""
    SELECT {SVC} AS service, count(*) FILTER (event_type = 'error') AS exits,
      count(*) FILTER (event_type = 'error' AND {RUN} < 3000) AS fast_failures,
      max(user_id % 3) FILTER (event_type = 'error') AS last_code,
      CAST(sum({RUN}) FILTER (event_type = 'error') AS BIGINT) AS total_runtime_ms,
      round(avg({RUN}) FILTER (event_type = 'error'), 3) AS mean_runtime_ms FROM events GROUP BY 1"""


def _restarts(df):
    return logs.restart_stats(parsed(df)).withColumn("mean_runtime_ms", F.round("mean_runtime_ms", 3))


@query("restart_stats", RESTART_SQL)
def restart_stats(spark, sf):
    return _restarts(batch(spark, sf))


@query("restart_stats_stream", RESTART_SQL)
def restart_stats_stream(spark, sf):
    out, checkpoint = logs.run_folder(spark, "restarts")
    return logs.run_summary(stream(spark, sf), _restarts, out, checkpoint)


@query("backoff_times", f"""
    SELECT event_id, CASE WHEN {RUN} >= 3000 OR user_id % 6 <= 1 THEN 1000 WHEN user_id % 6 = 2 THEN 2000 WHEN user_id % 6 = 3 THEN 3000
      ELSE 5000 END AS wait_ms FROM events""")
def backoff_times(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", logs.backoff(F.floor(C("value") * 100), C("user_id") % 6).alias("wait_ms"))


RATE_SQL = f"""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {EVENT} AS event, count(*) AS events FROM events GROUP BY 1, 2"""


def _rates(df):
    counted = logs.event_rates(parsed(df), "1 day", None, keys=("event",))
    return counted.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event", "events")


@query("event_rates", RATE_SQL)
def event_rates(spark, sf):
    return _rates(batch(spark, sf))


@query("event_rates_stream", RATE_SQL)
def event_rates_stream(spark, sf):
    out, checkpoint = logs.run_folder(spark, "rates")
    return logs.run_summary(stream(spark, sf), _rates, out, checkpoint)


@query("streamed_quads", f"""
    SELECT {CUST} AS s, '{EX}name' AS p, c_name AS o FROM customer UNION ALL SELECT {CUST}, '{EX}segment', c_mktsegment FROM customer""")
def streamed_quads(spark, sf):
    inbox = scratch_path(spark, "inbox")
    out, checkpoint = logs.run_folder(spark, "quads")
    names = table_quads(spark, sf, "customer").filter(C("p").isin(EX + "name", EX + "segment"))
    writers.write_nquads(names.filter(C("p") == EX + "name"), inbox)
    logs.stream_sources(spark, inbox, out, checkpoint, "nq")
    # the second delivery repeats the first: only new quads may be added
    writers.nquads_lines(names).write.mode("append").text(inbox)
    q = logs.stream_sources(spark, inbox, out, checkpoint, "nq")
    return q.select("s", "p", C("o")["value"].alias("o"))
