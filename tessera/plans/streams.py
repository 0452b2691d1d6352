"""Event-time queries: each runs the event table as a stream to its end; SQL says the same over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path
from tessera.sources import commit_log
from tessera.sources.tables import read_table
from tessera.streaming import events as ev
from tessera.streaming import keyed

QUERIES = {}
SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    return ev.with_event_time(ev.stream_files(spark, f"{sf_dir.rstrip('/')}/events*.parquet", schema))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.run_to_table(ev.tumbling(event_stream(spark, sf_dir), "1 hour", ["event_type"]), "complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
SELECT start, count(*) AS n FROM (SELECT min(ts) AS start FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid
FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, sid) GROUP BY start
""")
def stream_session_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.run_to_table(ev.sessions(event_stream(spark, sf_dir), "30 minutes", "user_id"), "complete")
    return found.groupBy(F.col("start").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = event_stream(spark, sf_dir)
    return ev.run_to_table(ev.deduplicate(stream.union(stream), ["event_id"]).select("event_id", "user_id"))


@query("SELECT a.event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'error' AND b.event_type = 'signup'")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind: event_stream(spark, sf_dir).filter(F.col("event_type") == kind)
    return ev.run_to_table(ev.interval_stream_join(part("error"), part("signup"), "user_id", 3600))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.run_to_table(ev.running_totals(event_stream(spark, sf_dir), "user_id"), "update")
    return found.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


def sliced_stream(spark: SparkSession, sf_dir: str, slices: int = 4, delay: str = "10 minutes", kind: str | None = None) -> DataFrame:
    """The event table as a stream of several batches in event order."""
    table = read_table(spark, sf_dir, "events")
    rows = table if kind is None else table.filter(F.col("event_type") == kind)
    files = ev.files_per_slice(rows, slices)
    return ev.with_event_time(ev.stream_files(spark, ev.in_slices(rows, "ts", slices, files), table.schema, files), delay=delay)


@query("""
WITH s AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n, sum(value) AS total FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (
    SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, sid)
SELECT user_id, row_number() OVER w AS session, start, n, round(total, 4) AS total,
  round(avg(epoch_us(last) - epoch_us(start)) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 1e6, 3) AS recent_seconds,
  row_number() OVER (PARTITION BY user_id, n ORDER BY start) AS same_size
FROM s WHERE last + INTERVAL 30 MINUTE < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY start)
""")
def stream_timer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    with keyed.rocksdb_state(spark):
        found = ev.run_to_table(keyed.timed_sessions(sliced_stream(spark, sf_dir), "user_id", 1800))
    return found.select("user_id", "session", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), F.round(F.col("recent_us") / 1e6, 3).alias("recent_seconds"), "same_size")


_ERRORS_AND_SIGNUPS = """
WITH a AS (SELECT * FROM events WHERE event_type = 'error'), b AS (SELECT * FROM events WHERE event_type = 'signup'),
seen AS (SELECT least((SELECT max(ts) FROM a) - INTERVAL 10 MINUTE, (SELECT max(ts) FROM b) - INTERVAL 20 MINUTE) AS mark),
j AS (SELECT a.event_id, a.user_id, a.ts, b.event_id AS r_event_id FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR)
"""


def _errors_and_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.outer_interval_join(sliced_stream(spark, sf_dir, 3, "10 minutes", "error"), sliced_stream(spark, sf_dir, 4, "20 minutes", "signup"), "user_id", 3600)


@query(_ERRORS_AND_SIGNUPS + "SELECT event_id, user_id, r_event_id FROM j, seen WHERE r_event_id IS NOT NULL OR ts + INTERVAL 1 HOUR < mark")
def stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.run_to_table(_errors_and_signups(spark, sf_dir)).select("event_id", "user_id", "r_event_id")


@query(_ERRORS_AND_SIGNUPS + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(r_event_id) AS pairs, count(*) FILTER (WHERE r_event_id IS NULL) AS unmatched
FROM j, seen GROUP BY time_bucket(INTERVAL 1 DAY, ts), mark HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= mark - INTERVAL 1 HOUR
""")
def stream_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.run_to_table(ev.match_rates(_errors_and_signups(spark, sf_dir), "1 day"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS v, min(event_id) AS first_id FROM events GROUP BY user_id, event_type")
def stream_through_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table by way of a log: streamed in, batch by batch, and streamed out of it again."""
    at, table = scratch_path(spark, "log"), read_table(spark, sf_dir, "events")
    files = ev.files_per_slice(table, 3)
    path = ev.in_slices(table, "ts", 3, files)
    commit_log.append_to_log(ev.stream_files(spark, path, table.schema, files), f"{at}/log", f"{at}/state")
    found = ev.run_to_table(commit_log.read_log(spark, f"{at}/log", table.schema, stream=True))
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"), F.min("event_id").alias("first_id"))
