import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as ev

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def rows(n=200):
    return [(i, T0 + timedelta(minutes=3 * i), i % 4, "ab"[i % 2], float(i % 10)) for i in range(n)]


def write(spark, path, batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):  # files are read in the order of their times
            if f.startswith("part-") and not os.path.exists(f"{path}/.{f}.seen"):
                os.utime(f"{path}/{f}", (1_700_000_000 + 60 * i,) * 2)
                open(f"{path}/.{f}.seen", "w").close()


@pytest.fixture
def source(spark, tmp_path):
    path = f"{tmp_path}/in"
    data = rows()
    write(spark, path, [data[i : i + 50] for i in range(0, 200, 50)])
    stream = ev.stream_files(spark, path, spark.createDataFrame([], SCHEMA).schema, 1)
    return ev.with_event_time(stream), ev.with_event_time(spark.createDataFrame(data, SCHEMA))


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_windows(source):
    stream, batch = source
    for slide in (None, "15 minutes"):
        assert same(ev.run_to_table(ev.tumbling(stream, "1 hour", ["event_type"], slide=slide), "complete"), ev.tumbling(batch, "1 hour", ["event_type"], slide=slide))
    closed = ev.run_to_table(ev.tumbling(stream, "1 hour", ["event_type"]))
    want = ev.tumbling(batch, "1 hour", ["event_type"]).filter(ev.F.col("start") + ev.F.expr("INTERVAL 1 HOUR") <= ev.F.lit(rows()[-1][1] - timedelta(minutes=10)))
    assert same(closed, want)


def test_sessions_dedupe_join(source):
    stream, batch = source
    assert same(ev.run_to_table(ev.sessions(stream, "12 minutes", "user_id"), "complete"), ev.sessions(batch, "12 minutes", "user_id"))
    assert ev.run_to_table(ev.deduplicate(stream.union(stream), ["event_id"])).count() == 200
    part = lambda df, k: df.filter(df.event_type == k)
    got = ev.run_to_table(ev.interval_stream_join(part(stream, "a"), part(stream, "a"), "user_id", 1800))
    assert same(got, ev.interval_stream_join(part(batch, "a"), part(batch, "a"), "user_id", 1800))


def test_state_and_files(spark, source, tmp_path):
    stream, batch = source
    out = ev.run_to_table(ev.running_totals(stream, "user_id"), "update")
    last = {r.user_id: (r.n, r.total) for r in out.orderBy("n").collect()}
    assert last == {r.user_id: (r.n, r.v) for r in batch.groupBy("user_id").agg(ev.F.count("*").alias("n"), ev.F.sum("value").alias("v")).collect()}
    assert ev.run_to_files(stream.select("event_id"), f"{tmp_path}/out").count() == 200


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[(1, at(0), 1, "a", 1.0)], [(2, at(300), 1, "a", 1.0)], [(3, at(301), 1, "a", 1.0)], [(4, at(1), 1, "a", 1.0), (5, at(299), 1, "a", 1.0)]]
    write(spark, f"{tmp_path}/in", batches)
    stream = ev.with_event_time(ev.stream_files(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, 1))
    got = ev.run_to_table(ev.tumbling(stream, "1 hour", []), "update")
    assert {(r.start, r.n) for r in got.collect() if r.start == T0} == {(T0, 1)}


def test_limit_and_approximate_distinct(source):
    stream, batch = source
    assert ev.run_to_table(stream.limit(30)).count() == 30
    about = lambda df: df.groupBy("event_type").agg(F.approx_count_distinct("event_id", 0.02).alias("n"))
    got = {r.event_type: r.n for r in ev.run_to_table(about(stream), "complete").collect()}
    exact = {r.event_type: r.n for r in batch.groupBy("event_type").agg(F.count_distinct("event_id").alias("n")).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) <= 0.1 * exact[k] for k in exact)
