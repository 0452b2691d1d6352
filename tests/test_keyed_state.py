import os
import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tessera.streaming import events as ev
from tessera.streaming import keyed
from test_streaming import write

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
at = lambda m: T0 + timedelta(minutes=m)


def stream_of(spark, path, batches, delay="10 minutes"):
    write(spark, path, batches)
    return ev.with_event_time(ev.stream_files(spark, path, spark.createDataFrame([], SCHEMA).schema, 1), delay=delay)


def sessions_of(rows, gap_minutes, mark):
    """Closed sessions of a batch: (user, number, start minute, end minute, n, total)."""
    per, out = defaultdict(list), []
    for _, ts, user, _, v in rows:
        if user is not None and ts is not None:
            per[user].append((ts, v or 0.0))
    for user, events in per.items():
        found = []
        for ts, v in sorted(events):
            if found and ts - found[-1][1] <= timedelta(minutes=gap_minutes):
                s = found[-1]
                found[-1] = (s[0], ts, s[2] + 1, s[3] + v)
            else:
                found.append((ts, ts, 1, v))
        out += [(user, i + 1, *s) for i, s in enumerate(found) if s[1] + timedelta(minutes=gap_minutes) < mark]
    return sorted(out)


def plain(rows):
    us = lambda x: T0 + timedelta(microseconds=x - 1_704_067_200_000_000)
    return sorted((r.user_id, r.session, us(r.start_us), us(r.end_us), r.n, r.total) for r in rows)


def test_merge_sessions():
    assert keyed.merge_sessions([(10, 20, 2, 1.0), (31, 31, 1, 5.0), (21, 29, 1, 1.0)], 2) == [(10, 31, 4, 7.0)]
    assert keyed.merge_sessions([(0, 1, 1, 0.0), (5, 6, 1, 0.0)], 3) == [(0, 1, 1, 0.0), (5, 6, 1, 0.0)] and keyed.merge_sessions([], 1) == []


def test_sessions_out_of_order_equal_batch_sessions(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, at(rng.choice([0, 1, 2]) + 3 * i), rng.randrange(3), "a", float(i % 5)) for i in range(120)]
    rows += [(900, at(40), None, "a", 1.0), (901, at(41), 1, "a", None), (902, at(41), 1, "a", 2.0)]
    rows.sort(key=lambda r: r[1])
    # shuffled within ten minutes, so nothing is late
    batches, out = [rows[i : i + 25] for i in range(0, len(rows), 25)], []
    for b in batches:
        rng.shuffle(b)
    with keyed.rocksdb_state(spark):
        out = ev.run_to_table(keyed.timed_sessions(stream_of(spark, f"{tmp_path}/in", batches), "user_id", 7 * 60)).collect()
    mark = max(r[1] for r in rows) - timedelta(minutes=10)
    want = sessions_of(rows, 7, mark)
    assert len(want) > 15 and plain(out) == want
    for r in out:
        assert r.same_size == sum(x.user_id == r.user_id and x.n == r.n and x.start_us <= r.start_us for x in out)
    lengths = {(u, n): (e - s).total_seconds() * 1e6 for u, n, s, e, _, _ in want}
    for r in out:
        last = [lengths[r.user_id, k] for k in range(max(1, r.session - 2), r.session + 1)]
        assert abs(r.recent_us - sum(last) / len(last)) < 1e-3


def test_one_event_unites_open_sessions_and_late_ones_are_dropped(spark, tmp_path):
    one = lambda i, m, v=1.0, user=1: (i, at(m), user, "a", v)
    batches = [
        [one(1, 0), one(2, 12)],  # two open sessions, six minutes from a common one
        [one(3, 6)],  # joins both
        [one(4, 100)],  # closes them
        [one(5, 101, user=2)],
        [one(6, 3), one(7, 95)],  # the first is late, the second is not
        [one(8, 200, user=2)],
    ]
    with keyed.rocksdb_state(spark):
        out = plain(ev.run_to_table(keyed.timed_sessions(stream_of(spark, f"{tmp_path}/in", batches), "user_id", 6 * 60)).collect())
    assert out == [(1, 1, at(0), at(12), 3, 3.0), (1, 2, at(95), at(100), 2, 2.0), (2, 1, at(101), at(101), 1, 1.0)]


def test_state_survives_a_restart(spark, tmp_path):
    rows = [(i, at(3 * i), i % 2, "a", 1.0) for i in range(80)]
    path, state = f"{tmp_path}/in", f"{tmp_path}/state"
    want, got = sessions_of(rows, 4, at(3 * 79 - 10)), []
    for part in (rows[:30], rows[30:33], rows[33:]):
        frame = keyed.timed_sessions(stream_of(spark, path, [part]), "user_id", 4 * 60)
        with keyed.rocksdb_state(spark):
            query = frame.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
        # file times go on from where the last part ended
        time.sleep(0.01)
    got = plain(spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == want and len(want) > 20
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_no_rows(spark, tmp_path):
    with keyed.rocksdb_state(spark):
        assert ev.run_to_table(keyed.timed_sessions(stream_of(spark, f"{tmp_path}/in", [[(1, None, 1, "a", 1.0)]]), "user_id", 60)).count() == 0


def test_time_to_live(spark, tmp_path):
    """Processing time never ends by itself, so this query is stopped, not awaited."""
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    row = lambda i, user: (i, at(i), user, "a", 1.0)

    def seen():
        files = spark.read.schema("user_id bigint, n bigint").parquet(out) if os.path.exists(out) else None
        return sorted((r.user_id, r.n) for r in files.collect()) if files is not None else []

    def wait(want, seconds):
        end = time.time() + seconds
        while time.time() < end and seen() != want:
            time.sleep(0.5)
        return seen()

    write(spark, path, [[row(1, 1), row(2, 1), row(3, 2), row(4, None)]])
    frame = keyed.first_seen(ev.stream_files(spark, path, spark.createDataFrame([], SCHEMA).schema), "user_id", 15_000)
    with keyed.rocksdb_state(spark):
        query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        assert wait([(1, 2), (2, 1)], 60) == [(1, 2), (2, 1)]
        first = time.time()
        write(spark, path, [[row(5, 1), row(6, 3)]])
        got = wait([(1, 2), (2, 1), (3, 1)], 10)
        if time.time() - first < 12:  # on a crowded machine key 1 may have run out already
            assert got == [(1, 2), (2, 1), (3, 1)]
        time.sleep(max(0.0, 17 - (time.time() - first)))
        write(spark, path, [[row(7, 1)]])
        assert wait([(1, 1), (1, 2), (2, 1), (3, 1)], 30).count((1, 1)) == 1
    finally:
        query.stop()


@pytest.fixture
def outer(spark, tmp_path):
    def made(errors, signups, how="left_outer"):
        left, right = stream_of(spark, f"{tmp_path}/l", errors), stream_of(spark, f"{tmp_path}/r", signups, "20 minutes")
        return ev.outer_interval_join(left, right, "user_id", 3600, how=how)

    return made


def test_outer_join_gives_nulls_once_no_match_can_come(outer):
    e = lambda i, m, user=1: (i, at(m), user, "error", 1.0)
    errors = [[e(1, 0), e(2, 5, 2)], [e(3, 50), e(4, 50, None)], [e(5, 300)], [e(6, 310)]]
    signups = [[e(11, 30)], [e(12, 61), e(13, 5, 2)], [e(14, 290)], [e(15, 305)]]
    rows = sorted(((r.event_id, r.r_event_id) for r in ev.run_to_table(outer(errors, signups)).collect()), key=str)
    # watermark at the end: min(310 - 10, 305 - 20) = 285, so errors before 225 are settled
    assert rows == sorted([(1, 11), (2, 13), (3, 12), (4, None), (5, 15)], key=str)
    with pytest.raises(ValueError):
        outer(errors, signups, how="full_outer")


def test_rows_behind_the_watermark_are_dropped(outer):
    e = lambda i, m, user=1: (i, at(m), user, "error", 1.0)
    errors = [[e(1, 0)], [e(2, 400)], [e(3, 410)], [e(4, 1)], [e(5, 500)]]
    signups = [[e(11, 500)], [e(12, 500)], [e(13, 500)], [e(14, 2)], [e(15, 600)]]
    rows = sorted(((r.event_id, r.r_event_id) for r in ev.run_to_table(outer(errors, signups)).collect()), key=str)
    # error 4 and signup 14 came behind the mark of 390: neither they nor their pair are there, nor a null for 4
    assert (1, None) in rows and not any(4 in r or 14 in r for r in rows)


def test_slices_keep_all_rows(spark):
    rows = [(i, None if i % 9 == 0 else at(i % 37), 1, "a", 1.0) for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 3, 50):
        path = ev.in_slices(frame, "ts", n)
        back = spark.read.parquet(path)
        assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    assert spark.read.parquet(ev.in_slices(frame.limit(0), "ts", 4)).count() == 0
    assert spark.read.parquet(ev.in_slices(frame.filter("ts is null"), "ts", 4)).count() == 12


def test_slices_of_several_files_are_batches(spark):
    """Each slice is written by several tasks; a batch is one slice, also where a slice has fewer rows than files."""
    rows = [(i, at(0 if i < 90 else i), 1, "a", 1.0) for i in range(100)]  # the quantiles leave one large slice and a small one
    for n, files, frame in ((4, 3, spark.createDataFrame(rows, SCHEMA).repartition(5)), (3, 8, spark.createDataFrame(rows[80:], SCHEMA))):
        path, batches = ev.in_slices(frame, "ts", n, files), []
        assert len(spark.read.parquet(path).inputFiles()) % files == 0
        stream = ev.stream_files(spark, path, frame.schema, files)
        query = stream.writeStream.foreachBatch(lambda b, _: batches.append(sorted(r.ts for r in b.collect()))).trigger(availableNow=True).option("checkpointLocation", f"{path}-state").start()
        query.awaitTermination()
        full = [b for b in batches if b]
        assert sum(map(len, full)) == frame.count() and all(a[-1] < b[0] for a, b in zip(full, full[1:])) and len(full) > 1
    assert ev.files_per_slice(spark.range(10), 2) == 1 and ev.files_per_slice(spark.range(101), 2, 10) == 6


def test_a_batch_costs_a_key_one_read_and_one_write():
    """Each state call is a round trip to the JVM, so what a key holds is read and written at once."""
    import pandas as pd

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, row):
            calls.append("update")
            self.held = row

    class Handle:
        getValueState = lambda self, *_: Value()
        getMapState = lambda self, *_: None
        registerTimer = lambda self, _: calls.append("timer")
        deleteTimer = lambda self, _: calls.append("timer")

    made = keyed.SessionTimers("k", 1_000_000)
    made.init(Handle())
    for us in (5_000_000, 5_500_000, 9_000_000):
        list(made.handleInputRows((1,), iter([pd.DataFrame({"us": [us], "value": [1.0]})]), None))
    assert calls.count("get") == calls.count("update") == 3 and len(calls) <= 9
    assert made.key_state.held[2] == [(5_000_000, 5_500_000, 2, 2.0), (9_000_000, 9_000_000, 1, 1.0)]
