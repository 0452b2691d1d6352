from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import joins

T0 = datetime(2024, 1, 1)
row = st.tuples(st.sampled_from([1, 1, 2, None]), st.one_of(st.none(), st.integers(0, 40)), st.integers(0, 5))


def frame(spark, rows):
    return spark.createDataFrame([(k, None if t is None else T0 + timedelta(seconds=t * 10), i * 100 + v) for i, (k, t, v) in enumerate(rows)], "k int, ts timestamp_ntz, v int")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=st.lists(row, min_size=1, max_size=12), right=st.lists(row, max_size=12), slices=st.sampled_from([None, 50, 7]))
def test_asof(spark, left, right, slices):
    l, r = frame(spark, left), frame(spark, right)
    got = sorted(((x.k, x.ts, x.v, x.r_ts, x.r_v) for x in joins.asof_join(l, r, "k", "ts", ["v"], slice_seconds=slices).collect()), key=str)
    want = []
    for k, t, v in l.collect():
        found = [(x.ts, x.v) for x in r.collect() if None not in (k, t, x.k, x.ts) and x.k == k and x.ts <= t]
        want.append((k, t, v, *(max(found) if found else (None, None))))
    assert got == sorted(want, key=str)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=st.lists(row, min_size=1, max_size=12), right=st.lists(row, min_size=1, max_size=12), seconds=st.sampled_from([10, 35]))
def test_interval(spark, left, right, seconds):
    l, r = frame(spark, left), frame(spark, right)
    got = sorted((x.v, x.r_v) for x in joins.interval_join(l, r, "k", "ts", seconds).collect())
    span = timedelta(seconds=seconds)
    assert got == sorted((a.v, b.v) for a in l.collect() for b in r.collect() if None not in (a.k, a.ts, b.k, b.ts) and a.k == b.k and a.ts <= b.ts <= a.ts + span)


def test_range_and_salted(spark):
    p = spark.createDataFrame([(x / 4,) for x in range(-20, 60)] + [(None,)], "x double")
    r = spark.createDataFrame([(0.0, 3.5), (-2.0, -1.0), (5.0, 5.0), (3.0, 14.0), (None, 1.0)], "low double, high double")
    got = sorted((a.x, a.low) for a in joins.range_join(p, r, "x", "low", "high", 1.5).collect())
    assert got == sorted((a.x, b.low) for a in p.collect() for b in r.collect() if None not in (a.x, b.low) and b.low <= a.x < b.high)
    big = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 0), (3, 0)], "k int, i int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, s string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(tuple, joins.salted_join(big, small, "k", 4, how).collect()), key=str) == sorted(map(tuple, big.join(small, "k", how).collect()), key=str)


def test_no_nested_loops(spark, sf_dir):
    from tessera.plans.registry import QUERIES

    for name in ("asof_last_view", "asof_last_view_sliced", "signups_after_errors", "price_bands"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_wide_ranges(spark):
    rows = [(0.5, 2e9), (-3.0, 1.0), (7.0, 7.5), (7.0, 7.0), (5.0, 1.0), (None, 2.0), (100.0, 164.0)]
    p = spark.createDataFrame([(float(x),) for x in (-3, 0, 0.5, 1, 7, 7.5, 100, 163.9, 164, 1e9, 2e9)] + [(None,)], "x double")
    r = spark.createDataFrame(rows, "low double, high double")
    got = sorted((a.x, a.low) for a in joins.range_join(p, r, "x", "low", "high", 0.25).collect())
    assert got == sorted((x.x, lo) for x in p.collect() if x.x is not None for lo, hi in rows if lo is not None and lo <= x.x < hi)
    assert joins.range_join(p, r.limit(0), "x", "low", "high", 1.0).count() == 0


def test_counted_join(spark):
    large = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 3), (3, 1), (None, 2)) for i in range(n)], "k int, i int")
    small = spark.createDataFrame([(1, "a", 500), (2, "b", 3), (4, "d", 0)], "k int, name string, n bigint")
    for share in (100_000, 10, 1):
        got = sorted((r.k, r.i, r.name) for r in joins.counted_join(large, small, ["k"], "n", share).collect())
        assert got == sorted((r.k, r.i, r.name) for r in large.join(small, "k").collect())
        left = joins.counted_join(large, small, ["k"], "n", share, "left")
        assert sorted(map(str, left.select("k", "i", "name").collect())) == sorted(map(str, large.join(small, "k", "left").select("k", "i", "name").collect()))
    assert joins.counted_join(large, small.limit(0), ["k"], "n").count() == 0


def test_not_in_is_not_broadcast(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k bigint")
    for values in ([], [2], [2, 2, 3], [None], [2, None], [1, 2]):
        listed = spark.createDataFrame([(v,) for v in values], "v bigint")
        want = spark.sql("SELECT k FROM {l} WHERE k NOT IN (SELECT v FROM {t})", l=left, t=listed).collect()
        assert sorted(map(str, joins.not_in(left, "k", listed, "v").collect())) == sorted(map(str, want)), values


def test_null_aware_not_in_shuffles_its_list(spark, sf_dir):
    from tessera.plans.relational import QUERIES

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when the list is large
    try:
        plan = QUERIES["null_aware_not_in"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
