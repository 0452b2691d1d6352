import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import extra
from tessera.operators.diff import table_diff
from tessera.plans.layouts import QUERIES

SCHEMA = "k int, k2 string, a double, b string"


def bag_diff(before, after):
    out = []
    for key in {r[:2] for r in before + after}:
        old, new = (Counter(r[2:] for r in rows if r[:2] == key) for rows in (before, after))
        gone, come = old - new, new - old
        if gone.total() == come.total() == 1:
            x, y = next(iter(gone)), next(iter(come))
            out.append((*key, "changed", ",".join(n for n, p, q in zip("ab", x, y) if p != q), 1))
        else:
            out += [(*key, kind, None, c.total()) for kind, c in (("removed", gone), ("added", come)) if c]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [10_000, 3])
def test_table_diff(spark, most):
    rng = random.Random(7)
    row = lambda: (rng.choice([1, 2, 3, 4, 5, None]), rng.choice(["x", None]), rng.choice([1.0, 2.5, None]), rng.choice(["p", "q", None]))
    before = [row() for _ in range(25)]
    after = before[4:] + [row() for _ in range(6)] + [(9, "x", 1.0, None)]
    frames = [spark.createDataFrame(r, SCHEMA).repartition(3) for r in (before, after)]
    got = sorted((tuple(r) for r in table_diff(*frames, ["k", "k2"], most).collect()), key=str)
    want = bag_diff(before, after)
    if most == 3:  # crowded keys are bags: what would be a change is a row removed and a row added
        crowded = {k for rows in (before, after) for k, n in Counter(r[:2] for r in rows).items() if n > 3}
        assert crowded
        want = sorted((x for r in want for x in ([r] if r[2] != "changed" or r[:2] not in crowded else [(*r[:2], "removed", None, 1), (*r[:2], "added", None, 1)])), key=str)
    assert got == want
    assert table_diff(frames[0], frames[0], ["k", "k2"]).count() == 0
    empty = frames[0].limit(0)
    assert {r.kind for r in table_diff(empty, frames[0], ["k", "k2"]).collect()} == {"added"} and table_diff(empty, empty, ["k", "k2"]).count() == 0


def test_one_hot_key_is_never_gathered(spark):
    before = spark.range(20_000).selectExpr("1 AS k", "cast(id % 7 AS string) AS v")
    after = spark.range(20_010).selectExpr("1 AS k", "cast(id % 7 AS string) AS v").union(spark.createDataFrame([(2, "n")], "k int, v string"))
    assert sorted(map(tuple, table_diff(before, after, ["k"]).collect()), key=str) == [(1, "added", None, 10), (2, "added", None, 1)]


def test_table_diff_gathers_no_key(spark):
    """Rows are counted by Spark before and after each shuffle: no Python call a key."""
    frame = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, `v.w` string, x double")
    later = spark.createDataFrame([(1, "a", -1.0), (2, "c", 2.0), (3, None, None)], "k int, `v.w` string, x double")
    found = table_diff(frame, later, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Arrow" not in plan and "Python" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, "changed", "x", 1), (2, "changed", "v.w,x", 1), (3, "added", None, 1)]


def test_median_deviation(spark):
    rows = [("a", v) for v in (1.0, 1.0, 2.0, 2.0, 4.0, 6.0, 9.0)] + [("a", None), ("b", None), ("c", 5.0)]
    got = {r.g: r.d for r in spark.createDataFrame(rows, "g string, v double").groupBy("g").agg(extra.median_deviation(F.col("v")).alias("d")).collect()}
    assert got == {"a": 1.0, "b": None, "c": 0.0}


def test_runs(spark):
    extra.register_runs(spark)
    rows = [(1, "a", 1), (1, "a", 2), (1, None, 3), (1, None, 4), (1, "a", 5), (2, "a", 6), (None, "z", 7)]
    frame = spark.createDataFrame(rows, "k bigint, v string, m bigint").repartition(3)
    got = spark.sql("SELECT * FROM runs(TABLE({t}) PARTITION BY k ORDER BY m)", t=frame).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", 1, 2, 2), (1, None, 3, 4, 2), (1, "a", 5, 5, 1), (2, "a", 6, 6, 1), (None, "z", 7, 7, 1)], key=str)
    assert spark.sql("SELECT * FROM runs(TABLE({t}) PARTITION BY k ORDER BY m)", t=frame.limit(0)).count() == 0


def test_colocated_join_and_grouping_have_no_exchange(spark, sf_dir):
    frame = QUERIES["colocated_orders"](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "SelectedBucketsCount: 8 out of 8" in plan


def test_buckets_follow_the_table(spark, tmp_path):
    spark.range(9_100_000).selectExpr("id % 7 AS l_orderkey", "1.0D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).selectExpr("id AS o_orderkey", "'a' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    frame = QUERIES["colocated_orders"](spark, str(tmp_path))
    assert "SelectedBucketsCount: 10 out of 10" in frame._jdf.queryExecution().executedPlan().toString()
    assert {r.n for r in frame.collect()} == {1_300_000}


def test_unwanted_years_are_not_read(spark, sf_dir):
    frame = QUERIES["pruned_years"](spark, sf_dir)
    years = {r.year for r in frame.collect()}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and 0 < len(years) < 7
    scan = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate").alias("y")).distinct().count()
    assert len(years) < scan


def test_zones_change_clocks_on_different_days(spark, sf_dir):
    apart = {r.apart: r["count"] for r in QUERIES["local_times"](spark, sf_dir).groupBy("apart").count().collect()}
    assert {360} < set(apart) <= {300, 360, 420}
    one = spark.sql("SELECT convert_timezone('UTC', 'Europe/Berlin', t) AS b FROM VALUES (TIMESTAMP_NTZ '2024-03-31 00:59:59'), (TIMESTAMP_NTZ '2024-03-31 01:00:00'), (TIMESTAMP_NTZ '2024-10-27 00:30:00'), (TIMESTAMP_NTZ '2024-10-27 01:30:00') AS x(t)")
    assert [str(r.b) for r in one.collect()] == ["2024-03-31 01:59:59", "2024-03-31 03:00:00", "2024-10-27 02:30:00", "2024-10-27 02:30:00"]
