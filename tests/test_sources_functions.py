import math
import statistics
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import extra
from tessera.sources import formats
from tessera.sources.tables import read_table

ROWS = [(1, "a,\"b\"\nc é", 1.5, datetime(2024, 1, 2, 3, 4, 5, 678901)), (2, None, None, None), (3, "plain", -0.25, datetime(1999, 12, 31))]
SCHEMA = "k int, s string, v double, t timestamp_ntz"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv", "xml"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, SCHEMA)
    formats.write_files(df, f"{tmp_path}/x", kind)
    assert sorted(map(tuple, formats.read_files(spark, f"{tmp_path}/x", kind, df.schema).collect())) == sorted(ROWS)


def test_text_binary_partitions(spark, tmp_path):
    formats.write_files(spark.createDataFrame([("one",), ("two",)], "value string"), f"{tmp_path}/t", "text")
    assert sorted(r.value for r in formats.read_files(spark, f"{tmp_path}/t", "text").collect()) == ["one", "two"]
    assert {bytes(r.content) for r in formats.read_binary(spark, f"{tmp_path}/t", "*.txt").collect()} >= {b"one\n"}
    formats.write_files(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/p", "parquet", partition_by=["k"])
    part = formats.read_files(spark, f"{tmp_path}/p", "parquet").filter("k = 3")
    assert part.count() == 1 and "PartitionFilters: [isnotnull(k" in part._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        formats.read_files(spark, "x", "avro")


def test_custom_source_and_schema(spark):
    df = formats.series(spark, 103, 5)
    assert df.agg(F.count("*"), F.sum("id")).first() == (103, 103 * 102 // 2)
    assert formats.require_columns(df.select("value", "bucket", "id"), df.schema).columns == df.columns
    with pytest.raises(ValueError, match="value: missing"):
        formats.require_columns(df.drop("value"), df.schema)


def test_bucketed_join_needs_no_shuffle(spark, sf_dir):
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        formats.save_bucketed(read_table(spark, sf_dir, table), f"b_{table}", [key], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("b_orders").join(spark.table("b_lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 6000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("b_orders", "b_lineitem"):
            spark.sql(f"DROP TABLE {t}")


def test_functions(spark):
    values = [1.0, 2.0, 2.5, 7.0, 11.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 1.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in df.groupBy("g").agg(extra.skewness(F.col("v")).alias("s"), extra.kurtosis(F.col("v")).alias("k"), extra.weighted_mean(F.col("v"), F.col("v")).alias("w")).collect()}
    s = pd.Series(values)
    assert math.isclose(got["a"].s, s.skew()) and math.isclose(got["a"].k, s.kurt()) and got["b"].s is None
    assert math.isclose(got["a"].w, sum(v * v for v in values) / sum(values)) and got["b"].w == 1
    assert {r.g: round(r.entropy, 6) for r in extra.entropy(df, "v", ["g"]).collect()} == {"a": round(math.log2(5), 6), "b": round(math.log2(3) - 2 / 3, 6)}
    one = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in one.select(extra.dot(F.col("a"), F.col("b"))).collect()] == [11.0, None, None]
    at = spark.createDataFrame([(datetime(2024, 1, 1, 10, 59, 59),), (datetime(1969, 12, 31, 23, 59),)], "t timestamp_ntz")
    assert [r[0] for r in at.select(extra.time_bucket(F.col("t"), 3600).cast("string")).collect()] == ["2024-01-01 10:00:00", "1969-12-31 23:00:00"]
    assert statistics.mean(values) == df.filter("g = 'a'").agg(F.avg("v")).first()[0]


def test_own_functions(spark):
    double = extra.arrow_scalar(lambda s: s * 2, "bigint")
    assert [r[0] for r in spark.range(3).select(double("id")).collect()] == [0, 2, 4]
    extra.register_sql(spark, "plus_one", lambda s: s + 1, "bigint")
    assert spark.sql("SELECT plus_one(id) AS x FROM range(2)").agg(F.sum("x")).first()[0] == 3

    class Squares:
        def eval(self, n: int):
            for i in range(n):
                yield i, i * i

    extra.register_table_function(spark, "squares", Squares, "i int, sq int")
    assert spark.sql("SELECT sum(sq) FROM squares(4)").first()[0] == 14
    assert extra.map_batches(spark.range(10), lambda batches: (b for b in batches), "id bigint").count() == 10


def test_sketches_are_near_the_exact_values(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    got = lines.agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.expr("hll_sketch_estimate(hll_sketch_agg(l_partkey))").alias("h"), F.expr("theta_sketch_estimate(theta_sketch_agg(l_orderkey))").alias("t"),
        F.approx_percentile("l_extendedprice", 0.5, 10_000).alias("p"), F.expr("kll_sketch_get_quantile_double(kll_sketch_agg_double(l_extendedprice), 0.5)").alias("k"), F.histogram_numeric("l_quantity", F.lit(5)).alias("hist"),
    ).first()
    exact = lines.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"), F.median("l_extendedprice").alias("m"), F.count("*").alias("n")).first()
    assert all(abs(x - exact.parts) <= 0.1 * exact.parts for x in (got.a, got.h)) and abs(got.t - exact.orders) <= 0.1 * exact.orders
    assert all(abs(x - exact.m) <= 0.05 * exact.m for x in (got.p, got.k))
    assert abs(sum(b.y for b in got.hist) - exact.n) < 1e-6


def test_sampling(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    n = lines.count()
    assert abs(lines.sample(fraction=0.2, seed=1).count() - 0.2 * n) < 0.05 * n
    by = {r.l_returnflag: r["count"] for r in lines.sampleBy("l_returnflag", {"A": 1.0, "N": 0.0, "R": 0.5}, 1).groupBy("l_returnflag").count().collect()}
    assert by["A"] == lines.filter("l_returnflag = 'A'").count() and "N" not in by


def test_durable_tables_are_removed(spark):
    import os

    from tessera import session

    session.clear_durable(spark)
    kept = session.durable(spark.range(10), "kept")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 10 and os.path.isdir(path)
    assert session.clear_durable(spark) == 1 and not os.path.exists(path) and session.clear_durable(spark) == 0


def test_bounded_batches(spark):
    from tessera.session import bounded_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        spark.conf.set(name, "64m")
        bounded_batches(spark, 1 << 20)
        texts = spark.range(0, 1000, 1, 1).selectExpr("repeat('x', 10000) AS t")
        found = [r.n for r in texts.mapInArrow(sizes, "n bigint").collect()]
        assert sum(found) == 1000 and max(found) <= 120
        spark.conf.set(name, "1k")
        bounded_batches(spark)
        assert spark.conf.get(name) == "1k"
    finally:
        spark.conf.set(name, before)
