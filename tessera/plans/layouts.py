"""Own functions over groups and partitions, stored layouts that save shuffles and scans, collated keys and clock times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import extra
from tessera.operators.diff import table_diff
from tessera.session import scratch_path
from tessera.sources.formats import save_bucketed
from tessera.sources.tables import read_table

QUERIES = {}
SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_LATER = """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 26 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM {orders} WHERE o_orderkey % 17 <> 0
UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders} WHERE o_orderkey % 19 = 0 AND o_orderkey > 0
"""


@query(f"""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders), b AS ({_LATER.format(orders='orders')})
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS kind,
  CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN concat_ws(',', CASE WHEN a.o_totalprice <> b.o_totalprice THEN 'o_totalprice' END,
    CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END) END AS columns, CAST(1 AS BIGINT) AS n
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority
""")
def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    before = orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return table_diff(before, spark.sql(_LATER.replace("{orders}", "{t}"), t=orders), ["o_orderkey"])


@query("SELECT l_suppkey, round(mad(l_extendedprice), 4) AS deviation FROM lineitem GROUP BY l_suppkey")
def price_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(extra.median_deviation(F.col("l_extendedprice")), 4).alias("deviation"))


@query("""
SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events)
GROUP BY user_id, event_type, run
""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra.register_runs(spark)
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    found = spark.sql("SELECT * FROM runs(TABLE({rows}) PARTITION BY user_id ORDER BY event_id)", rows=rows)
    return found.select(F.col("key").alias("user_id"), F.col("value").alias("event_type"), F.col("first_mark").alias("first_id"), F.col("last_mark").alias("last_id"), "n")


@query("""
SELECT o_orderkey, o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority
""")
def colocated_orders(spark: SparkSession, sf_dir: str, buckets: int = 8) -> DataFrame:
    """Both tables stored in buckets of the order key: the join and the grouping behind it shuffle nothing.

    A task sorts a bucket, so there are as many as the line items need at about a million rows each, and ``buckets`` at least.
    """
    names, buckets = {}, max(buckets, -(-read_table(spark, sf_dir, "lineitem").count() // 1_000_000))
    for table, key, columns in (("orders", "o_orderkey", ["o_orderkey", "o_orderpriority"]), ("lineitem", "l_orderkey", ["l_orderkey", "l_quantity"])):
        names[table] = f"bucketed_{table}_{uuid.uuid4().hex}"
        save_bucketed(read_table(spark, sf_dir, table).select(*columns), names[table], [key], buckets, path=scratch_path(spark, names[table]))
    joined = spark.table(names["orders"]).join(spark.table(names["lineitem"]).hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("""
SELECT year(o_orderdate)::INT AS year, o_orderpriority, count(*) AS n FROM orders
WHERE year(o_orderdate) IN (SELECT year(l_shipdate) FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_quantity = 50) % 3 <> 0) GROUP BY 1, 2
""")
def pruned_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored in a folder per year; which years are read is known only when the other side has run."""
    path = scratch_path(spark, "orders-by-year")
    read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("year")).repartition("year").write.partitionBy("year").parquet(path)
    orders = spark.read.schema("o_orderkey bigint, o_orderpriority string, year int").parquet(path)
    wanted = read_table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count_if(F.col("l_quantity") == 50).alias("c")).filter("c % 3 <> 0").select("y")
    return orders.join(F.broadcast(wanted), F.col("year") == F.col("y")).groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"))  # one row a year


@query("""
SELECT lower(c_mktsegment) AS segment, count(*) AS n, count(DISTINCT n_name) AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
""")
def collated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and nation names that are written in mixed case meet under a collation that ignores it, in a grouping and in a join."""
    customers = read_table(spark, sf_dir, "customer").join(F.broadcast(read_table(spark, sf_dir, "nation")), F.expr("n_nationkey = c_nationkey"))
    mixed = lambda c, n: F.when(F.col("c_custkey") % n == 0, F.lower(c)).when(F.col("c_custkey") % n == 1, F.initcap(c)).otherwise(F.col(c))
    rows = customers.select(F.collate(mixed("c_mktsegment", 3), "UTF8_LCASE").alias("segment"), F.collate(mixed("n_name", 4), "UTF8_LCASE").alias("name"))
    named = read_table(spark, sf_dir, "nation").select(F.collate(F.upper("n_name"), "UTF8_LCASE").alias("name"), "n_nationkey")
    found = rows.join(named, "name").groupBy("segment").agg(F.count("*").alias("n"), F.count_distinct("name").alias("nations"))
    return found.select(F.lower(F.collate("segment", "UTF8_BINARY")).alias("segment"), "n", "nations")


@query("""
SELECT CAST(date_trunc('hour', ts) - date_trunc('day', ts) AS VARCHAR) AS slot, count(*) AS n, CAST(min(ts::TIME) AS VARCHAR)[:8] AS first, CAST(max(ts::TIME) AS VARCHAR)[:8] AS last,
  sum(date_diff('minute', date_trunc('hour', ts), date_trunc('minute', ts)))::BIGINT AS minutes FROM events GROUP BY 1
""")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic on times of day: hour slots, first and last time, minutes since the full hour. Spark's TIME type has to be switched on."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    clock = F.make_time(F.hour("ts"), F.minute("ts"), F.second("ts").cast("decimal(16,6)"))
    rows = read_table(spark, sf_dir, "events").select(clock.alias("t")).select("t", F.time_trunc(F.lit("HOUR"), "t").alias("slot"))
    text = lambda c: F.substring(c.cast("string"), 1, 8)
    found = rows.groupBy("slot").agg(F.count("*").alias("n"), text(F.min("t")).alias("first"), text(F.max("t")).alias("last"), F.sum(F.time_diff(F.lit("MINUTE"), "slot", "t")).alias("minutes"))
    return found.withColumn("slot", text(F.col("slot")))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS utc FROM orders),
z AS (SELECT *, (utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS berlin, (utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS york FROM t)
SELECT o_orderkey, berlin, york, CAST(date_diff('minute', york, berlin) AS BIGINT) AS apart, CAST(dayofyear(berlin) AS INT) AS day FROM z
""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC times in two zones whose clocks change on different days: the zones are six hours apart, five or seven round the changes."""
    utc = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    zone = lambda name: F.convert_timezone(F.lit("UTC"), F.lit(name), "utc")
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", utc.alias("utc")).select("o_orderkey", zone("Europe/Berlin").alias("berlin"), zone("America/New_York").alias("york"))
    return rows.select("*", F.timestamp_diff("MINUTE", F.col("york"), F.col("berlin")).alias("apart"), F.dayofyear("berlin").alias("day"))
