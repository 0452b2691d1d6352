"""Relational queries over the star schema: joins, aggregates, windows, sets, subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.sources.tables import read_table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def both(name: str, sql: str, tables: str, oracle: str | None = None) -> None:
    """A query that is SQL in Spark as in the oracle; ``tables`` are its tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: read_table(spark, sf_dir, t) for t in tables.split()}
        return spark.sql(sql.format(**{t: f"{{{t}}}" for t in frames}), **frames)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = (oracle or sql).format(**{t: t for t in tables.split()})


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01'
GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '2001-01-01'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count("*").alias("n_lines"),
    )


@query("""
SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10
""")
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = read_table(spark, sf_dir, "orders").filter("o_orderdate < TIMESTAMP_NTZ '1998-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    l = read_table(spark, sf_dir, "lineitem").filter("l_shipdate > TIMESTAMP_NTZ '1998-03-15'")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    joined = l.join(o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(revenue).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


both("local_supplier_volume", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY n_name""", "customer orders lineitem supplier nation region")
both("projection_filter", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", "lineitem")
both("conditional_nulls", "SELECT o_orderstatus, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS n_large, count(nullif(o_orderpriority, '1-URGENT')) AS n_other, sum(coalesce(nullif(o_custkey % 3, 0), 10)) AS s FROM {orders} GROUP BY o_orderstatus", "orders",
     "SELECT o_orderstatus, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS n_large, count(nullif(o_orderpriority, '1-URGENT')) AS n_other, sum(coalesce(nullif(o_custkey % 3, 0), 10))::BIGINT AS s FROM {orders} GROUP BY o_orderstatus")
both("left_join_unmatched", "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey", "orders lineitem")
both("right_join", "SELECT n_name, count(s_suppkey) AS n_suppliers FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name", "supplier nation")
both("full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal < 0 GROUP BY s_nationkey) b ON a.k = b.k", "customer supplier")
both("null_safe_join", "SELECT a.k AS k, a.n AS n, b.n AS m FROM (SELECT nullif(o_custkey % 5, 0) AS k, count(*) AS n FROM {orders} GROUP BY 1) a JOIN (SELECT nullif(c_custkey % 5, 0) AS k, count(*) AS n FROM {customer} GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k", "orders customer")
both("cross_join_small", "SELECT r_name, o_orderstatus, count(*) AS n FROM {region} CROSS JOIN (SELECT DISTINCT o_orderstatus FROM {orders}) s GROUP BY r_name, o_orderstatus", "region orders")
both("semi_join", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer orders")
both("anti_join", "SELECT o_orderkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)", "orders lineitem")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT CASE WHEN l_linenumber > 0 THEN l_orderkey END FROM lineitem WHERE l_linenumber > 0)")
def null_aware_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN by shuffles: Spark plans it as a broadcast of the whole list, through the driver."""
    listed = read_table(spark, sf_dir, "lineitem").filter("l_linenumber > 0").selectExpr("CASE WHEN l_linenumber > 0 THEN l_orderkey END AS k")
    return joins.not_in(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", listed, "k")


both("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", "orders")
both("correlated_count", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM {customer}", "customer orders")
both("lateral_join", "SELECT c_custkey, t.total FROM {customer} c, LATERAL (SELECT round(sum(o_totalprice), 2) AS total FROM {orders} o WHERE o.o_custkey = c.c_custkey) t", "customer orders")
both("distinct_aggregates", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_quantity) AS DOUBLE) AS q FROM {lineitem} GROUP BY l_returnflag", "lineitem")
both("filtered_aggregates", "SELECT l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS n_high, round(avg(l_quantity) FILTER (WHERE l_tax < 0.03), 6) AS q FROM {lineitem} GROUP BY l_linestatus", "lineitem")
both("having", "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 500 AND max(l_quantity) = 50", "lineitem")
both("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", "lineitem")
both("statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(median(l_extendedprice), 4) AS md, round(corr(l_quantity, l_extendedprice), 8) AS c, round(covar_samp(l_quantity, l_tax), 8) AS cs, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM {lineitem} GROUP BY l_returnflag", "lineitem")
both("ordered_aggregates", "SELECT o_orderpriority, min_by(o_orderkey, o_orderkey) AS first_key, max_by(o_custkey, o_orderkey) AS last_customer, bool_and(o_totalprice > 0) AS all_paid, bit_xor(o_custkey) AS x, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90 FROM {orders} GROUP BY o_orderpriority", "orders")
both("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}", "customer supplier")
both("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", "customer supplier")
both("intersect_rows", "SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM {part} WHERE p_size > 25", "lineitem part")
both("intersect_all", "SELECT o_custkey % 50 AS k FROM {orders} INTERSECT ALL SELECT c_custkey % 60 FROM {customer}", "orders customer")
both("except_rows", "SELECT o_orderkey AS k FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem}", "orders lineitem")
both("except_all", "SELECT o_custkey % 50 AS k FROM {orders} EXCEPT ALL SELECT c_custkey % 60 FROM {customer}", "orders customer")
both("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30", "orders")
both("ranking_windows", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "orders",
     "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("offset_windows", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, 0.0) OVER w AS after2, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS second FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "orders")
both("running_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS quarter FROM {orders}", "orders")
both("recursive_series", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT r.n, r.f, count(*) AS nations FROM r JOIN {nation} ON n_nationkey < r.n GROUP BY r.n, r.f", "nation")
both("json_fields", "SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS s FROM {events} GROUP BY event_type", "events",
     "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS s FROM {events} GROUP BY event_type")
both("quality_by_source", "SELECT source, count(*) AS n, round(avg(quality), 6) AS good, sum(toxic) AS toxic FROM {documents} JOIN {labels} USING (doc_id) GROUP BY source", "documents labels",
     "SELECT source, count(*) AS n, round(avg(quality), 6) AS good, sum(toxic)::BIGINT AS toxic FROM {documents} JOIN {labels} USING (doc_id) GROUP BY source")
both("conversation_turns", "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, length(text) AS n FROM {conversations}", "conversations")
both("vector_norms", "SELECT label, count(*) AS n, round(avg(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x)), 4) AS norm FROM {embeddings} GROUP BY label", "embeddings",
     "SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 4) AS norm FROM {embeddings} GROUP BY label")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def pivot_status(spark, sf_dir):
    wide = read_table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.fillna(0, ["F", "O", "P"])


@query("SELECT p_partkey, 'p_size' AS measure, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_parts(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return part.unpivot("p_partkey", ["p_size", "p_retailprice"], "measure", "v")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_orders_per_customer(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


@query("""
SELECT p.event_id, p.user_id, p.ts, v.ts AS r_ts, v.event_id AS r_event_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_last_view(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    part = lambda kind: events.filter(F.col("event_type") == kind).drop("event_type")
    return joins.asof_join(part("purchase"), part("view"), "user_id", "ts", ["event_id"])


@query("""
SELECT p.event_id, p.user_id, p.ts, v.ts AS r_ts, v.event_id AS r_event_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_last_view_sliced(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    part = lambda kind: events.filter(F.col("event_type") == kind).drop("event_type")
    return joins.asof_join(part("purchase"), part("view"), "user_id", "ts", ["event_id"], slice_seconds=86_400)


@query("SELECT e.event_id, s.event_id AS r_event_id FROM events e JOIN events s ON e.user_id = s.user_id AND s.ts BETWEEN e.ts AND e.ts + INTERVAL 1 HOUR WHERE e.event_type = 'error' AND s.event_type = 'signup'")
def signups_after_errors(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    part = lambda kind: events.filter(F.col("event_type") == kind).drop("event_type")
    return joins.interval_join(part("error"), part("signup"), "user_id", "ts", 3600).select("event_id", "r_event_id")


@query("SELECT p_partkey, b.low, b.high FROM part JOIN (SELECT DISTINCT p_size::DOUBLE * 20 AS low, p_size::DOUBLE * 20 + 55 AS high FROM part ) b ON p_retailprice >= b.low AND p_retailprice < b.high")
def price_bands(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    low = F.col("p_size").cast("double") * 20
    bands = part.select(low.alias("low"), (low + 55).alias("high")).distinct()
    return joins.range_join(part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 50.0).select("p_partkey", F.col("low"), F.col("high"))


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def salted_suppliers(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    return joins.salted_join(lines, read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def deduplicated_rows(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").dropDuplicates()


@query("SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_by_name(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, sid, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, sid) GROUP BY user_id")
def session_summary(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT start, count(*) AS n, round(sum(value), 4) AS v FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start, value FROM events, (SELECT unnest(range(4)) AS k)) GROUP BY start")
def sliding_counts(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("value", F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "v")
