"""Nearest vectors, sketches and samples as queries: exact results, or estimates held against the exact value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sampling, sketches, vectors
from tessera.sources.tables import read_table

QUERIES = {}
SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, vec_id AS id, list_inner_product(a, embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS INT) AS rank, id, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 10
""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return vectors.nearest(table, table.filter("vec_id % 20 = 0"), k=10).withColumn("score", F.round("score", 6))


def _year() -> Column:
    return F.year("l_shipdate").alias("year")


def _month() -> Column:
    return F.trunc("l_shipdate", "month").alias("month")


@query("SELECT year(l_shipdate)::INT AS year, count(DISTINCT l_partkey) AS parts, true AS hll_holds, true AS theta_holds FROM lineitem GROUP BY 1")
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly distinct parts from monthly sketches, within four standard errors of the exact count."""
    lines = read_table(spark, sf_dir, "lineitem")
    merged = sketches.merged_distinct(sketches.distinct_sketches(lines, [_month()], "l_partkey"), [F.year("month").alias("year")])
    exact = lines.groupBy(_year()).agg(F.count_distinct("l_partkey").alias("parts"))
    holds = lambda c, e: sketches.within(F.col(c), F.col("parts"), e)
    return exact.join(merged, "year").select("year", "parts", holds("hll", sketches.HLL_ERROR).alias("hll_holds"), holds("theta", sketches.THETA_ERROR).alias("theta_holds"))


@query("""
WITH y AS (SELECT DISTINCT year(l_shipdate)::INT AS year, l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09),
p AS (SELECT a.year, a.l_suppkey, b.l_suppkey AS later FROM y a LEFT JOIN y b ON b.year = a.year + 1 AND a.l_suppkey = b.l_suppkey)
SELECT year, count(later) AS stayed, count(*) - count(later) AS left_off, true AS stayed_holds, true AS left_holds FROM p
WHERE year < (SELECT max(year) FROM y) GROUP BY year
""")
def sketch_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of large discounted lines that come up the next year too, or don't, by intersection and difference of sketches."""
    lines = read_table(spark, sf_dir, "lineitem").filter("l_quantity > 49 AND l_discount > 0.09")
    yearly = sketches.merged_distinct(sketches.distinct_sketches(lines, [_month()], "l_suppkey"), [F.year("month").alias("year")]).select("year", "sketch")
    following = yearly.select((F.col("year") - 1).alias("year"), F.col("sketch").alias("later"))
    union, both, only = sketches.overlap(F.col("sketch"), F.col("later"))
    alone = F.theta_sketch_estimate("sketch")
    or_alone = lambda c, value: F.when(F.col("later").isNull(), value).otherwise(c)  # noqa: E731  a next year without such lines
    estimates = yearly.join(following, "year", "left").select("year", or_alone(union, alone).alias("union"), or_alone(both, F.lit(0)).alias("both"), or_alone(only, alone).alias("only"))
    last = lines.agg(F.max(_year())).first()[0]
    seen = lines.select(_year(), "l_suppkey").distinct()
    again = seen.select((F.col("year") - 1).alias("year"), "l_suppkey", F.lit(1).alias("later"))
    exact = seen.join(again, ["year", "l_suppkey"], "left").groupBy("year").agg(F.count("later").alias("stayed"), F.count_if(F.col("later").isNull()).alias("left_off"))
    holds = lambda c, e: sketches.within(F.col(c), F.col(e), sketches.THETA_ERROR, of=F.col("union"))
    return exact.filter(F.col("year") < last).join(estimates, "year").select("year", "stayed", "left_off", holds("both", "stayed").alias("stayed_holds"), holds("only", "left_off").alias("left_holds"))


@query("""
SELECT l_returnflag, share, true AS kll_holds, true AS percentile_holds FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT unnest([0.05, 0.25, 0.5, 0.9, 0.99])::DOUBLE AS share)
""")
def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of prices from monthly KLL sketches, and by approx_percentile, whose ranks lie within the stated error (and one row, for the latter) of the exact ones."""
    lines, shares = read_table(spark, sf_dir, "lineitem"), [0.05, 0.25, 0.5, 0.9, 0.99]
    made = sketches.quantile_sketches(lines, [_month(), F.col("l_returnflag")], "l_extendedprice")
    kll = sketches.rank_errors(lines, sketches.merged_quantiles(made, ["l_returnflag"], shares), ["l_returnflag"], "l_extendedprice")
    direct = lines.groupBy("l_returnflag").agg(F.approx_percentile("l_extendedprice", shares, 1000).alias("e")).select("l_returnflag", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("e").alias("estimate"))).alias("q"))
    direct = sketches.rank_errors(lines, direct.select("l_returnflag", "q.share", "q.estimate"), ["l_returnflag"], "l_extendedprice")
    a, b = kll.select("l_returnflag", "share", (F.col("off") <= sketches.KLL_ERROR).alias("kll_holds")), direct.select("l_returnflag", "share", (F.col("off") <= 1 / 1000 + 1 / F.col("n")).alias("percentile_holds"))
    return a.join(b, ["l_returnflag", "share"])


@query("""
SELECT l_linestatus, p_size AS item, count(*) AS n, true AS holds FROM lineitem JOIN part ON p_partkey = l_partkey AND l_linenumber <= p_size % 9 GROUP BY 1, 2
QUALIFY rank() OVER (PARTITION BY l_linestatus ORDER BY count(*) DESC) <= 3
""")
def frequent_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent part sizes from monthly sketches; every exact leader must be among the ten estimated ones, with its count up to the error."""
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part"), F.expr("p_partkey = l_partkey AND l_linenumber <= p_size % 9")).select("l_linestatus", "l_shipdate", F.col("p_size").alias("item"))
    made = sketches.frequent_sketches(lines, [_month(), F.col("l_linestatus")], "item")
    estimated = sketches.merged_frequent(made, ["l_linestatus"], 10).withColumnRenamed("count", "estimate")
    exact = lines.groupBy("l_linestatus", "item").agg(F.count("*").alias("n"))
    leaders = exact.withColumn("_r", F.expr("rank() OVER (PARTITION BY l_linestatus ORDER BY n DESC)")).filter("_r <= 3").drop("_r")
    return leaders.join(estimated, ["l_linestatus", "item"], "left").select("l_linestatus", "item", "n", F.coalesce(F.abs(F.col("estimate") - F.col("n")) <= 0.01 * F.col("n"), F.lit(False)).alias("holds"))


_DRAW = "((('0x' || substr(md5({key} || '#{salt}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_DRAW.format(key='o_orderkey', salt='a')} < 0.1")
def sample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 0.1, "a")


@query(f"SELECT event_id, event_type FROM events WHERE {_DRAW.format(key='event_id', salt='s')} < CASE event_type WHEN 'purchase' THEN 0.5 WHEN 'view' THEN 0.01 ELSE 0.05 END")
def sample_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(read_table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", {"purchase": 0.5, "view": 0.01}, 0.05, "s")


@query(f"""
SELECT o_orderpriority, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY -ln({_DRAW.format(key='o_orderkey', salt='w')}) / o_totalprice, o_orderkey) <= 20
""")
def sample_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty orders of each priority with chances in proportion to their price: a limit that is the feature."""
    return sampling.weighted_sample(read_table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 20, ["o_orderpriority"], "w").drop("o_totalprice")
