"""Column functions Spark has no single name for, from built-ins; and the ways to bring own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def skewness(c: Column) -> Column:
    """Sample skewness with the small-sample correction (null below three values or without spread)."""
    n, m = F.count(c).cast("double"), F.var_pop(c)
    return F.when((n > 2) & (m > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column) -> Column:
    """Sample excess kurtosis with the small-sample correction (null below four values or without spread)."""
    n, m = F.count(c).cast("double"), F.var_pop(c)
    return F.when((n > 3) & (m > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def entropy(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Per group the entropy in bits of a column's values (nulls count as a value)."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of the rows where neither is null."""
    known = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket of ``seconds`` since 1970 that holds ``ts``."""
    return F.timestamp_micros(F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * (seconds * 1_000_000))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision; null if either is null or the lengths differ."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def arrow_scalar(f: Callable, returns: str) -> Callable[..., Column]:
    """A function of pandas Series as a column function (Arrow batches, not rows)."""
    return F.pandas_udf(f, returns)


def register_sql(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """Make a function of pandas Series callable from SQL."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Make a class with ``eval`` callable from SQL as a table function."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f`` over an iterator of Arrow record batches of each partition."""
    return df.mapInArrow(f, schema)


def median_deviation(c: Column) -> Column:
    """Median absolute deviation from the median (nulls don't count), a pandas aggregate: a group's values are held by one task, so it is for bounded groups."""
    import pandas as pd

    def deviation(values):
        known = values.dropna()
        return float((known - known.median()).abs().median()) if len(known) else None

    # the types say that it is an aggregate; names alone could not be looked up, as pandas is imported here
    deviation.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(deviation, "double")(c.cast("double"))


class Runs:
    """Table function over a partitioned, ordered table: one row per run of equal values, with state across rows.

    Use: ``runs(TABLE(...) PARTITION BY key ORDER BY at)`` where the rows are (key, value, mark). Rows stream through, so a
    partition is never held; a null value runs with null.
    """

    def __init__(self):
        self.now = None

    def eval(self, row):
        key, value, mark = row[0], row[1], row[2]
        if self.now is not None and self.now[1] == value:
            self.now = (*self.now[:3], mark, self.now[4] + 1)
        else:
            if self.now is not None:
                yield self.now
            self.now = (key, value, mark, mark, 1)

    def terminate(self):
        if self.now is not None:
            yield self.now


def register_runs(spark: SparkSession, key_type: str = "bigint", value_type: str = "string", mark_type: str = "bigint") -> None:
    """Make Runs callable from SQL as ``runs``: (key, value, first_mark, last_mark, n)."""
    register_table_function(spark, "runs", Runs, f"key {key_type}, value {value_type}, first_mark {mark_type}, last_mark {mark_type}, n bigint")
