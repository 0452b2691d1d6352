"""Samples that depend on the rows alone: the same whatever the partitions, the order of files or a task's second run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITS = 48


def draw(key: Column, salt: str = "") -> Column:
    """A number in (0, 1) from the MD5 of a key's text and a salt: 48 of its bits."""
    text = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{salt}")))
    return (F.conv(F.substring(text, 1, _BITS // 4), 16, 10).cast("bigint") + 0.5) / float(2**_BITS)


def hash_sample(df: DataFrame, key: str, share: float, salt: str = "") -> DataFrame:
    """Rows whose draw is below ``share``: a filter, no shuffle. All rows of a key go together; a larger share holds a smaller one's rows."""
    return df.filter(draw(F.col(key), salt) < share)


def stratified_sample(df: DataFrame, key: str, stratum: str, shares: dict, other: float = 0.0, salt: str = "") -> DataFrame:
    """hash_sample() with a share per value of ``stratum``; ``other`` for the rest and for null."""
    share = F.lit(float(other))
    for value, s in shares.items():
        share = F.when(F.col(stratum) == F.lit(value), F.lit(float(s))).otherwise(share)
    return df.filter(draw(F.col(key), salt) < share)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, groups: list[str] | None = None, salt: str = "", deals: int = 64) -> DataFrame:
    """``n`` rows (of each of ``groups``) drawn without replacement, each next one with chances in proportion to its weight.

    Exponential keys -ln(draw) / weight, of which the smallest win (ties: the lower ``key``). Rows of no positive
    weight, or none at all, can't be drawn. Each deal of a group keeps its ``n`` best, in every task before the shuffle
    too, and only these meet: deals times n rows a group, whatever its size.
    """
    w = F.col(weight).cast("double")
    rows = df.filter(w > 0).withColumn("_order", -F.log(draw(F.col(key), salt)) / w)
    by, order = groups or [], ["_order", key]
    rank = lambda d, *keys: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
    dealt = rank(rows.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(deals))), *by, "_deal").drop("_deal")
    if not by:
        return dealt.orderBy(*order).limit(n).drop("_order")  # at most deals times n rows
    return rank(dealt, *by).drop("_order")
