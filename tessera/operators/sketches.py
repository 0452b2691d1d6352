"""Stored, mergeable sketches: distinct counts with set operations, quantiles and frequent items, each with the bound it keeps.

A sketch is made once for each small group (a day, a month) and stored; larger groups merge the
sketches and never read the rows again. A sketch is a few kilobytes whatever it has seen, so
merging shuffles groups times kilobytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

#: log2 of a distinct sketch's entries, and the relative standard error they give (HLL 1.04 / sqrt, theta 1 / sqrt).
LG = 12
HLL_ERROR, THETA_ERROR = 1.04 / 2 ** (LG / 2), 1.0 / 2 ** (LG / 2)
#: Rank error of a KLL sketch of the default size with 99 % confidence, for one quantile.
KLL_ERROR = 0.0165


def distinct_sketches(df: DataFrame, group: list[Column], value: str) -> DataFrame:
    """Stored HLL and theta sketches of the values of each group (nulls don't count)."""
    return durable(df.groupBy(*group).agg(F.hll_sketch_agg(value, LG).alias("hll"), F.theta_sketch_agg(value, LG).alias("theta")), "distinct-sketches")


def merged_distinct(sketches: DataFrame, group: list[Column]) -> DataFrame:
    """Estimates of larger groups by merging: (group, hll, theta) as estimated counts, and the merged theta sketch for set operations."""
    merged = sketches.groupBy(*group).agg(F.hll_union_agg("hll").alias("h"), F.theta_union_agg("theta").alias("sketch"))
    keys = [c for c in merged.columns if c not in ("h", "sketch")]
    return merged.select(*keys, F.hll_sketch_estimate("h").alias("hll"), F.theta_sketch_estimate("sketch").alias("theta"), "sketch")


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Estimated sizes of a union b, a and b, a without b, from two theta sketches."""
    return F.theta_sketch_estimate(F.theta_union(a, b)), F.theta_sketch_estimate(F.theta_intersection(a, b)), F.theta_sketch_estimate(F.theta_difference(a, b))


def within(estimate: Column, exact: Column, error: float, of: Column | None = None, deviations: float = 4) -> Column:
    """Whether an estimate lies within ``deviations`` standard errors (relative to ``of``, the exact value by default), half a unit of rounding allowed."""
    return F.abs(estimate - exact) <= deviations * error * (exact if of is None else of) + 0.5


def quantile_sketches(df: DataFrame, group: list[Column], value: str) -> DataFrame:
    """Stored KLL sketches of the values of each group (nulls don't count)."""
    return durable(df.groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("kll")), "quantile-sketches")


def merged_quantiles(sketches: DataFrame, group: list[str], shares: list[float]) -> DataFrame:
    """(group, share, estimate): quantiles of larger groups from merged sketches."""
    merged = sketches.groupBy(*group).agg(F.kll_merge_agg_double("kll").alias("kll"))
    at = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("kll", F.lit(s)).alias("estimate")) for s in shares)))
    return merged.select(*group, at.alias("q")).select(*group, "q.*")


def rank_errors(df: DataFrame, estimates: DataFrame, group: list[str], value: str) -> DataFrame:
    """``estimates`` (group, share, estimate) with ``off``, how far the share lies outside the exact ranks of its estimate (0 inside), and n, the values.

    One pass: rows meet their group's few estimates, as one array broadcast with the group; rows below and up to each are counted.
    """
    listed = estimates.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("share", "estimate"))).alias("qs"))
    rows = df.filter(F.col(value).isNotNull()).join(listed, group).select(*group, F.col(value).alias("_v"), F.explode("qs").alias("q"))
    ranks = rows.groupBy(*group, F.col("q.share").alias("share"), F.col("q.estimate").alias("estimate")).agg(F.count_if(F.col("_v") < F.col("q.estimate")).alias("below"), F.count_if(F.col("_v") <= F.col("q.estimate")).alias("upto"), F.count("*").alias("n"))
    off = F.greatest(F.col("below") / F.col("n") - F.col("share"), F.col("share") - F.col("upto") / F.col("n"), F.lit(0.0))
    return ranks.select(*group, "share", "estimate", off.alias("off"), "n")


def frequent_sketches(df: DataFrame, group: list[Column], value: str, tracked: int = 1000) -> DataFrame:
    """Stored sketches of the frequent values of each group."""
    return durable(df.groupBy(*group).agg(F.expr(f"approx_top_k_accumulate(`{value}`, {tracked})").alias("top")), "frequent-sketches")


def merged_frequent(sketches: DataFrame, group: list[str], k: int, tracked: int = 1000) -> DataFrame:
    """(group, item, count): the k most frequent values of larger groups from merged sketches."""
    merged = sketches.groupBy(*group).agg(F.expr(f"approx_top_k_combine(top, {tracked})").alias("top"))
    return merged.select(*group, F.explode(F.expr(f"approx_top_k_estimate(top, {k})")).alias("t")).select(*group, "t.*")
