"""Row-level difference of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_diff(before: DataFrame, after: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """(keys, kind, columns, n): what turns ``before`` into ``after``, tables of the same columns.

    Equal rows cancel out one by one. A key with one row left on both sides has ``changed``, and ``columns`` names in
    table order what differs; otherwise the rest is ``removed`` and ``added``, n rows each. Nulls equal nulls, null keys too. Rows are
    counted as bags, first by key and row, then by key, each time before the shuffle as well as after it: no key's rows are ever
    gathered. A key with over ``most`` rows in a table is reported as removed and added only.
    """
    columns = before.columns
    others = [c for c in columns if c not in keys]
    said = lambda c: F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}), F.lit(""))
    texts = F.array(*map(said, others)) if others else F.array().cast("array<string>")
    rows = lambda df, old, new: df.select(*keys, texts.alias("_row"), F.lit(old).alias("_old"), F.lit(new).alias("_new"))
    both = rows(before, 1, 0).union(rows(after.select(*(F.col(f"`{c}`") for c in columns)), 0, 1))
    bags = both.groupBy(*keys, "_row").agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    left = F.col("_old") - F.col("_new")
    found = bags.groupBy(*keys).agg(
        F.greatest(F.sum("_old"), F.sum("_new")).alias("_many"), F.sum(F.greatest(left, F.lit(0))).alias("_gone"), F.sum(F.greatest(-left, F.lit(0))).alias("_come"),
        F.max(F.when(left > 0, F.col("_row"))).alias("_was"), F.max(F.when(left < 0, F.col("_row"))).alias("_is"),
    ).filter("_gone + _come > 0")
    one = (F.col("_many") <= most) & (F.col("_gone") == 1) & (F.col("_come") == 1)
    names = F.array(*map(F.lit, others)) if others else F.array().cast("array<string>")
    differ = F.array_join(F.filter(F.zip_with(names, F.zip_with("_was", "_is", lambda x, y: x != y), lambda c, d: F.when(d, c)), lambda c: c.isNotNull()), ",")
    entry = lambda kind, columns, n: F.struct(F.lit(kind).alias("kind"), columns.alias("columns"), n.alias("n"))
    none = F.lit(None).cast("string")
    apart = F.filter(F.array(entry("removed", none, F.col("_gone")), entry("added", none, F.col("_come"))), lambda e: e["n"] > 0)
    return found.select(*keys, F.explode(F.when(one, F.array(entry("changed", differ, F.lit(1).cast("bigint")))).otherwise(apart)).alias("_e")).select(*keys, "_e.*")
