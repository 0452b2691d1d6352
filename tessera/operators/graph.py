"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import drop_durable, durable


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    joined = both.filter("dst > src").join(_smallest(both), "src")
    return joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_smallest(edges), "src")
    star = joined.select(F.explode(F.array("src", "dst")).alias("src"), F.col("low").alias("dst"))
    return star.filter("src <> dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst bigint), component being its smallest node.

    Alternating large and small stars: each round shuffles the edges by node a few times
    and their number never grows, so hot nodes cost joins that adaptive execution can split,
    not one task. Each round is stored. Null ends and loops are left out.
    """
    now = edges.filter("src is not null and dst is not null and src <> dst")
    now = durable(now.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        before, now = now, durable(_small_star(_large_star(now)), "edges")
        drop_durable(before)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if seen == mark or not seen[0]:
            roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
