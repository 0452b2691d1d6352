"""Reading the tables of a data folder through Spark's own readers (any file system Spark knows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``data_dir``; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, data_dir: str, names: list[str] | None = None) -> None:
    """Temporary views named after the tables, for SQL."""
    for name in names or TABLES:
        read_table(spark, data_dir, name).createOrReplaceTempView(name)
