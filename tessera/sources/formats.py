"""File formats and custom sources behind one reader and one writer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Options that make a round trip exact.
OPTIONS = {
    "parquet": {},
    "orc": {},
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "csv": {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N", "emptyValue": "", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "xml": {"rowTag": "row", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "text": {},
}


def write_files(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    """Write ``df``; with ``partition_by`` in one folder per value, so that later filters skip files."""
    if kind not in OPTIONS:
        raise ValueError(f"no such format: {kind}; use one of {', '.join(OPTIONS)}")
    writer = df.write.mode(mode).format(kind).options(**OPTIONS[kind] | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_files(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Read files of a format. Give a schema for JSON, CSV and XML: inference reads all input once more."""
    if kind not in OPTIONS:
        raise ValueError(f"no such format: {kind}; use one of {', '.join(OPTIONS)}")
    reader = spark.read.format(kind).options(**OPTIONS[kind] | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "overwrite", path: str | None = None) -> None:
    """Save as a table bucketed and sorted by ``keys`` (in the warehouse, or at ``path``): joins and groupings on them then need no shuffle."""
    writer = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


class _Numbers(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.n, self.parts = int(options.get("rows", 100)), int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        cuts = [self.n * i // self.parts for i in range(self.parts + 1)]
        return [_Numbers(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]

    def read(self, partition: _Numbers) -> Iterator[tuple]:
        for i in range(partition.start, partition.end):
            yield i, i % 7, float(i * i % 1001) / 10


class SeriesSource(DataSource):
    """A custom source, ``tessera_series``: numbered rows (id, bucket, value) for load tests."""

    @classmethod
    def name(cls) -> str:
        return "tessera_series"

    def schema(self) -> str:
        return "id bigint, bucket int, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SeriesReader(self.options)


def series(spark: SparkSession, rows: int, partitions: int = 4) -> DataFrame:
    """Rows of the custom source."""
    spark.dataSource.register(SeriesSource)
    return spark.read.format("tessera_series").options(rows=rows, partitions=partitions).load()


def require_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """``df``'s columns in the order and types of ``schema``; an error names what is missing or of another type."""
    have = dict(df.dtypes)
    wrong = [f"{f.name}: {have.get(f.name, 'missing')} for {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*(F.col(f"`{f.name}`") for f in schema))
