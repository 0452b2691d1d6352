"""A log of committed batches as a streaming sink and a streaming source, ``tessera_log``.

The sink's tasks write Parquet files under new names; a batch counts once the driver has written
its manifest (one small file that names them), so a batch that runs again after a failure leaves
the log as it was, and what failed tasks left is never read. The source's offsets are numbers of
committed batches; its partitions are the files of the manifests between two offsets. Folders can be
in any file system that both Spark and pyarrow reach (local or mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "tessera_log"


class Log:
    """The folder of a log: ``data`` files and ``commits``, one manifest a batch."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" not in path and ":/" in path:  # Hadoop writes file:/x
            path = path.replace(":/", ":///", 1)
        self.fs, self.at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def numbers(self) -> list[int]:
        """The committed batches in order."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.at}/commits", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def files(self, number: int) -> list[dict]:
        with self.fs.open_input_stream(f"{self.at}/commits/{number}.json") as f:
            return json.loads(f.read())["files"]

    def commit(self, number: int, files: list[dict]) -> bool:
        """Write the manifest of a batch, unless it has one; a half-written one has another name and is never read."""
        if number in self.numbers():
            return False
        self.fs.create_dir(f"{self.at}/commits")
        draft = f"{self.at}/commits/{number}-{uuid.uuid4().hex}.draft"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files}).encode())
        self.fs.move(draft, f"{self.at}/commits/{number}.json")
        return True

    def discard(self, files: list[dict]) -> None:
        from pyarrow import fs

        for file in files:
            if self.fs.get_file_info(f"{self.at}/data/{file['name']}").type != fs.FileType.NotFound:
                self.fs.delete_file(f"{self.at}/data/{file['name']}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """One task's rows as one file, batch by batch; a task without rows writes none."""
        import pyarrow.parquet as pq

        log, name, rows, writer = Log(self.path), f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    log.fs.create_dir(f"{log.at}/data")
                    writer = pq.ParquetWriter(f"{log.at}/data/{name}", batch.schema, filesystem=log.fs)
                writer.write_batch(batch)
                rows += batch.num_rows
        if writer is not None:
            writer.close()
        return Written(name if rows else "", rows)

    def _made(self, messages: list) -> list[dict]:
        return [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.name]

    def commit(self, messages: list, batchId: int) -> None:
        log, made = Log(self.path), self._made(messages)
        if not log.commit(batchId, made):  # the batch ran before and its commit alone was lost
            log.discard(made)

    def abort(self, messages: list, batchId: int) -> None:
        Log(self.path).discard(self._made(messages))


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


def _read(path: str, columns: list[str], file: _File | None) -> Iterator:
    import pyarrow.parquet as pq

    if file is None:  # Spark asks so where there are no partitions at all
        return
    log = Log(path)
    with log.fs.open_input_file(f"{log.at}/data/{file.name}") as f:
        yield from pq.ParquetFile(f).iter_batches(batch_size=8192, columns=columns)


class _LogStream(DataSourceStreamReader):
    """Offsets are counts of committed batches; a micro-batch takes all that were committed since the last."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.columns = options["path"], schema.fieldNames()

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": len(Log(self.path).numbers())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = Log(self.path)
        return [_File(f["name"]) for n in log.numbers()[start["batches"] : end["batches"]] for f in log.files(n)]

    def read(self, partition: _File) -> Iterator:
        return _read(self.path, self.columns, partition)

    def commit(self, end: dict) -> None:
        """Read batches stay in the log: other readers have offsets of their own."""


class _LogReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.columns = options["path"], schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        log = Log(self.path)
        return [_File(f["name"]) for n in log.numbers() for f in log.files(n)]

    def read(self, partition: _File) -> Iterator:
        return _read(self.path, self.columns, partition)


class LogSource(DataSource):
    """``tessera_log``; the reader needs a schema."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the log's schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LogReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LogStream(schema, self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _LogWriter(self.options)


def read_log(spark: SparkSession, path: str, schema: StructType, stream: bool = False) -> DataFrame:
    """The committed rows of a log, as a table or as a stream."""
    spark.dataSource.register(LogSource)
    return (spark.readStream if stream else spark.read).format(NAME).schema(schema).option("path", path).load()


def append_to_log(stream: DataFrame, path: str, state: str, once: bool = True):
    """Run a stream into a log, each batch once across restarts with the same ``state`` folder; the query is returned when done (``once``) or running."""
    spark = stream.sparkSession
    spark.dataSource.register(LogSource)
    writer = stream.writeStream.format(NAME).option("path", path).option("checkpointLocation", state).outputMode("append")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
