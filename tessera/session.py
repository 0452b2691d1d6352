"""Session factory and the folder for tables that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library's results rely on (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for an in-process master with none set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Keep the Arrow batches that this session's plans send to Python within ``most`` bytes (a longer row is a batch of its own).

    Texts have no bounded length, and a task holds a batch several times over, in the JVM and in its worker.
    A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if size > most:
        spark.conf.set(name, f"{most}b")


#: Folders of stored tables, by application.
_TABLES: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the session's durable tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it is computed once and survives lost executors.

    Results that read such a table need it until they are written; clear_durable() removes all of a session.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def drop_durable(df: DataFrame) -> None:
    """Remove one durable table that nothing reads any more, as between the rounds of an iteration."""
    path, paths = df.__dict__.pop("_stored_at", None), _TABLES.get(df.sparkSession.sparkContext.applicationId, [])
    if path in paths:
        _delete(df.sparkSession, path)
        paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_durable(spark: SparkSession) -> int:
    """Remove the session's durable tables once no result reads them any more; returns how many there were."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
