"""Event-time processing of an event stream with Structured Streaming.

Each function maps a frame (streaming or not) to a frame; ``run_to_table`` drives a
stream to its end. Event time must be of type timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import scratch_path


def stream_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of Parquet files, in the order of their times (to the millisecond)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(df: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Cast event time (read as UTC) and set the watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(df: DataFrame, size: str, keys: list[str], column: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` per window (sliding with ``slide``) and keys."""
    window = F.window(column, size, slide) if slide else F.window(column, size)
    return df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").alias("start"), *keys, "n", "v")


def sessions(df: DataFrame, gap: str, key: str, column: str = "ts") -> DataFrame:
    """Sessions per key; events exactly ``gap`` apart share one."""
    return df.groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicate(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key within the watermark's delay (needs a watermark)."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def interval_stream_join(left: DataFrame, right: DataFrame, key: str, seconds: int, column: str = "ts") -> DataFrame:
    """Pairs of equal key, the right row up to ``seconds`` after the left one; both sides need watermarks to bound state."""
    r = right.select(F.col(key).alias("r_key"), F.col(column).alias("r_ts"), F.col("event_id").alias("r_event_id"))
    within = (F.col("r_ts") >= F.col(column)) & (F.col("r_ts") <= F.col(column) + F.expr(f"INTERVAL {seconds} SECONDS"))
    return left.join(r, (F.col(key) == F.col("r_key")) & within).select("event_id", "r_event_id")


def outer_interval_join(left: DataFrame, right: DataFrame, key: str, seconds: int, column: str = "ts", how: str = "left_outer") -> DataFrame:
    """interval_stream_join() that keeps left rows without a match: (event_id, key, ``column``, r_event_id).

    A stream gives such a row, with a null, once the watermark has passed the last time a match could have; both
    sides need watermarks. Spark takes the smaller of two watermarks (spark.sql.streaming.multipleWatermarkPolicy=min), so
    a side that stands still holds the nulls back, and loses no match. ``how``: left_outer or inner.
    """
    if how not in ("left_outer", "inner"):
        raise ValueError(f"an interval after the left row can't be joined {how}")
    r = right.select(F.col(key).alias("r_key"), F.col(column).alias("r_ts"), F.col("event_id").alias("r_event_id"))
    within = (F.col("r_ts") >= F.col(column)) & (F.col("r_ts") <= F.col(column) + F.expr(f"INTERVAL {seconds} SECONDS"))
    return left.join(r, (F.col(key) == F.col("r_key")) & within, how).select("event_id", key, column, "r_event_id")


def match_rates(joined: DataFrame, size: str, column: str = "ts") -> DataFrame:
    """Per window of the left rows' time: pairs, and left rows without one. A second stateful operator behind the join, in append mode."""
    return joined.groupBy(F.window(column, size).alias("w")).agg(F.count("r_event_id").alias("pairs"), F.count_if(F.col("r_event_id").isNull()).alias("unmatched")).select(F.col("w.start").alias("start"), "pairs", "unmatched")


def files_per_slice(df: DataFrame, slices: int, rows: int = 250_000) -> int:
    """How many files of about ``rows`` rows a slice of ``df`` needs, so that no task's share grows with the table."""
    return max(1, -(-df.count() // (slices * rows)))


def in_slices(df: DataFrame, column: str, slices: int, files: int = 1) -> str:
    """Store a table as ``slices`` times ``files`` Parquet files, the slices of rising ``column``, for stream_files() with ``files`` files a batch; returns the folder.

    Bounds come from approximate quantiles; each slice is one write by ``files`` tasks, so that file times follow the order. A
    slice with fewer rows than files gets empty files: a batch never holds files of two slices.
    """
    spark = df.sparkSession
    path, at = scratch_path(spark, "slices"), F.unix_micros(F.col(column).cast("timestamp"))
    cuts = sorted(set((df.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000)).first()[0] or []) if slices > 1 else []))
    bounds = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = df.filter(F.coalesce(at > low, F.lit(False)) if low is not None else (at <= high) | at.isNull() if high is not None else F.lit(True))
        part = part if high is None or low is None else part.filter(at <= high)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
        for _ in range((i + 1) * files - len(spark.read.schema(df.schema).parquet(path).inputFiles()) if files > 1 else 0):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path


def running_totals(df: DataFrame, key: str) -> DataFrame:
    """Per key the count and sum of ``value`` so far, by keyed state; a row per key and batch."""
    import pandas as pd

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", "NoTimeout")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and return its rows (complete mode: the last result).

    Each batch is written by the executors to a folder of its own in the shared folder, so a
    batch that is run again replaces itself and nothing passes through the driver.
    """
    spark = stream.sparkSession
    at, done = scratch_path(spark, "stream"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{at}/out/{n}" for n in numbers))


def run_to_files(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream in append mode into Parquet files, exactly once across restarts."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
