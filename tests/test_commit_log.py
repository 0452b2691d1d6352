import json
import os
import time

import pytest

from tessera.sources import commit_log as cl
from tessera.streaming import events as ev
from test_streaming import SCHEMA, rows, write


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def ids(frame):
    return sorted(r.event_id for r in frame.collect())


def test_each_row_once_across_restarts(spark, tmp_path, schema):
    """The writing and the reading query are both stopped between batches and started anew."""
    data, log, out = rows(120), f"{tmp_path}/log", f"{tmp_path}/out"
    for i in range(3):
        write(spark, f"{tmp_path}/in", [data[40 * i : 40 * i + 20], data[40 * i + 20 : 40 * i + 40]])
        cl.append_to_log(ev.stream_files(spark, f"{tmp_path}/in", schema, 1), log, f"{tmp_path}/w")
        query = cl.read_log(spark, log, schema, stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/r").start()
        query.processAllAvailable()
        query.stop()
        assert ids(spark.read.parquet(out)) == list(range(40 * (i + 1)))
    assert cl.Log(log).numbers() == list(range(6))
    assert ids(cl.read_log(spark, log, schema)) == list(range(120))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, schema):
    log, state = f"{tmp_path}/log", f"{tmp_path}/w"
    write(spark, f"{tmp_path}/in", [rows(60)[:30], rows(60)[30:]])
    stream = lambda: ev.stream_files(spark, f"{tmp_path}/in", schema, 1)
    cl.append_to_log(stream(), log, state)
    before = {n: cl.Log(log).files(n) for n in cl.Log(log).numbers()}
    # as if the driver had died after the log's commit of the last batch and before Spark's own
    last = max(int(f) for f in os.listdir(f"{state}/commits") if f.isdigit())
    for f in (f"{state}/commits/{last}", f"{state}/commits/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    cl.append_to_log(stream(), log, state)
    assert {n: cl.Log(log).files(n) for n in cl.Log(log).numbers()} == before
    assert sorted(os.listdir(f"{log}/data")) == sorted(f["name"] for files in before.values() for f in files)
    assert ids(cl.read_log(spark, log, schema)) == list(range(60))


def test_a_failed_batch_leaves_no_rows(spark, tmp_path, schema):
    from pyspark.sql import functions as F

    log, data = f"{tmp_path}/log", rows(40)
    write(spark, f"{tmp_path}/in", [data[:20], data[20:]])
    stream = ev.stream_files(spark, f"{tmp_path}/in", schema, 1)
    bad = stream.withColumn("value", F.when(F.col("event_id") == 35, F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        cl.append_to_log(bad, log, f"{tmp_path}/w")
    assert ids(cl.read_log(spark, log, schema)) == list(range(20))
    cl.append_to_log(stream, log, f"{tmp_path}/w")  # mended, it goes on where it stopped
    assert ids(cl.read_log(spark, log, schema)) == list(range(40))


def test_drafts_and_stray_files_are_not_read(spark, tmp_path, schema):
    log = cl.Log(f"{tmp_path}/log")
    assert log.numbers() == [] and cl.read_log(spark, f"{tmp_path}/log", schema).count() == 0
    write(spark, f"{tmp_path}/in", [rows(10)])
    cl.append_to_log(ev.stream_files(spark, f"{tmp_path}/in", schema), f"{tmp_path}/log", f"{tmp_path}/w")
    with open(f"{tmp_path}/log/commits/1-x.draft", "w") as f:
        json.dump({"files": [{"name": "none.parquet", "rows": 1}]}, f)
    with open(f"{tmp_path}/log/data/stray.parquet", "w") as f:
        f.write("not parquet")
    assert log.numbers() == [0] and ids(cl.read_log(spark, f"{tmp_path}/log", schema)) == list(range(10))
    assert not log.commit(0, []) and log.commit(1, []) and log.numbers() == [0, 1]
    assert ids(cl.read_log(spark, f"{tmp_path}/log", schema)) == list(range(10))
    assert cl.read_log(spark, f"{tmp_path}/log", schema).select("value").columns == ["value"]


def test_writer_and_reader_run_together(spark, tmp_path, schema):
    data, log = rows(90), f"{tmp_path}/log"
    reader = cl.read_log(spark, log, schema, stream=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/r").start()
    for i in range(3):
        write(spark, f"{tmp_path}/in", [data[30 * i : 30 * i + 30]])
        cl.append_to_log(ev.stream_files(spark, f"{tmp_path}/in", schema, 1), log, f"{tmp_path}/w")
        time.sleep(0.2)
    reader.processAllAvailable()
    reader.stop()
    assert ids(spark.read.parquet(f"{tmp_path}/out")) == list(range(90))
