"""Ordered stream folds: stop, restart, late rows, and the batch's own cues; log windows."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import cues
from cuelake.streaming.cues import open_cues, stream_log_counts, stream_ordered_sessions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "job string, ts double, text string, at timestamp"
START = datetime.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drop(folder, name, rows):
    at = lambda ts: (START + datetime.timedelta(seconds=ts)).isoformat()
    (folder / name).write_text("".join(json.dumps({"job": j, "ts": ts, "text": t, "at": at(ts)}) + "\n" for j, ts, t in rows))


def run(spark, source, out, checkpoint):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    got = stream_ordered_sessions(rows, 1.0, 0.75, late="10 seconds", idle_ms=20_000)
    query = got.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def test_restart_late_rows_and_batch(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    source, out, checkpoint = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    said = [None, "one line is here", "one line is here!", "another thing", "the third of them"]
    rows = [(j, float(t), rng.choice(said)) for t in range(60) for j in ("a", "b")]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 6))  # out of order, within the watermark
    for k in range(0, len(rows), 30):
        drop(source, f"{k:03}.json", rows[k : k + 30])
        if k == 30:
            run(spark, source, out, checkpoint)
            assert {r.job for r in open_cues(spark, str(checkpoint), "waiting").collect()} == {"a", "b"}
            open_cues(spark, str(checkpoint)).collect()
    run(spark, source, out, checkpoint)
    drop(source, "900.json", [("flush", 500.0, None)])
    run(spark, source, out, checkpoint)
    drop(source, "901.json", [("a", 30.5, "far too late"), ("flush", 501.0, None)])
    run(spark, source, out, checkpoint)
    drop(source, "902.json", [("flush", 900.0, None)])
    run(spark, source, out, checkpoint)
    batch = spark.createDataFrame(rows, "job string, ts double, text string")
    want = cues.sessions(cues.prepared(batch), "job", 1.0, 0.75).collect()
    got = spark.read.parquet(str(out)).where("job <> 'flush'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10
    assert open_cues(spark, str(checkpoint)).where("job <> 'flush'").count() == 0


def test_log_windows_agree_with_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), START + datetime.timedelta(seconds=rng.randint(0, 299)), rng.random() < 0.5, rng.random() < 0.2, rng.random() < 0.3) for _ in range(400)]
    df = spark.createDataFrame(rows, "job string, at timestamp, reused boolean, reviewed boolean, empty boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_log_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "at")
    query = stream.writeStream.format("memory").queryName("log_windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    count = lambda c: F.count_if(F.col(c)).alias(c)
    want = df.groupBy(F.window("at", "1 minute"), "job").agg(F.count("*").alias("rows"), count("reused"), count("reviewed"), count("empty")).collect()
    assert sorted(map(str, spark.table("log_windows").select("window", "job", "rows", "reused", "reviewed", "empty").collect())) == sorted(map(str, want)) and len(want) == 10
