"""Files as tables: videos, frames, metadata, logs that grow, accepted tokens, lookups."""

import struct
import zlib

from pyspark.sql import functions as F

from cuelake.operators import cascade, jobs
from cuelake.sources import formats


def png(height, width, level):
    """A grey picture."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes([level]) * (3 * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_videos_by_suffix_and_size(spark, tmp_path):
    for name, size in {"a.MP4": 10, "deep/b.mkv": 20, "deep/c.txt": 5, "d.rmvb": 400, "e.mp4.part": 1}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    names = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())
    assert names(formats.read_videos(spark, str(tmp_path))) == ["a.MP4", "b.mkv", "d.rmvb"]
    assert names(formats.read_videos(spark, str(tmp_path), 100)) == ["a.MP4", "b.mkv"]
    plan = formats.read_videos(spark, str(tmp_path)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # not opened unless asked for


def test_frames_by_number_with_broken_ones(spark, tmp_path):
    for k, content in {1: png(4, 6, 10), 2: b"broken", 10: png(4, 6, 200)}.items():
        (tmp_path / f"frame_{k:06}.png").write_bytes(content)
    (tmp_path / "cover.png").write_bytes(png(4, 6, 1))
    got = formats.read_frames(spark, str(tmp_path), 2.0).orderBy("frame_index").collect()
    assert [(r.frame_index, r.ts, r.readable) for r in got] == [(1, 0.0, True), (2, 0.5, False), (10, 4.5, True)]
    assert got[2].image.height == 4 and got[2].image.width == 6 and set(got[2].image.data) == {200}


def test_metadata(spark):
    rows = spark.createDataFrame([(1, 300, 30.0), (2, 0, 30.0), (3, None, 25.0), (4, 10, 0.0)], "id int, frame_count int, native_fps double")
    assert {r.id: r.duration for r in formats.with_metadata(rows).collect()} == {1: 10.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_a_log_grows_and_is_read_in_order(spark, tmp_path):
    path = str(tmp_path / "log")
    row = lambda ts, text: spark.createDataFrame([(ts, text, False, False, 0.125)], "timestamp double, text string, reused boolean, reviewed boolean, diff double")
    for k in range(3):
        formats.append_log(jobs.log_rows(row(float(k), None if k == 1 else f"t{k}"), {"crop_bottom": 0.5}), path)
    formats.append_log(jobs.log_rows(row(9.0, "x").limit(0), {}), path)
    got = formats.read_log(spark, path).orderBy("line").collect()
    assert [(r.line, r.bad, r.row.timestamp, r.row.text, r.row.empty, r.row.crop_bottom) for r in got] == [(1, False, 0.0, "t0", False, 0.5), (2, False, 1.0, "", True, 0.5), (3, False, 2.0, "t2", False, 0.5)]


def test_accepted_tokens_of_a_reading(spark):
    tokens = [("through the tightest corners", 0.99), ("LA22WNP", 0.98), ("Fun.", 0.95), ("low score here", 0.2), (None, 0.9)]
    rows = spark.createDataFrame([(1, tokens), (2, []), (3, None)], "k int, tokens array<struct<text:string,score:double>>")
    got = {r.k: r.text for r in rows.select("k", cascade.accepted_text(F.col("tokens")).alias("text")).collect()}
    assert got[1] == "through the tightest corners Fun." and got[2] == ""


def test_lookups_are_pushed_down(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("n")).write.parquet(str(tmp_path / "jobs"))
    one = spark.read.parquet(str(tmp_path / "jobs")).where("id = '42'")
    assert [tuple(r) for r in one.collect()] == [("42", 0)] and "EqualTo(id,42)" in one._jdf.queryExecution().executedPlan().toString()
