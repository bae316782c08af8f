"""Reading and writing caption files, logs, job records, stream banners and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.config import VIDEO_SUFFIXES
from cuelake.operators.cues import caption_files
from cuelake.operators.jobs import without_secrets
from cuelake.operators.sequence import ordered

REGION = T.StructType([T.StructField(c, T.DoubleType()) for c in "xywh"])
LOG = T.StructType([
    T.StructField("timestamp", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("empty", T.BooleanType()), T.StructField("reused", T.BooleanType()), T.StructField("reviewed", T.BooleanType()),
    T.StructField("review_engine", T.StringType()), T.StructField("diff", T.DoubleType()), T.StructField("crop_bottom", T.DoubleType()), T.StructField("crop_region", REGION), T.StructField("crop_region_source", T.StringType()),
])
JOB = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("job_dir", T.StringType()), T.StructField("options", T.MapType(T.StringType(), T.StringType())), T.StructField("status", T.StringType()),
    T.StructField("progress", T.DoubleType()), T.StructField("phase", T.StringType()), T.StructField("message", T.StringType()), T.StructField("error", T.StringType()), T.StructField("cancel_requested", T.BooleanType()), T.StructField("created_at", T.DoubleType()),
])


def read_videos(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(path, length, ...) of video files by suffix, within a size; contents are read only where they are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ends = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in VIDEO_SUFFIXES) + ")$")
    return files.where(ends if most_bytes is None else ends & (F.col("length") <= most_bytes))


def read_frames(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """(frame_index, ts, readable, image) of ``frame_<number>`` images, by number; broken files stay as unreadable."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path)
    index = F.regexp_extract("image.origin", r"frame_(\d+)\.\w+$", 1).try_cast("long")
    return images.select(index.alias("frame_index"), ((index - 1) / fps).alias("ts"), (F.col("image.height") > 0).alias("readable"), "image").where("frame_index is not null")


def with_metadata(videos: DataFrame) -> DataFrame:
    """duration from frame_count and native_fps, 0 where either is missing."""
    known = (F.col("frame_count") > 0) & (F.col("native_fps") > 0)
    return videos.withColumn("duration", F.when(known, F.col("frame_count") / F.col("native_fps")).otherwise(F.lit(0.0)))


def parse_banner(banners: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, subtitle_index, stream_id, codec, language, title) of a media tool's stream listing."""
    lines = banners.select(*keys, F.posexplode(F.split(content, "\r\n|\n|\r")).alias("place", "line"))
    part = lambda pattern, group: F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))
    stream = r"Stream #(\d+:\d+)(?:\(([^)]+)\))?"
    rows = lines.where(F.col("line").contains("Subtitle:")).select(*keys, "place", part(stream, 1).alias("stream_id"), F.lower(part(r"Subtitle:\s*([^,\s]+)", 1)).alias("codec"), part(stream, 2).alias("language"), F.trim(part(r"(?i)title\s*:\s*(.+)$", 1)).alias("title"))
    known = rows.where("stream_id is not null and codec is not null")
    return known.withColumn("subtitle_index", F.row_number().over(ordered(keys, ["place"])) - 1).select(*keys, "subtitle_index", "stream_id", "codec", "language", "title")


def read_jobs(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Job records in ``*/job.json``, with modified, the file's time: broken files are skipped, a missing created_at is the file's time, other fields are dropped.

    In the order of the files' times. since: only files of this time or later are opened.
    """
    raw = spark.read.schema(T.StructType([*JOB.fields, T.StructField("_bad", T.StringType())])).option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(f"{path}/*/job.json")
    if since is not None:
        raw = raw.where(F.col("_metadata.file_modification_time") >= since)
    rows = raw.select(*JOB.fieldNames(), "_bad", F.col("_metadata.file_modification_time").alias("modified")).where("_bad is null and id is not null")
    return rows.withColumn("created_at", F.coalesce("created_at", F.unix_micros("modified") / 1e6)).drop("_bad").orderBy("modified", "id")


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Job records as JSON, one folder a job, secrets left out."""
    without_secrets(jobs).withColumn("job", F.col("id")).write.partitionBy("job").mode("overwrite").json(path)


def numbered_lines(spark: SparkSession, path: str, by: str = "time") -> DataFrame:
    """(line, value) of text files, line counted from 1 over all of them: files by time, then name, or by name alone.

    A first pass counts the rows of each block of a file that a task reads at once; the sums of the blocks before are joined
    back. Lines end at a line feed only, so other separators inside stay.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    block = [meta["file_path"].alias("file"), meta["file_block_start"].alias("from")]
    rows = raw.select("value", *block, meta["file_modification_time"].alias("time"), F.monotonically_increasing_id().alias("id"))
    counts = rows.groupBy("file", "from", "time").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    order = [*(["time"] if by == "time" else []), "file", "from"]
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a block
    firsts = counts.select("file", "from", (before - F.col("least") + 1).alias("shift"))
    return rows.join(firsts, ["file", "from"]).select((F.col("id") + F.col("shift")).alias("line"), "value")


def read_log(spark: SparkSession, path: str, by: str = "time") -> DataFrame:
    """(line, bad, row) of a JSON-lines log, lines numbered over all files from 1; malformed ones are kept, counted and marked."""
    lines = numbered_lines(spark, path, by)
    row = F.from_json("value", LOG)
    bad = row.isNull() | ~F.trim("value").startswith("{") | row["timestamp"].isNull()
    return lines.select("line", bad.alias("bad"), F.when(~bad, row).alias("row"))


def append_log(rows: DataFrame, path: str) -> None:
    """Add log rows as JSON lines, without running their plan first to see whether there are any."""
    rows.write.mode("append").json(path)


def write_captions(cues: DataFrame, key: str, path: str) -> None:
    """Caption and text files of every job, in one folder a job and kind; each ends in one line feed, which the writer adds. A job without cues gets no file."""
    both = caption_files(cues, [key])
    for kind in ("srt", "txt"):
        both.select(key, F.regexp_replace(kind, r"\n\z", "").alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(f"{path}/{kind}")


def read_captions(files: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, cue_no, start, end, text) of the contents of caption files."""
    blocks = files.select(*keys, F.explode(F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n{2,}")).alias("block"))
    head = r"^\s*(\d+)\n(\d+):(\d+):(\d+),(\d+) --> (\d+):(\d+):(\d+),(\d+)\n"
    part = lambda k: F.regexp_extract("block", head, k).cast("long")
    seconds = lambda k: (part(k) * 3_600_000 + part(k + 1) * 60_000 + part(k + 2) * 1000 + part(k + 3)) / 1000
    return blocks.where(F.col("block").rlike(head)).select(*keys, part(1).alias("cue_no"), seconds(2).alias("start"), seconds(6).alias("end"), F.regexp_replace(F.regexp_replace("block", head, ""), r"\n+$", "").alias("text"))
