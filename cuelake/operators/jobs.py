"""The job table: state changes, recovery, recency, purge, views and log summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TERMINAL = ["done", "failed", "canceled"]
ACTIVE = ["queued", "running"]
PHASES = {"detect": 0.03, "extract": 0.05, "load": 0.12, "region": 0.10, "merge": 0.93, "correct": 0.96, "done": 1.0}
RECOVERED = {"message": "服务重启，任务中断", "error": "Server restarted while task was running."}
ARTIFACTS = {"srt": "output.srt", "txt": "output.txt", "preview": "preview.jpg", "ocr-log": "ocr_log.jsonl"}


def is_terminal(status: Column) -> Column:
    """Whether a job is over."""
    return status.isin(TERMINAL)


def latest(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The job table that a log of partial updates makes: of each column the last value that isn't null."""
    columns = [c for c in events.columns if c not in (key, seq)]
    return events.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart: jobs that ran or waited have failed."""
    lost = jobs.status.isin(ACTIVE)
    values = {"status": F.lit("failed"), "phase": F.lit("failed"), "progress": F.lit(1.0)} | {k: F.lit(v) for k, v in RECOVERED.items()}
    return jobs.withColumns({c: F.when(lost, v).otherwise(F.col(c)) for c, v in values.items() if c in jobs.columns})


def canceled(jobs: DataFrame, ask: Column) -> DataFrame:
    """The table after a request to cancel: waiting jobs end, running ones are flagged, finished ones stay."""
    waits, runs = ask & (F.col("status") == "queued"), ask & (F.col("status") == "running")
    return jobs.withColumns({
        "cancel_requested": F.col("cancel_requested") | waits | runs,
        "message": F.when(waits, F.lit("Task canceled")).when(runs, F.lit("Cancel requested")).otherwise(F.col("message")),
        "phase": F.when(waits, F.lit("canceled")).otherwise(F.col("phase")),
        "progress": F.when(waits, F.lit(1.0)).otherwise(F.col("progress")),
        "status": F.when(waits, F.lit("canceled")).otherwise(F.col("status")),
    })


def recent(jobs: DataFrame, created: str, tie: str, limit: int = 30) -> DataFrame:
    """The newest jobs, 1 to 100 of them."""
    return jobs.orderBy(F.desc(created), F.desc(tie)).limit(min(max(limit, 1), 100))


def purged(jobs: DataFrame) -> DataFrame:
    """What stays when finished jobs are cleared."""
    return jobs.where(~is_terminal(F.col("status")))


def purge_count(jobs: DataFrame) -> DataFrame:
    """How many would go."""
    return jobs.agg(F.count_if(is_terminal(F.col("status"))).alias("cleared"))


def without_secrets(jobs: DataFrame) -> DataFrame:
    """What may be written."""
    return jobs.drop("secrets")


def artifact_path(folder: Column, kind: str) -> Column:
    """Where a job's artifact lies."""
    return F.concat(folder, F.lit("/"), F.lit(ARTIFACTS[kind]))


def job_view(jobs: DataFrame) -> DataFrame:
    """The public columns, with addresses of artifacts that exist (column artifacts); results only of finished jobs."""
    def url(kind: str) -> Column:
        there = F.array_contains("artifacts", kind)
        shown = there & (F.col("status") == "done") if kind in ("srt", "txt") else there
        return F.when(shown, F.concat(F.lit("/api/jobs/"), "id", F.lit(f"/download/{kind}"))).alias(kind.replace("-", "_") + "_url")

    hidden = {"secrets", "artifacts", "job_dir"}
    return jobs.select(*[c for c in jobs.columns if c not in hidden], *[url(k) for k in ARTIFACTS])


def shown_message(jobs: DataFrame) -> Column:
    """What a job displays: stopping, else its message, else its phase."""
    stopping = F.col("cancel_requested") & ~is_terminal(F.col("status"))
    return F.when(stopping, F.lit("stopping")).otherwise(F.coalesce(F.nullif("message", F.lit("")), F.nullif("phase", F.lit("")), F.lit("")))


def progress(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """progress of a job's rows while they are read: 0.12 + 0.78 * i / n."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("progress", 0.12 + 0.78 * i / F.count("*").over(Window.partitionBy(*keys)))


def rates(done: Column, total: Column, elapsed: Column) -> Column:
    """struct(rate, remaining): rows a second so far, and the seconds that the others will take."""
    rate = done / F.greatest(elapsed, F.lit(0.001))
    return F.struct(rate.alias("rate"), F.when(rate > 0, (total - done) / rate).otherwise(F.lit(0.0)).alias("remaining"))


def inserted(events: DataFrame, jobs: DataFrame, seq: Column) -> DataFrame:
    """The event log with new jobs as first events; ``latest`` folds it into the job table."""
    return events.unionByName(jobs.withColumn("seq", seq), allowMissingColumns=True)


def log_rows(samples: DataFrame, options: dict) -> DataFrame:
    """Log rows of recognized samples (timestamp, text, reused, reviewed, diff), rounded half-even."""
    region = options.get("crop_region")
    box = F.struct(*[F.lit(float(region[k])).alias(k) for k in "xywh"]) if region else F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")
    extra = [c for c in samples.columns if c not in ("timestamp", "text", "reused", "reviewed", "diff")]
    return samples.select(
        *extra,
        F.bround("timestamp", 3).alias("timestamp"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"),
        "reused",
        "reviewed",
        F.when(F.col("reviewed"), F.lit(options.get("review_engine"))).alias("review_engine"),
        F.bround("diff", 5).alias("diff"),
        F.lit(options.get("crop_bottom")).cast("double").alias("crop_bottom"),
        box.alias("crop_region"),
        F.lit(options.get("crop_region_source")).cast("string").alias("crop_region_source"),
    )


def log_summary(log: DataFrame) -> DataFrame:
    """rows, recognized, reused, reviewed and empty rows of a log."""
    count = lambda c, name: F.count_if(c).alias(name)
    return log.agg(F.count("*").alias("rows"), count(~F.col("reused"), "recognized"), count(F.col("reused"), "reused"), count(F.col("reviewed"), "reviewed"), count(F.col("empty"), "empty"))


def log_tail(log: DataFrame, line: str, n: int = 80) -> DataFrame:
    """The last rows in order, 1 to 300."""
    return log.orderBy(F.desc(line)).limit(min(max(n, 1), 300)).orderBy(line)


def bounded_options(options: DataFrame, bounds: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Options given as text, bounds (low, high, default): what is no number takes the default, and all stay within bounds.

    A whole default asks for whole numbers.
    """
    def kept(c: str) -> Column:
        low, high, default = bounds[c]
        kind = "bigint" if isinstance(default, int) else "double"
        given = F.when(F.trim(c).rlike(r"^[+-]?\d+$") | F.lit(kind == "double"), F.trim(c)).try_cast(kind)
        return F.least(F.greatest(F.coalesce(given, F.lit(default).cast(kind)), F.lit(low).cast(kind)), F.lit(high).cast(kind))

    return options.withColumns({c: kept(c).alias(c) for c in bounds})


def checked_options(options: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Options whose numbers must lie within bounds; a value outside stops the query."""
    bad = lambda c, low, high: F.when(F.col(c).isNull() | F.col(c).between(low, high), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be between {low} and {high}")).cast(dict(options.dtypes)[c]))
    return options.withColumns({c: bad(c, low, high) for c, (low, high) in bounds.items()})
