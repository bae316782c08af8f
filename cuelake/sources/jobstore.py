"""A job table in files: deltas that are only ever added, and snapshots that fold them.

A delta holds jobs with the columns that change, null for those that stay. Order is the file's hidden modification time,
then when its writer began, then the row. A snapshot keeps, for every column of a job, the last value with its order, so that deltas that
turn up late still fold rightly. A commit row names the snapshot and the delta files in it: what has no commit doesn't
count, so a compaction that broke off, or is done twice, changes nothing.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "snapshot string, at long, folded array<string>"
AT = "struct<modified: timestamp, began: long, line: long>"


class JobStore:
    """Jobs of a schema (``id`` and columns) under a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.columns = [f.name for f in self.schema if f.name != "id"]

    def _delta_schema(self) -> T.StructType:
        return T.StructType([*self.schema, T.StructField("__removed", T.BooleanType()), T.StructField("__began", T.LongType()), T.StructField("__line", T.LongType())])

    def write(self, changes: DataFrame, removed: bool = False) -> None:
        """Add jobs, or new values of the columns that changes has; null values and absent columns change nothing. Secrets are never written.

        Of rows of one id in one call, any may count. removed: the jobs go, until one is written again.
        """
        began = time.time_ns() // 1000
        there = {c: F.col(c) for c in changes.columns if c in self.columns and c != "secrets" and not removed}
        rows = changes.where("id is not null").select("id", *[there.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema if f.name != "id"], F.lit(removed).alias("__removed"), F.lit(began).alias("__began"), F.monotonically_increasing_id().alias("__line"))
        rows.to(self._delta_schema()).write.mode("append").parquet(f"{self.path}/deltas")

    def _commit(self) -> tuple[str | None, list[str]]:
        """The last snapshot and the files in it."""
        self.spark.createDataFrame([], COMMIT).write.mode("ignore").parquet(f"{self.path}/commits")
        rows = self.spark.read.schema(COMMIT).option("listed", uuid.uuid4().hex).parquet(f"{self.path}/commits")
        last = rows.orderBy(F.desc("at"), "snapshot").limit(1).collect()
        return (last[0].snapshot, last[0].folded) if last else (None, [])

    def _files(self) -> list[str]:
        """All delta files that stand now."""
        self.spark.createDataFrame([], self._delta_schema()).write.mode("ignore").parquet(f"{self.path}/deltas")
        return sorted(self.spark.read.schema(self._delta_schema()).option("listed", uuid.uuid4().hex).parquet(f"{self.path}/deltas").inputFiles())

    def _state_schema(self) -> str:
        return "id string, " + ", ".join(f"`{c}` struct<v: {self.schema[c].dataType.simpleString() if c in self.columns else 'boolean'}, at: {AT}>" for c in [*self.columns, "__removed"])

    def _deltas(self, files: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self._delta_schema()).parquet(*files)
        return rows.withColumn("at", F.struct(F.col("_metadata.file_modification_time").alias("modified"), F.col("__began").alias("began"), F.col("__line").alias("line")))

    def _state(self) -> tuple[DataFrame, list[str], list[str]]:
        """(id, each column's last value and order), all files in it, those that the last snapshot hadn't."""
        snapshot, folded = self._commit()
        files = self._files()
        new = [f for f in files if f.rsplit("/", 1)[-1] not in set(folded)]
        told = self.spark.createDataFrame([], self._state_schema()) if snapshot is None else self.spark.read.schema(self._state_schema()).parquet(f"{self.path}/snapshots/{snapshot}")
        if new:
            rows = self._deltas(new)
            told = told.unionByName(rows.select("id", *[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), "at")).alias(c) for c in [*self.columns, "__removed"]]))
        last = [F.max_by(c, F.col(c)["at"]).alias(c) for c in [*self.columns, "__removed"]]
        return told.groupBy("id").agg(*last), sorted({*folded, *(f.rsplit("/", 1)[-1] for f in new)}), new

    def jobs(self) -> DataFrame:
        """The jobs that stand now. A job removed and written again starts from what it was."""
        state, _, _ = self._state()
        return state.where(~F.coalesce(F.col("__removed")["v"], F.lit(False))).select("id", *[F.col(c)["v"].alias(c) for c in self.columns])

    def compact(self) -> bool:
        """Fold all deltas into a new snapshot; false if there is none to fold. Deltas written meanwhile stay for the next time."""
        state, folded, new = self._state()
        if not new:
            return False
        name = uuid.uuid4().hex
        state.write.parquet(f"{self.path}/snapshots/{name}")
        self.spark.createDataFrame([(name, time.time_ns() // 1000, folded)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def folded_files(self) -> list[str]:
        """Delta files that the last snapshot holds, so that storage may drop them."""
        folded = set(self._commit()[1])
        return [f for f in self._files() if f.rsplit("/", 1)[-1] in folded]

    def changes(self, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """Deltas in the order of their files' times, from since (inclusive) to until (exclusive); files outside aren't opened."""
        rows = self.spark.read.schema(self._delta_schema()).option("listed", uuid.uuid4().hex).parquet(*self._files())
        modified = F.col("_metadata.file_modification_time")
        if since is not None:
            rows = rows.where(modified >= since)
        if until is not None:
            rows = rows.where(modified < until)
        return rows.select("id", *self.columns, F.col("__removed").alias("removed"), modified.alias("modified"), "__began", "__line").orderBy("modified", "__began", "__line").drop("__began", "__line")
