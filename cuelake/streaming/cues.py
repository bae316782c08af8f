"""Cues from an unbounded stream of samples: the same fold as in batch, its open cue held as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.operators.cues import OpenCue, prepared

OUT = "job string, text string, start double, end double"
#: Timers stand on whole seconds, so that a job's samples share them.
GRID_MS = 1000
STATE = "text string, norm string, start double, end double"


def stream_sessions(samples: DataFrame, fps: float, similarity: float, min_length: int = 2, event_time: str = "at", late: str = "1 minute", idle_ms: int = 60_000) -> DataFrame:
    """Closed cues (job, text, start, end) of a stream of (job, ts, text, event time).

    A job's rows of one trigger are folded in order of ts; a cue comes out when another sample closes it, or when the
    watermark has passed the job's last event by idle_ms. The state of a job is one open cue.
    """
    span = 1.0 / fps

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            text, _, start, end = state.get
            state.remove()
            yield pd.DataFrame([(key[0], text, start, end)] if text is not None else [], columns=["job", "text", "start", "end"])
            return
        cue = OpenCue(*state.get) if state.exists else OpenCue()
        rows = pd.concat(list(parts)).sort_values("ts")
        out = [cue.take(ts, text if isinstance(text, str) else None, norm or "", span, similarity) for ts, text, norm in zip(rows["ts"], rows["clean"], rows["norm"], strict=True)]
        state.update((cue.text, cue.norm, float(cue.start), float(cue.end)))
        last = int(pd.to_datetime(rows["event"]).max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(key[0], *c) for c in out if c], columns=["job", "text", "start", "end"])

    rows = prepared(samples, min_length).withWatermark(event_time, late).select(F.col("job").cast("string").alias("job"), "ts", "clean", "norm", F.col(event_time).alias("event"))
    return rows.groupBy("job").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


class OrderedFold(StatefulProcessor):
    """Folds a job's samples in order of time: they wait until the watermark has passed them, so a sample that comes late but not too late counts as in batch."""

    def __init__(self, span: float, similarity: float, idle_ms: int) -> None:
        self.span, self.similarity, self.idle_ms = span, similarity, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cue = handle.getValueState("cue", STATE + ", last long")
        self.waiting = handle.getListState("waiting", "ts double, clean string, norm string, event long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(float(ts), c if isinstance(c, str) else None, n if isinstance(n, str) else None, int(e)) for b in rows for ts, c, n, e in zip(b["ts"], b["clean"], b["norm"], b["event_ms"], strict=True)]
        self.waiting.appendList(new)
        for at in {-(-e // GRID_MS) * GRID_MS for *_, e in new}:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[3] <= now], [r for r in rows if r[3] > now]
        *held, last = self.cue.get() if self.cue.exists() else (None, "", 0.0, 0.0, 0)
        cue = OpenCue(*held)
        out = [c for ts, clean, norm, _ in ready if (c := cue.take(ts, clean, norm or "", self.span, self.similarity))]
        last = max([last, *(r[3] for r in ready)])
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.handle.registerTimer(-(-(last + self.idle_ms) // GRID_MS) * GRID_MS)
        if not rest and now >= last + self.idle_ms:
            if closed := cue.close():
                out.append(closed)
            self.cue.clear()
        else:
            self.cue.update((cue.text, cue.norm, float(cue.start), float(cue.end), last))
        yield pd.DataFrame([(key[0], *c) for c in out], columns=["job", "text", "start", "end"])

    def close(self) -> None:
        """Nothing is held outside the state."""


def stream_ordered_sessions(samples: DataFrame, fps: float, similarity: float, min_length: int = 2, event_time: str = "at", late: str = "1 minute", idle_ms: int = 60_000) -> DataFrame:
    """As stream_sessions, in order across triggers: the cues of a stream are those of the batch fold over all rows that weren't too late.

    A job's state is one open cue and the samples that the watermark hasn't passed. It needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass); open_cues reads it back from a checkpoint.
    """
    rows = prepared(samples, min_length).withWatermark(event_time, late).select(F.col("job").cast("string").alias("job"), "ts", "clean", "norm", event_time, F.unix_millis(event_time).alias("event_ms"))
    return rows.groupBy("job").transformWithStateInPandas(OrderedFold(1.0 / fps, similarity, idle_ms), OUT, "append", "eventtime")


def open_cues(spark: SparkSession, checkpoint: str, state: str = "cue") -> DataFrame:
    """(job, ...) of a stopped or running stream of ordered sessions: the open cues, or with ``waiting`` the samples that wait."""
    read = spark.read.format("statestore").option("stateVarName", state).load(checkpoint)
    value = "value" if state == "cue" else "list_element"
    return read.select(F.col("key.job").alias("job"), f"{value}.*")


def stream_log_counts(log: DataFrame, event_time: str, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Recognized, reused, reviewed and empty rows of a job's log in windows of event time."""
    count = lambda c, name: F.count_if(c).alias(name)
    w = F.window(event_time, window)
    return log.withWatermark(event_time, late).groupBy(w, "job").agg(F.count("*").alias("rows"), count(F.col("reused"), "reused"), count(F.col("reviewed"), "reviewed"), count(F.col("empty"), "empty"))
