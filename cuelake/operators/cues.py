"""From timed samples to cues: similarity sessions, contained fragments, identical neighbours, caption files."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import clean_text, normalize
from cuelake.functions.timecode import srt_timestamp
from cuelake.operators import scan
from cuelake.operators.sequence import ordered
from cuelake.staging import staged

SAMPLE = "ts double, clean string, norm string"
CUE_COLUMNS = ["text", "start", "end"]
CUE = "text string, start double, end double"


def prepared(samples: DataFrame, min_length: int = 2, text: str = "text") -> DataFrame:
    """The samples with clean, their cleaned text (null: none), and norm, its compared form.

    Texts are cleaned once a row: no filter on ``clean`` is pushed through the explode of one element, where it would clean them again.
    """
    once = samples.withColumn("__once", F.explode_outer(F.array(F.struct(clean_text(F.col(text), min_length).alias("clean")))))
    return once.withColumn("clean", F.col("__once.clean")).drop("__once").withColumn("norm", normalize(F.col("clean")))


def similar(left: str, right: str, threshold: float) -> bool:
    """Whether two compared forms match; the order counts, empty ones never match. Lengths decide before letters do."""
    if not left or not right:
        return False
    if left == right:
        return threshold <= 1
    if 2 * min(len(left), len(right)) < threshold * (len(left) + len(right)):
        return False
    return SequenceMatcher(None, left, right).ratio() >= threshold


class OpenCue:
    """The cue that a job's next samples may extend; what a fold or a stream's state has to remember."""

    def __init__(self, text: str | None = None, norm: str = "", start: float = math.nan, end: float = math.nan) -> None:
        self.text, self.norm, self.start, self.end = text, norm, start, end

    def take(self, ts: float, text: str | None, norm: str, span: float, threshold: float) -> tuple[str, float, float] | None:
        """Add a sample; returns the cue that it closes."""
        done = None
        if text is None:
            if self.text is not None:
                done = self.text, self.start, max(self.end, ts)
                self.text = None
        elif self.text is not None and similar(self.norm, norm, threshold):
            self.end = ts + span
            if len(norm) > len(self.norm):
                self.text, self.norm = text, norm
        else:
            done = self.close()
            self.text, self.norm, self.start, self.end = text, norm, ts, ts + span
        return done

    def close(self) -> tuple[str, float, float] | None:
        """The open cue, if there is one."""
        done = (self.text, self.start, self.end) if self.text is not None else None
        self.text = None
        return done


def sessions(samples: DataFrame, key: str, fps: float, similarity: float) -> DataFrame:
    """(key, text, start, end): neighbours that are similar to the longest text so far make one cue.

    samples: key, ts, clean, norm as of prepared(). Each job's samples are streamed in order through one open cue, so a
    task holds a batch and not a job: rows are dealt by key, sorted, and folded across batches.
    """
    span = 1.0 / fps

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, cue = None, OpenCue()
        for b in batches:
            out = []
            for k, ts, text, norm in zip(b[key], b["ts"], b["clean"], b["norm"], strict=True):
                if k != job:
                    out.append((job, cue.close()))
                    job = k
                out.append((job, cue.take(ts, None if text is None or text != text else text, norm or "", span, similarity)))
            yield pd.DataFrame([(k, *c) for k, c in out if c], columns=[key, "text", "start", "end"])
        yield pd.DataFrame([(job, *c) for c in [cue.close()] if c], columns=[key, "text", "start", "end"])

    rows = samples.select(F.col(key).cast("string").alias(key), "ts", "clean", "norm").repartition(key).sortWithinPartitions(key, "ts")
    return _keyed_as(rows.mapInPandas(fold, f"{key} string, {CUE}"), key, samples)


def _keyed_as(cues: DataFrame, key: str, like: DataFrame) -> DataFrame:
    """Cues whose key, text in the fold so that a null stays null, has its own type again."""
    return cues.withColumn(key, F.col(key).cast(like.schema[key].dataType))


def exact_sessions(samples: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """The sessions of a threshold of one, where only equal forms match: windows alone, no Python.

    Samples that ``scan.segmented`` has cut, by keys and ts, spread a huge job over many tasks; others are windows by job.
    """
    rows = samples if scan.CUTS in samples.columns else scan.whole(samples)
    near = scan.beside(rows, keys, ["ts"], {"__norm": (-1, F.col("norm")), "__clean": (-1, F.col("clean")), "__next": (1, F.struct("clean", "ts"))})
    same = F.col("__norm").eqNullSafe(F.col("norm")) & (F.col("norm") != "") & F.col("__clean").isNotNull()
    closes = F.when(F.col("__next.clean").isNull(), F.col("__next.ts"))
    marks = [c for c in (scan.SEGMENT, scan.CUTS) if c in near.columns]
    flagged = near.select(*keys, "ts", "clean", (F.col("clean").isNotNull() & ~F.coalesce(same, F.lit(False))).cast("long").alias("opens"), closes.alias("closes"), *marks)
    grouped = scan.running(flagged.where("clean is not null"), keys, ["ts"], {"session": ("sum", F.col("opens"))})
    end = F.max(F.greatest(F.col("ts") + 1.0 / fps, F.coalesce("closes", F.col("ts") + 1.0 / fps)))
    return grouped.groupBy(*keys, "session").agg(F.min_by("clean", "ts").alias("text"), F.min("ts").alias("start"), end.alias("end")).drop("session")


def merge_identical(cues: DataFrame, keys: list[str], most_gap: float = 0.5, cut: DataFrame | None = None) -> DataFrame:
    """Neighbours with equal forms and a short gap become one cue, with the first's text and start and the last's end.

    cut: what ``scan.cuts`` gave for the samples' keys and times; it cuts the cues of huge jobs alike.
    """
    rows = scan.whole(cues) if cut is None else scan.segmented(cues, keys, ["start"], cut=cut)
    rows = rows.withColumn("__form", normalize(F.col("text")))
    near = scan.beside(rows, keys, ["start"], {"__norm": (-1, F.col("__form")), "__end": (-1, F.col("end"))})
    joins = (F.col("__norm") == F.col("__form")) & (F.col("start") - F.col("__end") <= most_gap)
    runs = scan.running(near, keys, ["start"], {"run": ("sum", (~F.coalesce(joins, F.lit(False))).cast("long"))})
    return runs.groupBy(*keys, "run").agg(F.min_by("text", "start").alias("text"), F.min("start").alias("start"), F.max_by("end", "start").alias("end")).drop("run")


def drop_contained(cues: DataFrame, key: str, share: float = 0.8, cut: DataFrame | None = None) -> DataFrame:
    """A cue whose form lies inside that of the last cue kept, and is clearly shorter, only extends it.

    cut: what ``scan.cuts`` gave for the samples' keys and times; the cues of huge jobs are then folded in segments. A cue that a
    segment's first cues lie in can only take a beginning of what the segment kept, so the segments' last cues decide the rest, in a few rounds over one row a segment.
    """
    by = [key] if cut is None else [key, scan.SEGMENT]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, kept = None, None
        for b in batches:
            out = []
            for *k, text, start, end, norm in zip(*(b[c] for c in by), b["text"], b["start"], b["end"], b["norm"], strict=True):
                if kept and k == job and norm and norm in kept[-1] and len(norm) <= len(kept[-1]) * share:
                    kept[-2] = max(kept[-2], end)
                    continue
                if kept:
                    out.append(kept)
                job, kept = k, [*k, text, start, end, norm]
            yield pd.DataFrame(out, columns=[*by, *CUE_COLUMNS, "norm"])
        yield pd.DataFrame([kept] if kept else [], columns=[*by, *CUE_COLUMNS, "norm"])

    rows = cues if cut is None else scan.segmented(cues, [key], ["start"], cut=cut)
    if scan.SEGMENT not in rows.columns:
        by = [key]
    rows = rows.select(F.col(key).cast("string").alias(key), *by[1:], *CUE_COLUMNS, normalize(F.col("text")).alias("norm")).repartition(*by).sortWithinPartitions(*by, "start")
    kept = rows.mapInPandas(fold, f"{key} string, {'' if len(by) == 1 else scan.SEGMENT + ' int, '}{CUE}, norm string")
    if len(by) > 1:
        kept = _across_segments(staged(kept, "kept-cues"), key, share)
    return _keyed_as(kept.select(key, *CUE_COLUMNS), key, cues)


def _across_segments(kept: DataFrame, key: str, share: float) -> DataFrame:
    """Cues kept inside segments, after cues of earlier segments have taken the beginnings that lie in them."""
    spark, part = kept.sparkSession, scan.SEGMENT
    many = kept.groupBy(key).agg(F.max(part).alias("most")).where("most > 0").select(F.col(key).alias("__many"))  # jobs that were cut
    cue = F.struct(F.col(part).alias("of"), "start", "norm")
    lasts = [(r[0], r[1], tuple(r[2])) for r in kept.join(many, kept[key].eqNullSafe(many["__many"]), "left_semi").groupBy(key, part).agg(F.max_by(cue, "start")).orderBy(key, part).collect()]  # one row a segment
    schema = "__key string, __part int, incoming struct<of: int, start: double, norm: string>"
    own, before = {r[:2]: r[2] for r in lasts}, {b[:2]: a[:2] for a, b in zip(lasts, lasts[1:], strict=False) if a[0] == b[0]}
    last = dict(own)
    while True:
        told = [(*at, last[prior]) for at, prior in before.items()]
        sent = spark.createDataFrame(told, schema)
        inside = F.coalesce((F.col("norm") != "") & F.contains("incoming.norm", "norm") & (F.length("norm") <= F.length("incoming.norm") * share), F.lit(False))
        rows = kept.join(F.broadcast(sent), kept[key].eqNullSafe(sent["__key"]) & (kept[part] == sent["__part"]), "left").drop("__key", "__part").withColumn("inside", inside)
        first = rows.where("incoming is not null").groupBy(key, part).agg(F.min(F.when(~F.col("inside"), F.col("start"))).alias("stays"))
        whole = {(r[0], r[1]) for r in first.where("stays is null").select(key, part).collect()}
        now = dict(own)
        for at, prior in before.items():  # in order: what took a whole segment goes on to the next
            now[at] = now[prior] if at in whole else own[at]
        if now == last:
            break
        last = now
    stays = first.select(F.col(key).alias("__key"), F.col(part).alias("__part"), F.coalesce("stays", F.lit(float("inf"))).alias("stays"))
    at = rows.join(F.broadcast(stays), rows[key].eqNullSafe(stays["__key"]) & (rows[part] == stays["__part"]), "left").drop("__key", "__part")
    at = at.withColumn("gone", F.coalesce(F.col("start") < F.col("stays"), F.lit(False)))
    longer = at.where("gone").groupBy(F.col(key).alias("__key"), F.col("incoming.of").alias("__of"), F.col("incoming.start").alias("__start")).agg(F.max("end").alias("upto"))
    own_rows = at.where("not gone")
    both = own_rows.join(F.broadcast(longer), own_rows[key].eqNullSafe(longer["__key"]) & (own_rows[part] == longer["__of"]) & (own_rows["start"] == longer["__start"]), "left")
    return both.withColumn("end", F.greatest("end", "upto"))


class ClosedCues:
    """The later passes over a job's closed cues, one by one: contained fragments extend the last cue kept, identical neighbours become one."""

    def __init__(self, share: float = 0.8, most_gap: float = 0.5) -> None:
        self.share, self.most_gap = share, most_gap
        self.kept: list | None = None  # text, norm, start, end
        self.run: list | None = None  # text, norm, start, end of the last one in it

    def _joined(self, cue: list) -> list[tuple[str, float, float]]:
        if self.run and self.run[1] == cue[1] and cue[2] - self.run[3] <= self.most_gap:
            self.run[3] = cue[3]
            return []
        done, self.run = self.run, list(cue)
        return [(done[0], done[2], done[3])] if done else []

    def take(self, text: str, norm: str, start: float, end: float) -> list[tuple[str, float, float]]:
        """Add a cue; returns those that are done."""
        if self.kept and norm and norm in self.kept[1] and len(norm) <= len(self.kept[1]) * self.share:
            self.kept[3] = max(self.kept[3], end)
            return []
        done, self.kept = self.kept, [text, norm, start, end]
        return self._joined(done) if done else []

    def close(self) -> list[tuple[str, float, float]]:
        """What is left at a job's end."""
        out = self._joined(self.kept) if self.kept else []
        out += [(self.run[0], self.run[2], self.run[3])] if self.run else []
        self.kept = self.run = None
        return out


def build_cues(samples: DataFrame, key: str, fps: float, min_length: int = 2, similarity: float = 0.72) -> DataFrame:
    """All passes: sessions, then contained fragments, then identical neighbours, in one fold over one shuffle by job.

    It gives what ``sessions``, ``drop_contained`` and ``merge_identical`` give one after another.
    """
    span = 1.0 / fps

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, cue, later = None, OpenCue(), ClosedCues()

        def ended() -> list:
            norm, last = cue.norm, cue.close()
            return (later.take(last[0], norm, *last[1:]) if last else []) + later.close()

        for b in batches:
            out = []
            for k, ts, text, norm in zip(b[key], b["ts"], b["clean"], b["norm"], strict=True):
                if k != job:
                    out += [(job, *c) for c in ended()]
                    job = k
                before = cue.norm
                if done := cue.take(ts, None if text is None or text != text else text, norm or "", span, similarity):
                    out += [(job, *c) for c in later.take(done[0], before, *done[1:])]
            yield pd.DataFrame(out, columns=[key, "text", "start", "end"])
        yield pd.DataFrame([(job, *c) for c in ended()], columns=[key, "text", "start", "end"])

    rows = prepared(samples, min_length).select(F.col(key).cast("string").alias(key), "ts", "clean", "norm").repartition(key).sortWithinPartitions(key, "ts")
    return _keyed_as(rows.mapInPandas(fold, f"{key} string, {CUE}"), key, samples)


def caption_files(cues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, srt, txt): each job's cues as the contents of a caption file and a text file."""
    w = ordered(keys, ["start"])
    block = F.concat_ws("\n", F.row_number().over(w).cast("string"), F.concat(srt_timestamp(F.col("start")), F.lit(" --> "), srt_timestamp(F.col("end"))), F.col("text"), F.lit(""))
    rows = cues.select(*keys, F.struct("start", block.alias("block"), "text").alias("row"))
    joined = lambda name: F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("row")), lambda r: r[name]))
    return rows.groupBy(*keys).agg(joined("block").alias("srt"), F.concat(joined("text"), F.lit("\n")).alias("txt"))


def plain_text(srt: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, plain): the lines of speech of caption files, blank runs as one blank line, tags off; empty for null contents. One file a key."""
    lines = srt.select(*keys, F.posexplode_outer(F.split(content, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("place", "raw"))
    line = F.trim(F.regexp_replace("raw", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    bare = F.regexp_replace(line, "<[^>]+>", "")
    kind = F.when(line == "", F.lit("blank")).when(line.rlike(r"^[\p{Nd}²³¹⁰-⁹₀-₉]+$") | line.contains("-->") | (bare == ""), F.lit("skip")).otherwise(F.lit("keep"))
    rows = lines.select(*keys, "place", bare.alias("line"), kind.alias("kind"))
    before = ordered(keys, ["place"])
    blanks = F.sum((F.col("kind") == "blank").cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.withColumn("blanks", blanks).withColumn("said", F.col("kind") == "keep")
    last = F.max(F.when(F.col("said"), F.col("blanks"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    parted = F.when(last < F.col("blanks"), F.concat(F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    pieces = counted.select(*keys, F.when(F.col("said"), F.struct("place", parted.alias("line"))).alias("row"))
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("row")), lambda r: r.line))
    return pieces.groupBy(*keys).agg(F.when(F.count("row") > 0, F.concat(joined, F.lit("\n"))).otherwise(F.lit("")).alias("plain"))
