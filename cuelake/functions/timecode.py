"""Times, durations and sizes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm, half-even milliseconds, negative times as zero."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def duration_text(seconds: Column) -> Column:
    """``Ns``, ``Mm Ss`` or ``Hh Mm`` of rounded seconds."""
    s = F.bround(F.greatest(seconds, F.lit(0.0))).cast("long")
    minutes = F.floor(s / 60)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(minutes < 60, F.format_string("%dm %ds", minutes, s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(minutes / 60), minutes % 60))
    )


def clock(seconds: Column) -> Column:
    """MM:SS with unbounded minutes; halves round up."""
    s = F.floor(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) + 0.5).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def size_text(n: Column) -> Column:
    """Bytes in units of 1024, one decimal below ten but for bytes; halves round to even."""
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")])
    k = F.least(F.floor(F.log2(F.greatest(n, F.lit(1))) / 10), F.lit(3)).cast("int")
    value = n / F.pow(F.lit(1024.0), k)
    return F.when(n > 0, F.concat(F.when((value >= 10) | (k == 0), F.format_string("%.0f", F.bround(value))).otherwise(F.format_string("%.1f", F.bround(value, 1))), F.lit(" "), F.get(units, k))).otherwise(F.lit("0 B"))


def age_text(then: Column, now: Column) -> Column:
    """How long ago, each unit rounded half up from the one below; the date from thirty days on. Epoch seconds."""
    up = lambda x: F.floor(x + 0.5).cast("long")
    s = up(now - then)
    m = up(s / 60)
    h = up(m / 60)
    d = up(h / 24)
    return (
        F.when(s < 5, F.lit("just now"))
        .when(s < 60, F.format_string("%ds ago", s))
        .when(m < 60, F.format_string("%dm ago", m))
        .when(h < 24, F.format_string("%dh ago", h))
        .when(d < 30, F.format_string("%dd ago", d))
        .otherwise(F.date_format(F.timestamp_seconds(then), "yyyy-MM-dd"))
    )
