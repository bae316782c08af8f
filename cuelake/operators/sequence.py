"""Ordered-stream operators over (job, order).

Distances, islands, runs, trailing windows and budgets are segmented scans, so a job may hold any share of the rows; give
rows that ``scan.segmented`` has cut to sample and shuffle once for a chain of them. The others are windows by job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cuelake.functions.text import CJK, count_characters, strip
from cuelake.operators import scan


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    """Rows of a job in order."""
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], order: list[str]) -> WindowSpec:
    """A job's rows up to this one."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def jaccard_distance(left: Column, right: Column) -> Column:
    """1 - |A and B| / |A or B| of two position sets; 0 for two empty ones, null if either is missing."""
    union = F.size(F.array_union(left, right))
    share = F.size(F.array_intersect(left, right)) / F.nullif(union, F.lit(0))
    return F.when(left.isNotNull() & right.isNotNull(), F.when(union == 0, F.lit(0.0)).otherwise(1 - share))


def lag_distance(df: DataFrame, keys: list[str], order: list[str], signature: str, out: str = "diff") -> DataFrame:
    """The distance of each signature to the last one before it that could be read; unreadable rows (null) get null."""
    rows = scan.running(df, keys, order, {"__last": ("last", F.col(signature))}, "before")
    return rows.withColumn(out, jaccard_distance(F.col(signature), F.col("__last"))).drop("__last")


def reuse_islands(df: DataFrame, keys: list[str], order: list[str], diff: str, threshold: float, readable: Column | None = None) -> DataFrame:
    """repeat and island: a row repeats if its distance is within the threshold; every other row opens an island."""
    repeat = F.coalesce(F.col(diff) <= threshold, F.lit(False))
    opens = ~repeat if readable is None else readable & ~repeat
    return scan.running(df.withColumn("repeat", repeat), keys, order, {"island": ("sum", opens.cast("long"))})


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The value of each island's first row on all of its rows."""
    return scan.first_of_run(df, keys, order, "island", F.col(value), out)


def true_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """keys, start, end: half-open row ranges in which the flag holds, places counted from 0 in each job."""
    one = F.lit(1).cast("long")
    rows = scan.running(df.select(*[c for c in df.columns if c in {*keys, *order, scan.SEGMENT, scan.CUTS}], flag.alias("on")), keys, order, {"place": ("sum", one), "ons": ("sum", F.when(F.col("on"), one))})
    on = rows.where("on").withColumn("run", F.col("place") - F.col("ons"))
    return on.groupBy(*keys, "run").agg((F.min("place") - 1).alias("start"), F.max("place").alias("end")).drop("run")


def english_window(df: DataFrame, keys: list[str], order: list[str], text: str, rows: int = 12) -> DataFrame:
    """english: whether the last rows' texts are mostly English, from four sums over a trailing frame."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    counts = {"__rows": (t != "").cast("long"), "__letters": count_characters(t, r"[A-Za-z]+|\p{L}"), "__latin": count_characters(t, "[A-Za-zİK]+"), "__cjk": count_characters(t, f"{CJK}+")}
    c = {k: F.col(k) for k in counts}
    summed = scan.trailing(df, keys, order, rows, {k: v.cast("long") for k, v in counts.items()})
    english = (c["__rows"] >= 4) & (c["__letters"] >= 20) & (c["__latin"] >= 0.85 * c["__letters"]) & (c["__cjk"] <= 1)
    return summed.withColumn("english", english).drop(*counts)


def even_sample(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n evenly spaced rows of each job, first and last among them; all if there are no more."""
    w = ordered(keys, order)
    placed = df.withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumn("rows", F.count("*").over(Window.partitionBy(*keys)))
    if n < 2:
        return placed.where("place = 0").drop("place", "rows")
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("rows") - 1) / (n - 1)).cast("long"))
    return placed.where((F.col("rows") <= n) | F.array_contains(picks, F.col("place"))).drop("place", "rows")


def at_shares(df: DataFrame, keys: list[str], order: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The rows at the given shares of each job."""
    placed = df.withColumn("place", F.row_number().over(ordered(keys, order)) - 1).withColumn("rows", F.count("*").over(Window.partitionBy(*keys)))
    picks = F.array(*[F.floor(F.col("rows") * s).cast("int") for s in shares])
    return placed.where(F.array_contains(picks, F.col("place"))).drop("place", "rows")


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """The value at n // 2 of each job's sorted values, by rank rather than by gathering them."""
    placed = df.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(ordered(keys, [value])) - 1).withColumn("rows", F.count("*").over(Window.partitionBy(*keys)))
    return placed.where(F.col("place") == F.floor(F.col("rows") / 2)).select(*keys, F.col(value).alias(out))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "cue_no") -> DataFrame:
    """1-based numbers."""
    return df.withColumn(out, F.row_number().over(ordered(keys, order)).cast("long"))


def chunked(df: DataFrame, keys: list[str], order: list[str], size: int = 40) -> DataFrame:
    """chunk and i: blocks of a fixed count and the 1-based place in the block."""
    n = F.row_number().over(ordered(keys, order)) - 1
    return df.withColumn("chunk", F.floor(n / size).cast("long")).withColumn("i", (n % size + 1).cast("int"))


def within_budget(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """received, the running size, and accepted: whether it is still within the limit."""
    return scan.running(df, keys, order, {"received": ("sum", F.col(size))}).withColumn("accepted", F.col("received") <= limit)


def pick_stream(df: DataFrame, keys: list[str], index: str, codec: Column, language: Column, languages: list[str]) -> DataFrame:
    """One text stream of each file: by the order of languages, else the first."""
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.lower(F.coalesce(language, F.lit(""))))
    order = [F.when(place > 0, place).otherwise(F.lit(len(languages) + 1)), F.col(index)]
    return df.where(codec).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")
