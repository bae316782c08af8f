"""Segmented scans: running values over ordered jobs of any size, a huge job spread over many tasks.

A sample of bounded size finds the jobs that hold more than a parts-th of all rows and cuts their order into segments;
every other job is one segment. Values are folded inside segments by ordinary windows. Of the cut jobs, one summary row
a segment (at most about ``parts`` in all) is scanned, and what came before a segment is joined to its rows by broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Sampled rows a segment; with parts it bounds what the driver sees.
PER_PART = 64
SEGMENT, CUTS, COARSE, WIDE = "__segment", "__cuts", "__coarse", 32
#: How each kind of value is folded over a window, and how what came before joins the value inside.
FOLDS: dict[str, Callable[..., Column]] = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True), "first": lambda v: F.first(v, ignorenulls=True)}
JOINS: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda before, own: F.coalesce(before + own, before, own),
    "max": F.greatest,
    "min": F.least,
    "last": lambda before, own: F.coalesce(own, before),
    "first": lambda before, own: F.coalesce(before, own),
}


def _same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Equality of columns in which nulls are alike, as they are in windows."""
    both = [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]
    out = both[0]
    for c in both[1:]:
        out = out & c
    return out


def cuts(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """(__key0.., __cuts, __coarse): where the jobs that hold over a parts-th of the rows are cut, at most about ``parts`` cuts in all, and every 32nd of them."""
    narrow = df.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.struct(*order).alias("__at"))
    share = PER_PART * parts / max(1, narrow.count())
    seen = narrow.sample(share, seed=7) if share < 1 else narrow
    placed = F.filter(F.array_sort(F.collect_list("__at")), lambda x, i: (i > 0) & (i % PER_PART == 0))
    hot = seen.groupBy(*narrow.columns[:-1]).agg(F.array_distinct(placed).alias(CUTS)).where(F.size(CUTS) > 0)
    hot = hot.withColumn(COARSE, F.filter(CUTS, lambda _, i: i % WIDE == WIDE - 1))
    return df.sparkSession.createDataFrame(hot.collect(), hot.schema)  # fixed from here on: a second evaluation can't cut elsewhere


def segmented(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None, cut: DataFrame | None = None) -> DataFrame:
    """df with __segment, the place of a row's segment in its job, and __cuts, null for jobs in one segment; where no job is cut, as whole().

    Rows of equal order share a segment. cut: what ``cuts`` gave for the same keys and order; without it two small jobs
    run at once, the count of the rows and the sample. The scans below take df as it is if it has these columns, and leave
    them there, so that a chain of scans samples and shuffles once.
    """
    hot = cuts(df, keys, order, parts or _parts(df)) if cut is None else cut
    if not hot.take(1):
        return whole(df)
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    rows = df.join(F.broadcast(hot), _same(df, hot, names), "left").drop(*names.values())
    at, c = F.struct(*order), F.col(CUTS)
    first = F.size(F.filter(COARSE, lambda x: x <= at)) * WIDE  # among every 32nd, then in one stretch of 32
    place = first + F.size(F.filter(F.slice(c, first + 1, WIDE), lambda x: x <= at))
    return rows.withColumn(SEGMENT, F.when(c.isNull(), F.lit(0)).otherwise(place)).drop(COARSE)


def whole(df: DataFrame) -> DataFrame:
    """df marked as one segment a job: scans are plain windows, and nothing is sampled."""
    return df.withColumn(CUTS, F.lit(None).cast("array<int>"))


def _ready(df: DataFrame, keys: list[str], order: list[str], parts: int | None) -> tuple[DataFrame, list[str], list[str]]:
    """df with its marks, the columns that its windows are dealt by, and the marks to drop afterwards."""
    rows = df if CUTS in df.columns else segmented(df, keys, order, parts)
    return rows, [*keys, *([SEGMENT] if SEGMENT in rows.columns else [])], [] if CUTS in df.columns else [SEGMENT, CUTS]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _summaries(rows: DataFrame, keys: list[str], told: list[Column]) -> tuple[DataFrame, dict[str, str]]:
    """One row a segment of the cut jobs, and the names of its keys by theirs in rows."""
    names = {k: f"__key{i}" for i, k in enumerate(keys)} | {SEGMENT: "__of"}
    return rows.where(F.col(CUTS).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(*told), names


def _across(keys: list[str]) -> WindowSpec:
    """A cut job's summaries in order."""
    return Window.partitionBy(*[f"__key{i}" for i in range(len(keys))]).orderBy("__of")


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], frame: str = "upto", parts: int | None = None) -> DataFrame:
    """df with a column for each of values (name -> (fold, value)): sum, max, min, last or first value that isn't null.

    frame: the job's rows ``upto`` and with this one, ``before`` it, or ``all``. Rows of equal order are in any order, as in
    a window. Sums of doubles are added in another order than one window would. A null key is a job like any other. An
    empty table stays empty. df is read three times (count and sample, summaries, rows): stage it if it is costly.
    """
    rows, by, marks = _ready(df, keys, order, parts)
    inner = {out: f"__value{i}" for i, out in enumerate(values)}
    rows = rows.withColumns({inner[out]: v for out, (_, v) in values.items()})
    span = {"upto": (Window.unboundedPreceding, 0), "before": (Window.unboundedPreceding, -1), "all": (Window.unboundedPreceding, Window.unboundedFollowing)}[frame]
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(*span)
    local = rows.withColumns({out: FOLDS[how](F.col(inner[out])).over(within) for out, (how, _) in values.items()}).drop(*inner.values())
    if SEGMENT not in by:
        return local.drop(*marks)

    at = F.struct(*order)
    summary = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.max_by(v, F.when(v.isNotNull(), at)), "first": lambda v: F.min_by(v, F.when(v.isNotNull(), at))}
    told, names = _summaries(rows, keys, [summary[how](F.col(inner[out])).alias(inner[out]) for out, (how, _) in values.items()])
    around = _across(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing if frame == "all" else -1)
    carry = told.select(*names.values(), *[FOLDS[how](F.col(inner[out])).over(around).alias(f"__before{i}") for i, (out, (how, _)) in enumerate(values.items())])
    joined = local.join(F.broadcast(carry), _same(local, carry, names), "left")
    both = {out: JOINS[how](F.col(f"__before{i}"), F.col(out)) if frame != "all" else F.when(F.col("__of").isNotNull(), F.col(f"__before{i}")).otherwise(F.col(out)) for i, (out, (how, _)) in enumerate(values.items())}
    return joined.withColumns(both).drop(*names.values(), *[f"__before{i}" for i in range(len(values))], *marks)


def beside(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[int, Column]], parts: int | None = None) -> DataFrame:
    """df with a column for each of values (name -> (-1 or 1, value)): the value of the row before or after, null at a job's ends."""
    rows, by, marks = _ready(df, keys, order, parts)
    inner = {out: f"__value{i}" for i, out in enumerate(values)}
    rows = rows.withColumns({inner[out]: F.struct(v.alias("v")) for out, (_, v) in values.items()})
    within, at = Window.partitionBy(*by).orderBy(*order), F.struct(*order)
    local = rows.withColumns({out: F.lag(inner[out], -step).over(within) for out, (step, _) in values.items()}).drop(*inner.values())
    if SEGMENT not in by:
        return local.withColumns({out: F.col(out)["v"] for out in values}).drop(*marks)
    told, names = _summaries(rows, keys, [(F.max_by if step < 0 else F.min_by)(inner[out], at).alias(inner[out]) for out, (step, _) in values.items()])
    edges = told.select(*names.values(), *[F.lag(inner[out], -step).over(_across(keys)).alias(f"__beside{i}") for i, (out, (step, _)) in enumerate(values.items())])
    joined = local.join(F.broadcast(edges), _same(local, edges, names), "left")
    both = {out: F.coalesce(F.col(out), F.col(f"__beside{i}"))["v"] for i, out in enumerate(values)}
    return joined.withColumns(both).drop(*names.values(), *[f"__beside{i}" for i in range(len(values))], *marks)


def first_of_run(df: DataFrame, keys: list[str], order: list[str], run: str, value: Column, out: str, parts: int | None = None) -> DataFrame:
    """df with the value of the first row of each run; run: a column that never falls along a job."""
    rows, by, marks = _ready(df, keys, order, parts)
    within = Window.partitionBy(*by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__run", F.struct(F.col(run).alias("v"))).withColumn(out, F.first(F.struct(value.alias("v"))).over(within))
    if SEGMENT not in by:
        return local.withColumn(out, F.col(out)["v"]).drop("__run", *marks)
    ends, names = _summaries(local, keys, [F.max_by(F.struct("__run", out), F.struct(*order)).alias("__end")])  # only a segment's last run goes on in the next
    names = {k: n for k, n in names.items() if k != SEGMENT} | {"__run": "__its"}
    begun = ends.groupBy(*list(names.values())[:-1], F.col("__end")["__run"].alias("__its")).agg(F.min_by(F.col("__end")[out], "__of").alias("__begun"))
    joined = local.join(F.broadcast(begun), _same(local, begun, names), "left")
    return joined.withColumn(out, F.coalesce("__begun", out)["v"]).drop("__run", "__begun", *names.values(), *marks)


def placed(df: DataFrame, keys: list[str], order: list[str], out: str = "place", parts: int | None = None) -> DataFrame:
    """df with the place of each row in its job, counted from 0."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("long"))}, parts=parts).withColumn(out, F.col(out) - 1)


def trailing(df: DataFrame, keys: list[str], order: list[str], rows: int, values: dict[str, Column], block: int = 65_536, parts: int | None = None) -> DataFrame:
    """df with the sum of each of values over a row and the rows - 1 before it.

    Huge jobs are cut into blocks of a fixed count of rows; the last rows of a block stand once more before the next one.
    """
    df, by, _ = _ready(df, keys, order, parts)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    plain = df.where(F.col(CUTS).isNull()).withColumns({out: F.sum(v).over(w) for out, v in values.items()}).drop(SEGMENT, CUTS)
    if SEGMENT not in by:
        return plain
    block = max(block, rows)
    at = placed(df.where(F.col(CUTS).isNotNull()), keys, order, "__place")
    own = F.floor(F.col("__place") / block).cast("long")
    late = F.col("__place") % block >= block - (rows - 1)
    both = at.withColumn("__own", own).withColumn("__block", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    w = Window.partitionBy(*keys, "__block").orderBy("__place").rowsBetween(1 - rows, 0)
    summed = both.withColumns({out: F.sum(v).over(w) for out, v in values.items()})
    return plain.unionByName(summed.where("__own = __block").drop("__own", "__block", "__place", SEGMENT, CUTS))
