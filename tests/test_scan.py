"""Segmented scans against plain loops, with one job of nearly all rows."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from cuelake.operators import cues, scan, sequence

KEYS, ORDER = ["job"], ["at", "tie"]


def table(spark, n=900, seed=1, big=0.8):
    rng = random.Random(seed)
    rows = [("big" if rng.random() < big else rng.choice(["a", "b", None]), rng.choice([None, *range(n)]), k, None if rng.random() < 0.3 else rng.randint(-5, 9)) for k in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "job string, at int, tie int, v int").withColumn("count", F.lit(1)).repartition(7)


def by_job(rows):
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])
    for job, some in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        yield job, list(some)


def fold(how, values):
    there = [v for v in values if v is not None]
    return {"sum": sum, "max": max, "min": min, "last": lambda x: x[-1], "first": lambda x: x[0]}[how](there) if there else None


@pytest.mark.parametrize("frame", ["upto", "before", "all"])
@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_is_a_loop(spark, frame, parts):
    rows, df = table(spark)
    got = scan.running(df, KEYS, ORDER, {h: (h, F.col("v")) for h in scan.FOLDS}, frame, parts)
    assert sorted(got.columns) == sorted([*df.columns, *scan.FOLDS])
    found = {(r.job, r.at, r.tie): tuple(r[h] for h in scan.FOLDS) for r in got.collect()}
    assert len(found) == len(rows)
    for _, some in by_job(rows):
        v = [r[3] for r in some]
        for i, r in enumerate(some):
            upto = v[: i + 1] if frame == "upto" else v[:i] if frame == "before" else v
            assert found[r[:3]] == tuple(fold(h, upto) for h in scan.FOLDS)


def test_a_huge_job_is_cut(spark):
    _, df = table(spark, 3000, big=0.95)
    got = scan.segmented(df, KEYS, ORDER, 20).groupBy("job", scan.SEGMENT).count().collect()
    assert max(r["count"] for r in got) < 600 and len([r for r in got if r.job == "big"]) > 10
    assert scan.running(df.limit(0), KEYS, ORDER, {"s": ("sum", F.col("v"))}).count() == 0


def test_equal_order_stays_together(spark):
    df = spark.createDataFrame([("j", 1, k) for k in range(500)] + [("j", 2, k) for k in range(500)], "job string, at int, v int")
    got = scan.segmented(df, ["job"], ["at"], 8).groupBy("at").agg(F.countDistinct(scan.SEGMENT).alias("n")).collect()
    assert [r.n for r in got] == [1, 1]
    assert sorted(r.place for r in scan.placed(df, ["job"], ["at"]).collect()) == list(range(1000))


def test_trailing_sums(spark):
    rows, df = table(spark)
    got = {(r.job, r.at, r.tie): r.s for r in scan.trailing(df, KEYS, ORDER, 4, {"s": F.col("v")}, block=5, parts=9).collect()}
    assert len(got) == len(rows)
    for _, some in by_job(rows):
        for i, r in enumerate(some):
            assert got[r[:3]] == fold("sum", [x[3] for x in some[max(0, i - 3) : i + 1]])


def test_no_window_spans_a_job(spark):
    _, df = table(spark)
    plan = scan.running(df, KEYS, ORDER, {"s": ("sum", F.col("v"))}, parts=20)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all(scan.SEGMENT in line or "__of" in line for line in windows)  # __of: the summaries, one row a segment


def stream(spark, n=1200, seed=5):
    """One job of nearly all rows, and its like as many jobs' worth of samples."""
    rng = random.Random(seed)
    rows = [("big" if k % 20 else f"j{k % 7}", float(k), rng.choice([None, "", "One line here", "one line here", "Another line is said", "words of the third"]), None if rng.random() < 0.2 else sorted(rng.sample(range(4), rng.randint(0, 3))), rng.randint(0, 40)) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "job string, ts double, text string, sig array<int>, size long").repartition(5)


def answers(df, f):
    return sorted(map(str, f(df).drop(scan.SEGMENT, scan.CUTS).collect()))


def islands(df):
    rows = sequence.reuse_islands(sequence.lag_distance(df, KEYS, ["ts"], "sig"), KEYS, ["ts"], "diff", 0.5, F.col("sig").isNotNull())
    return sequence.carry_forward(rows, KEYS, ["ts"], "size", "anchor").select("job", "ts", "diff", "repeat", "island", "anchor")


CHAINS = {
    "islands": islands,
    "runs": lambda df: sequence.true_runs(df, KEYS, ["ts"], F.col("size") % 3 > 0).select("job", "start", "end"),
    "budget": lambda df: sequence.within_budget(df, KEYS, ["ts"], "size", 500).select("job", "ts", "received", "accepted"),
    "english": lambda df: sequence.english_window(df, KEYS, ["ts"], "text").select("job", "ts", "english"),
    "sessions": lambda df: cues.exact_sessions(cues.prepared(df), KEYS, 1.0).select("job", "text", "start", "end"),
}


@pytest.mark.parametrize("name", CHAINS)
def test_huge_jobs_give_the_same(spark, name):
    df = stream(spark)
    cut = scan.segmented(df, KEYS, ["ts"], 12)
    assert cut.where(f"job = 'big' and {scan.SEGMENT} > 5").count() > 100
    assert answers(cut, CHAINS[name]) == answers(scan.whole(df), CHAINS[name])


def test_identical_cues_of_a_huge_job(spark):
    df = stream(spark)
    said = cues.prepared(df).where("clean is not null").select("job", F.col("clean").alias("text"), F.col("ts").alias("start"), (F.col("ts") + 1).alias("end"))
    cut = scan.cuts(df, KEYS, ["ts"], 12)
    assert answers(cues.merge_identical(said, KEYS, cut=cut), lambda x: x) == answers(cues.merge_identical(said, KEYS), lambda x: x)


def test_neighbours(spark):
    df = stream(spark)
    got = {(r.job, r.ts): (r.a, r.b) for r in scan.beside(df, KEYS, ["ts"], {"a": (-1, F.col("text")), "b": (1, F.col("text"))}, parts=12).collect()}
    for _, some in groupby(sorted(df.collect(), key=lambda r: (r.job, r.ts)), key=lambda r: r.job):
        some = list(some)
        for k, r in enumerate(some):
            assert got[r.job, r.ts] == (some[k - 1].text if k else None, some[k + 1].text if k + 1 < len(some) else None)


@pytest.mark.parametrize("name", ["islands", "runs", "budget", "sessions"])
def test_one_job_of_all_rows_is_many_tasks(spark, name):
    df = scan.segmented(stream(spark).withColumn("job", F.lit("all")), KEYS, ["ts"], 12)
    plan = CHAINS[name](df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all(scan.SEGMENT in line or "__of" in line for line in windows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contained_cues_of_a_huge_job(spark, seed):
    rng = random.Random(seed)
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    long = " ".join(words)
    said = []
    for k in range(700):
        a = rng.randrange(12)
        said.append(rng.choice([long, "...", "another cue of some length"]) if rng.random() < 0.02 else " ".join(words[a : a + rng.randint(1, 4)]))
    said[100:420] = [" ".join(words[2:5])] * 320  # whole segments that an earlier cue takes
    said[99] = long
    big = None if seed == 3 else "big"
    rows = [(big, float(k), k + (1.0 if k % 7 else 5.0), t) for k, t in enumerate(said)] + [(j, float(k), k + 1.0, said[k]) for j in ("a", "b") for k in range(20)]
    df = spark.createDataFrame(rows, "job string, start double, end double, text string").repartition(4)
    cut = scan.cuts(df, KEYS, ["start"], 11)
    assert cut.first()[scan.CUTS] and len(cut.first()[scan.CUTS]) >= 5
    assert answers(cues.drop_contained(df, "job", cut=cut), lambda x: x) == answers(cues.drop_contained(df, "job"), lambda x: x)
