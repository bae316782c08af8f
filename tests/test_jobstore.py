"""The job store against a dictionary, and lines numbered over many files."""

import json
import os
import random

from pyspark.sql import functions as F

from cuelake.operators import jobs
from cuelake.sources import formats
from cuelake.sources.jobstore import JobStore

SCHEMA = "id string, status string, progress double, secrets string"


def now(store):
    return {r.id: (r.status, r.progress) for r in store.jobs().collect()}


def test_it_is_a_dictionary(spark, tmp_path):
    rng, store, want, gone = random.Random(1), JobStore(spark, str(tmp_path / "s"), SCHEMA), {}, set()
    assert now(store) == {}
    kept = {}
    for step in range(14):
        ids = rng.sample("abcdefgh", rng.randint(1, 4))
        what = rng.choice(["write", "write", "write", "remove", "compact"])
        if what == "write":
            changes = [(i, rng.choice([None, "queued", "running", "done"]), rng.choice([None, float(step)]), "hidden") for i in ids]
            store.write(spark.createDataFrame(changes, SCHEMA).drop(*(["progress"] if step % 4 == 0 else [])))
            for i, status, progress, _ in changes:
                old = kept.get(i, (None, None))
                kept[i] = (old[0] if status is None else status, old[1] if progress is None or step % 4 == 0 else progress)
                gone.discard(i)
        elif what == "remove":
            store.write(spark.createDataFrame([(i,) for i in ids], "id string"), removed=True)
            for i in ids:
                kept.setdefault(i, (None, None))
                gone.add(i)
        else:
            store.compact()
        want = {i: v for i, v in kept.items() if i not in gone}
        if step % 3 == 2:
            assert now(store) == want
    assert store.compact() in (True, False) and not store.compact() and now(store) == want
    assert "hidden" not in str(store.changes().collect())


def test_compaction_can_break_off_and_late_files_fold(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"), SCHEMA)
    store.write(spark.createDataFrame([("a", "queued", 0.1, None)], SCHEMA))
    store._state()[0].write.parquet(f"{store.path}/snapshots/broken")  # no commit names it
    assert now(store) == {"a": ("queued", 0.1)}
    store.write(spark.createDataFrame([("a", "done", None, None)], SCHEMA))
    late = JobStore(spark, str(tmp_path / "late"), SCHEMA)
    late.write(spark.createDataFrame([("a", "running", 0.5, None), ("b", "queued", None, None)], SCHEMA))
    assert store.compact()
    for f in late._files():  # a file written before the compaction, with an older time, that turns up after it
        name = f.removeprefix("file:")
        there = f"{store.path}/deltas/{os.path.basename(name)}"
        os.rename(name, there)
        os.utime(there, (1_000_000_000, 1_000_000_000))
    assert now(store) == {"a": ("done", 0.1), "b": ("queued", None)}
    folded = store.folded_files()
    for f in folded:
        os.remove(f.removeprefix("file:"))
    assert folded and now(store) == {"a": ("done", 0.1), "b": ("queued", None)}


def test_scan_by_time(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"), SCHEMA)
    for k, at in enumerate((3_000, 1_000, 2_000)):
        before = set(store._files())
        store.write(spark.createDataFrame([(f"j{k}", "done", None, None)], SCHEMA))
        for f in set(store._files()) - before:
            os.utime(f.removeprefix("file:"), (at, at))
    assert [r.id for r in store.changes().collect()] == ["j1", "j2", "j0"]
    at = lambda s: F.timestamp_seconds(F.lit(s))
    assert [r.id for r in store.changes(at(2_000)).collect()] == ["j2", "j0"] and [r.id for r in store.changes(until=at(2_000)).collect()] == ["j1"]
    for name, when in (("x", 50), ("y", 20), ("z", 40)):
        (tmp_path / "jobs" / name).mkdir(parents=True)
        (tmp_path / "jobs" / name / "job.json").write_text(json.dumps({"id": name, "status": "done"}))
        os.utime(tmp_path / "jobs" / name / "job.json", (when, when))
    assert [(r.id, r.created_at) for r in formats.read_jobs(spark, str(tmp_path / "jobs")).collect()] == [("y", 20.0), ("z", 40.0), ("x", 50.0)]
    assert [r.id for r in formats.read_jobs(spark, str(tmp_path / "jobs"), at(40)).collect()] == ["z", "x"]


def test_lines_of_many_files_and_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (tmp_path / "log").mkdir()
        want = []
        for k, name in enumerate(("c", "a", "b")):
            some = [json.dumps({"timestamp": float(i), "text": f"{name} {i} \u2028 after", "reused": False}, ensure_ascii=False) if i % 5 else "{broken" for i in range(200)]
            (tmp_path / "log" / name).write_text("\n".join(some) + "\n", encoding="utf-8")
            os.utime(tmp_path / "log" / name, (100 + k, 100 + k))
            want += some
        got = formats.numbered_lines(spark, str(tmp_path / "log"))
        assert got.rdd.getNumPartitions() >= 1 and [(r.line, r.value) for r in got.orderBy("line").collect()] == list(enumerate(want, 1))
        names = formats.read_log(spark, str(tmp_path / "log"), by="name")
        assert [(r.line, r.row.text[0]) for r in names.where("row.timestamp = 1").orderBy("line").collect()] == [(2, "a"), (202, "b"), (402, "c")]
        tail = jobs.log_tail(names, "line", 3).collect()
        assert names.count() == 600 and [r.line for r in tail] == [598, 599, 600] and tail[-1].row.text.startswith("c 199")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
