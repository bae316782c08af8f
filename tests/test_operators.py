"""Cues, windows, cascade, jobs, codecs, vision and streaming on small cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import cascade, cues, jobs, sequence, vision
from cuelake.sources import formats
from cuelake.streaming.cues import stream_sessions


def samples(spark, rows):
    return spark.createDataFrame([("j", float(t), x) for t, x in rows], "job string, ts double, text string")


def built(spark, rows, fps, similarity, min_length=2):
    return [(r.text, r.start, r.end) for r in cues.build_cues(samples(spark, rows), "job", fps, min_length, similarity).orderBy("start").collect()]


def test_similar_samples_make_cues(spark):
    got = built(spark, [(0, "Hello world"), (0.5, "Hello, world!"), (1, ""), (1.5, "Next line")], 2, 0.75)
    assert got == [("Hello world", 0, 1.0), ("Next line", 1.5, 2.0)]


def test_contained_tail_extends(spark):
    got = built(spark, [(0, "all driving scenarios and all climate conditions."), (1, ""), (2, "scenarios and all climate conditions.")], 1, 0.95)
    assert got == [("all driving scenarios and all climate conditions.", 0, 3.0)]


def test_gap_of_half_a_second_still_merges(spark):
    assert len(built(spark, [(0, "Same words"), (0.5, None), (1.0, "Same words")], 2, 0.9)) == 1
    assert len(built(spark, [(0, "Same words"), (0.5, None), (1.5, "Same words")], 2, 0.9)) == 2


def test_exact_sessions_agree_with_the_fold(spark):
    rng = random.Random(5)
    rows = [(f"j{j}", float(t), rng.choice([None, "", "one line", "other line", "...", "third"])) for j in range(30) for t in range(rng.randint(1, 12))]
    df = cues.prepared(spark.createDataFrame(rows, "job string, ts double, text string"))
    fold = sorted(map(tuple, cues.sessions(df, "job", 2.0, 1.0).collect()))
    assert fold == sorted(map(tuple, cues.exact_sessions(df, ["job"], 2.0).select("job", "text", "start", "end").collect()))


def test_one_fold_is_three_passes(spark):
    rng = random.Random(7)
    said = [None, "", "...", "all driving scenarios and all climate conditions.", "scenarios and all climate conditions.", "climate conditions.", "Another line!", "another line", "another lime", "word"]
    rows = [(rng.choice([f"j{j}", None]) if j == 3 else f"j{j}", t / 2, rng.choice(said)) for j in range(25) for t in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "job string, ts double, text string").dropDuplicates(["job", "ts"])
    one = cues.build_cues(df, "job", 2.0)
    three = cues.merge_identical(cues.drop_contained(cues.sessions(cues.prepared(df), "job", 2.0, 0.72), "job"), ["job"])
    assert sorted(map(str, one.select("job", "text", "start", "end").collect())) == sorted(map(str, three.select("job", "text", "start", "end").collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION") == 1 and plan.count("MapInPandas") == 1


def test_islands_match_a_loop(spark):
    rng = random.Random(2)
    rows = [(j, i, None if rng.random() < 0.2 else sorted(rng.sample(range(5), rng.randint(0, 3)))) for j in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "job int, i int, sig array<int>")
    got = sequence.reuse_islands(sequence.lag_distance(df, ["job"], ["i"], "sig"), ["job"], ["i"], "diff", 0.5).collect()
    before, want = {}, {}
    for j, i, s in rows:
        if s is not None:
            b = before.get(j)
            want[j, i] = b is not None and (1 - len(set(s) & set(b)) / len(set(s) | set(b)) if set(s) | set(b) else 0.0) <= 0.5
            before[j] = s
        else:
            want[j, i] = False
    assert {(r.job, r.i): r.repeat for r in got} == want


def test_captions_round_trip(spark):
    rows = spark.createDataFrame([("a", "Hello", 0.0, 1.25), ("a", "你好\nthere", 3661.2, 3662.0), ("b", "x y", 1.0, 2.0)], "job string, text string, start double, end double")
    both = cues.caption_files(rows, ["job"])
    first = both.where("job = 'b'").first()
    assert (first.srt, first.txt) == ("1\n00:00:01,000 --> 00:00:02,000\nx y\n", "x y\n")
    back = formats.read_captions(both, ["job"], "srt").select("job", "text", "start", "end")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_plain_text(spark):
    content = "1\n00:00:00,000 --> 00:00:01,000\n你好，世界\n\n2\n00:00:01,000 --> 00:00:02,000\n<i>Second line</i>\n"
    got = cues.plain_text(spark.createDataFrame([(1, content), (2, "")], "k int, c string"), ["k"], "c")
    assert {r.k: r.plain for r in got.collect()} == {1: "你好，世界\n\nSecond line\n", 2: ""}


def test_stream_pick(spark):
    from cuelake.functions import config

    rows = spark.createDataFrame([("f", 0, "hdmv_pgs", "eng"), ("f", 1, "subrip", "eng"), ("f", 2, "mov_text", "zho"), ("g", 0, "hdmv_pgs", "eng")], "file string, i int, codec string, language string")
    got = sequence.pick_stream(rows, ["file"], "i", config.is_text_codec(F.col("codec")), F.col("language"), config.LANGUAGE_ORDER)
    assert [(r.file, r.i) for r in got.collect()] == [("f", 2)]


def called(df):
    """How many passes of a recognizer a plan holds."""
    return df._jdf.queryExecution().executedPlan().toString().count("MapInPandas")


def test_recognizer_runs_on_anchors_only(spark):
    rows = spark.createDataFrame([(1, i, i // 3, i % 3 != 0) for i in range(12)], "job int, i int, island int, repeat boolean").withColumn("image", F.col("island"))

    def make():
        told = []

        def call(xs):
            told.extend(xs)
            return [f"t{x}:{told.count(x)}" for x in xs]

        return call

    got = cascade.recognize_anchors(rows.coalesce(1), ["job"], ["i"], "image", "anchors", make).collect()
    assert {(r.i, r.text) for r in got} == {(i, f"t{i // 3}:1") for i in range(12)}  # no image was read twice


def test_makers_and_languages_of_one_name(spark):
    rows = spark.createDataFrame([(1, "x")], "i int, image string").coalesce(1)
    says = lambda prefix: lambda: lambda xs: [prefix + x for x in xs]
    read = lambda make, language="": cascade.recognize(rows, "image", "text", "one", make, language=language).first().text
    assert [read(says("a")), read(says("b")), read(says("a"), "en")] == ["ax", "bx", "ax"]


def test_review_and_retry(spark):
    rows = spark.createDataFrame([(0, "thewordthatdefinesthelimits.", "the word that defines the limits."), (1, "LA22WNP", "LA22 WNP"), (2, "plain words here", "never asked")], "i int, text string, image string")
    reviewed = cascade.review(rows, "text", "image", "echo", lambda: list)
    assert {r.i: (r.text, r.reviewed) for r in reviewed.collect()} == {0: ("the word that defines the limits.", True), 1: ("", False), 2: ("plain words here", False)}
    first = cascade.recognize(rows, "image", "text2", "echo", lambda: list)
    assert called(cascade.review(first, "text2", "image", "echo", lambda: list)) == 2
    crops = spark.createDataFrame([(0, "", "second", "x"), (1, "first", "second", "x"), (2, None, None, "third"), (3, " ", "", "third")], "i int, a string, b string, c string")
    tried = cascade.recognize_with_retry(crops, ["a", "b", "c"], "echo", lambda: list, F.col("i") != 3)
    assert {r.i: r.text for r in tried.collect()} == {0: "second", 1: "first", 2: "third", 3: " "} and called(tried) == 1


def test_null_keys_keep_their_cues(spark):
    rows = spark.createDataFrame([(None, 0.0, "one line"), (2**60 + 1, 0.0, "one line"), (None, 1.0, "one line")], "job long, ts double, text string")
    got = sorted((r.job is None, r.job, r.start, r.end) for r in cues.build_cues(rows, "job", 1.0).collect())
    assert got == [(False, 2**60 + 1, 0.0, 1.0), (True, None, 0.0, 2.0)]


def test_caption_files_end_in_one_line_feed(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x y", 0.0, 1.0), ("a", "z w", 2.0, 3.0)], "job string, text string, start double, end double")
    formats.write_captions(rows, "job", str(tmp_path / "c"))
    read = {p.parts[-3]: p.read_text() for p in (tmp_path / "c").rglob("*.txt")}
    assert read == {"srt": "1\n00:00:00,000 --> 00:00:01,000\nx y\n\n2\n00:00:02,000 --> 00:00:03,000\nz w\n", "txt": "x y\nz w\n"}


def test_bounded_options_and_inserts(spark):
    df = spark.createDataFrame([("3", "x"), ("2.5", " 0.5 "), (None, "-1"), ("99", "2")], "workers string, gb string")
    got = jobs.bounded_options(df, {"workers": (1, 8, 2), "gb": (0.1, 64.0, 4.5)}).collect()
    assert [tuple(r) for r in got] == [(3, 4.5), (2, 0.5), (2, 0.1), (8, 2.0)]
    events = spark.createDataFrame([("a", 1, "queued", None)], "id string, seq long, status string, phase string")
    log = jobs.inserted(events, spark.createDataFrame([("b", "queued")], "id string, status string"), F.lit(2).cast("long"))
    assert {(r.id, r.status) for r in jobs.latest(log, "id", "seq").collect()} == {("a", "queued"), ("b", "queued")}


def test_corrections(spark):
    rows = spark.createDataFrame([("j", f"line {k}", float(k), k + 1.0) for k in range(45)], "job string, text string, start double, end double")
    got = cascade.correct(rows, ["job"], lambda request: '{"items":[{"i":1,"text":"fixed"}]}').collect()
    assert sorted(r.start for r in got if r.text == "fixed") == [0.0, 40.0]
    assert cascade.correct(rows, ["job"], None) is rows

    def fails(request):
        raise OSError("no network")

    assert sorted(map(tuple, cascade.correct(rows, ["job"], fails).select("text", "start").collect())) == sorted((f"line {k}", float(k)) for k in range(45))
    assert cascade.flattened([[[[0, 0]], "hello", "0.9"]]) == [{"text": "hello", "score": 0.9}]
    assert cascade.flattened({"rec_texts": ["a", "b"], "rec_scores": [1, 0.5]}) == [{"text": "a", "score": 1.0}, {"text": "b", "score": 0.5}]


def test_job_states(spark, tmp_path):
    rows = [("a", "queued"), ("b", "running"), ("c", "done")]
    df = spark.createDataFrame([(i, s, 0.5, "p", "m", None, False, "key") for i, s in rows], "id string, status string, progress double, phase string, message string, error string, cancel_requested boolean, secrets string")
    assert {r.id: r.status for r in jobs.recovered(df).collect()} == {"a": "failed", "b": "failed", "c": "done"}
    stopped = {r.id: (r.status, r.cancel_requested) for r in jobs.canceled(df, F.lit(True)).collect()}
    assert stopped == {"a": ("canceled", True), "b": ("running", True), "c": ("done", False)}
    assert {r.id for r in jobs.purged(df).collect()} == {"a", "b"}
    view = jobs.job_view(df.withColumn("artifacts", F.array(F.lit("srt"), F.lit("preview")))).collect()
    assert {r.id: (r.srt_url is not None, r.preview_url is not None) for r in view} == {"a": (False, True), "b": (False, True), "c": (True, True)}
    folder = str(tmp_path / "jobs")
    formats.write_jobs(df, folder)
    assert "key" not in "".join(p.read_text() for p in (tmp_path / "jobs").rglob("*.json"))


def test_job_scan_and_log(spark, tmp_path):
    for name, content in {"x": '{"id":"x","status":"done","unknown":1}', "y": "{broken"}.items():
        (tmp_path / "jobs" / name).mkdir(parents=True)
        (tmp_path / "jobs" / name / "job.json").write_text(content)
    got = formats.read_jobs(spark, str(tmp_path / "jobs")).collect()
    assert [(r.id, r.created_at > 0) for r in got] == [("x", True)]
    (tmp_path / "log.jsonl").write_text('{"timestamp":1.0,"text":"a b","reused":true}\nnot json\n{"timestamp":2.0,"text":"c"}\n', encoding="utf-8")
    log = formats.read_log(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 3
    assert [r.row.text for r in log.where("not bad").orderBy("line").collect()] == ["a b", "c"]


def drawn(height=240, width=420, top=150):
    image = np.full((height, width, 3), 30, np.uint8)
    for k in range(40, width - 40, 12):
        image[top : top + 22, k : k + 5] = 240
    return image


def test_stable_region_and_signature(spark):
    rows = [("j", k, 240, 420, bytearray(drawn().tobytes())) for k in range(8)] + [("j", 8, -1, -1, bytearray())]
    frames = spark.createDataFrame(rows, "job string, frame_index int, height int, width int, data binary")
    r = vision.stable_regions(frames, ["job"], "frame_index").first().region
    assert r.x == 0 and r.w == 1 and 0.5 <= r.y <= 0.76 and 0.1 <= r.h <= 0.30
    sigs = {x.frame_index: x.signature for x in vision.signatures(frames, ["job", "frame_index"]).collect()}
    assert sigs[0] == sigs[1] and sigs[8] is None
    crop = vision.estimated_crops(frames.where("frame_index < 8"), ["job"], "frame_index").first().crop_bottom
    assert 0.35 <= crop <= 0.5
    sheet = vision.preview_sheet(frames.where("frame_index < 8"), ["job"], "frame_index", F.struct(F.lit(100).alias("top"), F.lit(200).alias("bottom"), F.lit(0).alias("left"), F.lit(420).alias("right"))).first()
    assert (sheet.height, sheet.width, len(sheet.sheet)) == (6 * 240, 420, 6 * 240 * 420 * 3)
    other = drawn()
    other[150:172] = 30
    other[150:172, 60:200:9] = 250
    a, b = set(vision.signature(drawn()[120:])), set(vision.signature(other[120:]))
    assert 1 - len(a & b) / len(a | b) > 0.2


def test_stream_equals_batch(spark, tmp_path):
    rows = [("j", t, x, f"2024-01-01 00:00:{int(t):02d}") for t, x in [(0.0, "Hello world"), (1.0, "Hello, world!"), (2.0, ""), (3.0, "Next line"), (4.0, "Something else now")]]
    df = spark.createDataFrame(rows, "job string, ts double, text string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, 1.0, 0.75).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    closed = {(r.text, r.start, r.end) for r in spark.table("closed").collect()}
    batch = {(r.text, r.start, r.end) for r in cues.sessions(cues.prepared(df), "job", 1.0, 0.75).collect()}
    assert closed and closed == {c for c in batch if c[0] != "Something else now"}


def test_one_exchange_serves_the_windows(spark):
    df = samples(spark, [(0, "a b c"), (1, "a b c")])
    plan = cues.merge_identical(cues.exact_sessions(cues.prepared(df), ["job"], 2.0), ["job"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_options_are_checked(spark):
    df = spark.createDataFrame([(9.0,)], "fps double")
    assert jobs.checked_options(df, {"fps": (0.1, 10)}).count() == 1
    with pytest.raises(Exception, match="fps must be"):
        jobs.checked_options(df, {"fps": (0.1, 5)}).collect()
