"""Golden values of the text, time, box and settings expressions."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cuelake.functions import config, geometry, replies, text, timecode


def values(spark, inputs, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_clean_and_normalize(spark):
    got = values(spark, ["  A classic doesn't have to be a relic.  ", "  这是一句中文字幕。  ", "A", "□□□□□□", None, ""], text.clean_text)
    assert got == ["A classic doesn't have to be a relic.", "这是一句中文字幕。", None, None, None, None]
    assert values(spark, ["Hello, World!", "你好，世界！"], text.normalize) == ["helloworld", "你好世界"]


def test_hard_noise(spark):
    noise = ["LA22 WNP", "IV D MG MD MD MD MG A 0 A", "0060960", "MGRanDAI", "TODAUT", "你好"]
    assert all(values(spark, noise, text.is_hard_noise))
    assert not any(values(spark, ["Impossible:", "through the tightest corners", "", None], text.is_hard_noise))


def test_needs_review(spark):
    glued = ["thewordthatdefinesthelimits.", "SAVEFUEL,ORKEEPTHEPUN", "", None, "it'swhereourjourneybegins now", "中文 ab"]
    assert all(values(spark, glued, text.needs_review))
    assert not any(values(spark, ["the word that defines the limits."], text.needs_review))
    assert not any(values(spark, glued, lambda c: text.needs_review(c, False)))


def test_prefers_review(spark):
    rows = spark.createDataFrame([("thewordthatdefinesthelimits.", "the word that defines the limits."), ("", "LA22 WNP"), ("good text here", "other text"), ("", "fine words")], "p string, r string")
    assert [r[0] for r in rows.select(text.prefers_review(F.col("p"), F.col("r"))).collect()] == [True, False, False, True]


def test_accepts_token(spark):
    rows = spark.createDataFrame([("LA22WNP", 0.98), ("MIOICOUAIIIOOOLOUI", 0.59), ("DHI", 0.95), ("Cynua", 0.93), ("Impossible:", 0.99), ("Fun.", 0.95), ("through the tightest corners", 0.99), ("no score given", None)], "t string, s double")
    assert [r[0] for r in rows.select(text.accepts_token(F.col("t"), F.col("s"))).collect()] == [False] * 4 + [True] * 4


def test_repair(spark):
    pairs = {"No less a dream 4": "No less a dream", "battery technol Wst tiime": "", "traric jam ahead": "traffic jam ahead", "LA22 WNP": "", "a,b and,c words": "a, b and, c words", "to the end...": "to the end.", "étomake it": "étomake it"}
    assert values(spark, list(pairs), text.repair) == list(pairs.values())


def test_times(spark):
    assert values(spark, [0.0, 3661.2345, -3.0, 0.0005, 0.0015], timecode.srt_timestamp, "double") == ["00:00:00,000", "01:01:01,234", "00:00:00,000", "00:00:00,000", "00:00:00,002"]
    assert values(spark, [0.4, 59.5, 61.0, 3661.0], timecode.duration_text, "double") == ["0s", "1m 0s", "1m 1s", "1h 1m"]
    assert values(spark, [0.5, 3599.4, 6000.0], timecode.clock, "double") == ["00:01", "59:59", "100:00"]
    assert values(spark, [0, 512, 1536, 20480, 5 * 1024**4], timecode.size_text, "long") == ["0 B", "512 B", "1.5 KB", "20 KB", "5120 GB"]


def test_boxes(spark):
    def box(region, bottom=0.55, full=False):
        b = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>") if region is None else geometry.region(*map(F.lit, region))
        return spark.range(1).select(geometry.crop_box(F.lit(100), F.lit(200), b, F.lit(bottom), full).alias("b")).first().b

    assert box((0.25, 0.2, 0.5, 0.4)) == Row(top=20, bottom=60, left=50, right=150)
    assert box((0.0, 0.6, 1.0, 0.25)) == Row(top=60, bottom=85, left=0, right=200)
    assert box(None) == Row(top=45, bottom=100, left=0, right=200)
    assert box((0.1, 0.1, 0.0, 0.0)).top == 45
    assert box(None, full=True).top == 0


@pytest.mark.parametrize(("y", "h", "top", "bottom", "want"), [(0.5, 0.1, 0.0, 1.0, (0.5, 0.1)), (0.4, 0.4, 0.0, 1.0, (0.46, 0.28)), (0.3, 0.5, 0.2, 0.8, (0.56, 0.24)), (0.9, 0.05, 0.1, 0.5, (0.9, 0.05))])
def test_refine_region(spark, y, h, top, bottom, want):
    r = spark.range(1).select(geometry.refine_region(*map(F.lit, (y, h, top, bottom, 0.17))).alias("r")).first().r
    assert (r.y, r.h) == pytest.approx(want)


def test_settings(spark):
    def auto(mode, d, w, h, found=None):
        return spark.range(1).select(config.auto_config(F.lit(mode), *(F.lit(x).cast("double") for x in (d, w, h, found))).alias("c")).first().c

    c = auto("balanced", 60.0, 368.0, 640.0)
    assert (c.crop_bottom, c.fps, c.frame_diff_threshold) == (0.5, 1.0, 0.3)
    assert auto("balanced", 60.0, 368.0, 640.0, 0.65).crop_bottom == 0.58
    assert auto("balanced", 60.0, 854.0, 480.0).crop_bottom == pytest.approx(0.65)

    def plan(have, mode, requested="auto"):
        p = spark.range(1).select(config.engine_plan(F.lit(requested), F.lit(mode), F.array(*map(F.lit, have))).alias("p")).first().p
        return p.engine, p.review_engine

    assert plan(["openvino", "paddle"], "fast") == ("openvino", "")
    assert plan(["openvino", "onnxruntime", "paddle"], "accurate") == ("openvino", "paddle")
    assert plan(["paddle"], "balanced") == ("paddle", "")
    assert plan(["onnxruntime"], "balanced") == ("onnxruntime", "")
    machine = spark.range(1).select(config.resource_plan(F.lit(22), F.lit(32.0), F.lit(24.0)).alias("r")).first().r
    assert (machine.worker_count, machine.cpu_threads) == (2, 11)
    forced = spark.range(1).select(config.resource_plan(F.lit(22), F.lit(32.0), F.lit(24.0), forced=F.lit(4), most=F.lit(2)).alias("r")).first().r
    assert forced.worker_count == 2


def test_replies(spark):
    got = values(spark, ['```json\n{"items":[{"i":1,"text":"Fixed"}]}\n```', '{"items":[{"i":1,"text":"a\\nb"}]}', '{"corrections":[{"index":2,"corrected_text":"two"}]}', "just text", '{"items":{"3":"three"}}', "{}", '{"items":[]}', '{"items":[{"i":0,"id":4,"text":"four"}]}'], replies.correction_map)
    assert got == [{1: "Fixed"}, {}, {2: "two"}, {1: "just text"}, {3: "three"}, {1: "{}"}, {}, {4: "four"}]
    body = '{"choices":[{"message":{"content":"hi"}}]}'
    assert values(spark, [body, '{"output_text":"yo"}', "{}"], lambda c: replies.reply_text(F.lit("openai"), c)) == ["hi", "yo", ""]
    assert values(spark, ['{"content":[{"text":"a"},{"text":"b"}]}'], lambda c: replies.reply_text(F.lit("anthropic"), c)) == ["a\nb"]  # blocks are lines
    assert values(spark, ['{"error":"bad"}', '{"error":{"message":"m"}}', '{"ok":false,"message":"no"}', '{"message":"fine"}'], replies.error_text) == ["bad", "m", "no", ""]
