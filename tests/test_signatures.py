"""Signatures of cropped, focused strips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import cascade, vision

SCHEMA = "k int, height int, width int, data binary"


def drawn(height, width, tops, seed=0):
    """A dark picture with lines of strokes at the given rows."""
    rng = np.random.default_rng(seed)
    image = rng.integers(20, 26, (height, width, 3), dtype=np.uint8)
    for top, size, step in tops:
        for x in range(width // 8, width - width // 8, step):
            image[top : top + size, x : x + 4] = 240
    return image


def frames(spark, images):
    return spark.createDataFrame([(k, *x.shape[:2], bytearray(x.tobytes())) for k, x in enumerate(images)] + [(99, -1, -1, bytearray())], SCHEMA)


def plain_focus(image):
    """The strip by loops over rows, from the scores of the same mask."""
    h, w = image.shape[:2]
    if h < 80 or w < 120:
        return 0, h
    score = [float(np.mean(r)) for r in vision.opened(vision.stroke_mask(vision.gray(image), (max(3, h // 90), max(9, w // 28))))]
    if max(score) < 2.5:
        return 0, h
    least, runs, start = max(2.0, 0.42 * max(score)), [], None
    for y, s in enumerate([*score, -1.0]):
        if s >= least and start is None:
            start = y
        if s < least and start is not None:
            runs.append((start, y))
            start = None
    best = max(runs, key=lambda r: sum(score[r[0] : r[1]]) * (0.75 + 0.25 * (r[0] + r[1]) / 2 / h))
    small = max(42, int(h * 0.18))
    size = min(max(best[1] - best[0] + int(h * 0.16), small), max(small, int(h * 0.42)))
    y1 = max(0, (best[0] + best[1]) // 2 - size // 2)
    y2 = min(h, y1 + size)
    return max(0, y2 - size), y2


@pytest.mark.parametrize(("height", "width", "tops"), [(240, 420, [(150, 22, 12)]), (240, 420, [(20, 22, 12), (200, 22, 12)]), (300, 200, [(280, 15, 9), (100, 30, 30)]), (100, 130, []), (79, 400, [(40, 20, 12)]), (400, 640, [(5, 12, 14), (60, 40, 11), (350, 20, 12)])])
def test_focus_is_a_loop(height, width, tops):
    image = drawn(height, width, tops)
    a, b = plain_focus(image)
    assert np.array_equal(vision.focused(image), image[a:b])


def test_crop_and_focus_in_one_pass(spark):
    base = drawn(240, 420, [(150, 22, 12)])
    outside = base.copy()
    outside[:80], outside[235:] = 255, drawn(5, 420, [(0, 5, 7)])
    box = F.struct(F.lit(100).alias("top"), F.lit(230).alias("bottom"), F.lit(0).alias("left"), F.lit(420).alias("right"))
    df = frames(spark, [base, outside, drawn(240, 420, [(150, 22, 31)])])
    got = vision.signatures(df, ["k"], box, focus=True)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    by = {r.k: r.signature for r in got.collect()}
    assert by[0] == by[1] != by[2] and by[99] is None and by[0] == vision.signature(vision.focused(base[100:230])).tolist()
    whole = {r.k: r.signature for r in vision.signatures(df, ["k"]).collect()}
    assert whole[0] != whole[1]
    none = F.struct(F.lit(50).alias("top"), F.lit(50).alias("bottom"), F.lit(0).alias("left"), F.lit(9).alias("right"))
    odd = F.when(F.col("k") == 0, none).when(F.col("k") == 1, box)
    some = {r.k: r.signature for r in vision.signatures(df, ["k"], odd, F.col("k") == 1).collect()}
    assert some[0] is None and some[1] == by[1] and some[2] is None


def test_row_keys_and_blanks_in_workers():
    assert cascade.flattened([{"rec_text": "a", "confidence": 0.5}, {"txt": "b"}, {"text": " "}, ["box", " ", 1.0]]) == [{"text": "a", "score": 0.5}, {"text": "b", "score": None}]
