"""Caption regions in frames: pixel kernels in Arrow batches, votes and choices as DataFrame operations.

Frames are rows of (job, frame_index, height, width, data), data being height * width * 3 bytes in blue, green, red order,
as Spark's image source has them. Kernels are plain array code, so results are close to those of an image library, not equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.geometry import refine_region
from cuelake.operators.sequence import even_sample, true_runs

# Fixed values of the region vote.
SAMPLES, LEAST_USABLE, LEAST_PEAK = 14, 3, 3.0
MASK_WIDTH, SIGNATURE_SHAPE = 480, (64, 192)
TAPS = np.exp(-((np.arange(9) - 4) ** 2) / (2 * 1.7**2))
TAPS /= TAPS.sum()


def pixels(data: bytes, height: int, width: int) -> np.ndarray | None:
    """The image, or None if it can't be read."""
    return np.frombuffer(data, np.uint8).reshape(height, width, 3) if data and height > 0 and len(data) == height * width * 3 else None


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a blue, green, red image."""
    return np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def _slid(a: np.ndarray, size: tuple[int, int], how, fill: int) -> np.ndarray:
    """The least or largest value in a box around each pixel, one axis after the other."""
    for axis, n in enumerate(size):
        if n > 1:
            pad = [(0, 0), (0, 0)]
            pad[axis] = (n // 2, n - 1 - n // 2)
            a = how(np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=fill), n, axis=axis), axis=-1)
    return a


def shrunk(a: np.ndarray, size: tuple[int, int], least: bool = True) -> np.ndarray:
    """Grey erosion, or dilation, by a box of (rows, columns)."""
    return _slid(a, size, np.min, 255) if least else _slid(a, size, np.max, 0)


def resized(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Area means onto a smaller grid, nearest pixels onto a larger one."""
    for axis, n in enumerate(shape):
        m = a.shape[axis]
        if n < m:
            total = np.insert(np.cumsum(a.astype(float), axis=axis), 0, 0, axis=axis)
            edge = np.linspace(0, m, n + 1)
            low = np.floor(edge).astype(int)
            at = np.take(total, low, axis=axis)
            part = np.take(total, np.minimum(low + 1, m), axis=axis) - at
            frac = (edge - low).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
            a = np.diff(at + part * frac, axis=axis) * n / m
        elif n > m:
            a = np.take(a, np.minimum((np.arange(n) + 0.5) * m / n, m - 1).astype(int), axis=axis)
    return np.rint(a).astype(np.uint8)


def stroke_mask(g: np.ndarray, box: tuple[int, int] = (5, 17)) -> np.ndarray:
    """255 where thin bright or dark strokes stand out, cut at the level that parts the two classes best."""
    p = np.pad(g.astype(float), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    p = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    blur = np.rint((p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4).astype(np.uint8)
    bright = blur - shrunk(shrunk(blur, box), box, least=False)
    dark = shrunk(shrunk(blur, box, least=False), box) - blur
    strokes = np.maximum(bright, dark)
    n = np.bincount(strokes.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (mass / below - (mass[-1] - mass) / above) ** 2)
    return np.where(strokes > between.argmax(), 255, 0).astype(np.uint8)


def opened(mask: np.ndarray, size: tuple[int, int] = (2, 2)) -> np.ndarray:
    """Without specks smaller than the box."""
    return shrunk(shrunk(mask, size), size, least=False)


def signature(image: np.ndarray) -> np.ndarray:
    """Positions of the shape mask of a caption strip."""
    mask = opened(stroke_mask(resized(gray(image), SIGNATURE_SHAPE), (5, 13)))
    return np.flatnonzero(shrunk(mask, (2, 2), least=False))


def region_mask(image: np.ndarray) -> np.ndarray | None:
    """The text mask of a frame at most MASK_WIDTH wide; None for tiny frames."""
    h, w = image.shape[:2]
    if h < 80 or w < 120:
        return None
    g = gray(image)
    if w > MASK_WIDTH:
        g = resized(g, (max(1, round(h * MASK_WIDTH / w)), MASK_WIDTH))
    mask = opened(stroke_mask(g))
    return shrunk(mask, (2, max(3, mask.shape[1] // 160)), least=False)


def active_rows(image: np.ndarray, height: int) -> np.ndarray:
    """1 for rows that hold a picture, closed over short gaps, at the mask's height."""
    g = gray(image).astype(float)
    on = ((g.mean(1) > 14) | (g.std(1) > 4.5)).astype(np.uint8)[:, None]
    on = shrunk(shrunk(on, (9, 1), least=False), (9, 1))
    at = np.clip((np.arange(height) + 0.5) * len(on) / height, 0, len(on) - 1).astype(int)
    return on[at, 0].astype(float)


def focused(image: np.ndarray) -> np.ndarray:
    """The strip of a cropped frame in which the text stands; small or textless crops stay whole."""
    h, w = image.shape[:2]
    if h < 80 or w < 120:
        return image
    score = opened(stroke_mask(gray(image), (max(3, h // 90), max(9, w // 28)))).mean(1)
    top = score.max(initial=0.0)
    if top < 2.5:
        return image
    edges = np.flatnonzero(np.diff(np.r_[0, (score >= max(2.0, 0.42 * top)).astype(int), 0]))
    a, b = max(zip(edges[::2], edges[1::2], strict=True), key=lambda r: score[r[0] : r[1]].sum() * (0.75 + 0.25 * (r[0] + r[1]) / 2 / h))
    least = max(42, int(0.18 * h))
    size = min(max(b - a + int(0.16 * h), least), max(least, int(0.42 * h)))
    low = min(h, max(0, (a + b) // 2 - size // 2) + size)
    return image[max(0, low - size) : low]


def signatures(frames: DataFrame, keys: list[str], box: Column | None = None, focus: Column | bool = False) -> DataFrame:
    """(keys, signature): positions of each frame's mask, null for frames that can't be read and for empty crops.

    box: struct(top, bottom, left, right) of pixels, as crop_box gives it; what is outside has no say. focus: whether the strip in which the
    crop's text stands is taken. Cropping, focus and mask are one pass.
    """
    whole = F.struct(F.lit(0).alias("top"), F.col("height").alias("bottom"), F.lit(0).alias("left"), F.col("width").alias("right"))
    bounds = F.col("__box") if box is not None else whole
    edges = ["top", "bottom", "left", "right"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, h, w, near, top, bottom, left, right in zip(b["data"], b["height"], b["width"], b["__focus"], *(b[f"__{e}"] for e in edges), strict=True):
                image = pixels(d, h, w)
                image = None if image is None or top != top else image[max(0, int(top)) : int(bottom), max(0, int(left)) : int(right)]
                out.append(None if image is None or not image.size else signature(focused(image) if near else image).tolist())
            yield b[keys].assign(signature=out)

    schema = frames.select(*keys).schema.add("signature", T.ArrayType(T.IntegerType()))
    rows = frames.withColumn("__box", box) if box is not None else frames
    near = F.lit(focus) if isinstance(focus, bool) else F.coalesce(focus, F.lit(False))
    return rows.select(*keys, "height", "width", "data", near.alias("__focus"), *[bounds[e].alias(f"__{e}") for e in edges]).mapInPandas(run, schema)


def row_profiles(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, profile, active): text and picture rows of the sampled frames that show text."""
    kept = [*keys, order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, d, h, w in zip(b[kept].itertuples(index=False), b["data"], b["height"], b["width"], strict=True):
                image = pixels(d, h, w)
                mask = None if image is None else region_mask(image)
                score = np.zeros(1) if mask is None else mask.mean(1)
                if score.max() >= LEAST_PEAK:
                    out.append((*row, (score / score.max()).tolist(), active_rows(image, len(score)).tolist()))
            yield pd.DataFrame(out, columns=[*kept, "profile", "active"])

    sampled = even_sample(frames, keys, [order], SAMPLES).select(*kept, "height", "width", "data")
    return sampled.mapInPandas(run, frames.select(*kept).schema.add("profile", T.ArrayType(T.DoubleType())).add("active", T.ArrayType(T.DoubleType())))


def smoothed(values: Column) -> Column:
    """Nine-tap Gaussian mean of an array, mirrored at its ends."""
    n = F.size(values)
    mirrored = lambda i: F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)
    taps = F.array(*[F.struct(F.lit(k - 4).alias("d"), F.lit(float(t)).alias("t")) for k, t in enumerate(TAPS)])
    at = lambda i: F.aggregate(taps, F.lit(0.0), lambda s, x: s + x.t * F.coalesce(F.get(values, mirrored(i + x.d)), F.lit(0.0)))
    return F.transform(F.sequence(F.lit(0), n - 1), at)


def region_votes(profiles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, usable, height, votes, active): element-wise sums over a job's frames of the first frame's height."""
    first = Window.partitionBy(*keys).orderBy(order)
    same = profiles.withColumn("height", F.first(F.size("profile")).over(first)).where(F.size("profile") == F.col("height"))
    rows = same.select(*keys, order, "height", F.posexplode(F.arrays_zip("profile", "active")).alias("y", "v"))
    sums = rows.groupBy(*keys, "height", "y").agg(F.count("*").alias("usable"), F.sum("v.profile").alias("p"), F.sum("v.active").alias("a"))
    packed = sums.groupBy(*keys, "height").agg(F.max("usable").alias("usable"), F.array_sort(F.collect_list(F.struct("y", "p", "a"))).alias("rows"))
    return packed.where(F.col("usable") >= LEAST_USABLE).select(*keys, "usable", "height", smoothed(F.transform("rows", lambda r: r.p)).alias("votes"), F.transform("rows", lambda r: r.a).alias("active"))


def _best_runs(votes: DataFrame, keys: list[str], values: str, threshold: Column) -> DataFrame:
    rows = votes.select(*keys, "height", "usable", threshold.alias("least"), F.posexplode(values).alias("y", "v"))
    extra = rows.groupBy(*keys).agg(F.first("height").alias("height"))
    runs = true_runs(rows, keys, ["y"], F.col("v") >= F.col("least"))
    return runs.join(extra, keys)


def stable_regions(frames: DataFrame, keys: list[str], order: str, crop_bottom: float = 0.55) -> DataFrame:
    """(keys, region): the band in which a job's captions stand, as box parts of the frame; jobs without one are left out."""
    votes = region_votes(row_profiles(frames, keys, order), keys, order)
    peak = F.array_max("votes")
    votes = votes.where(peak >= F.greatest(F.lit(1.2), 0.18 * F.col("usable")))
    bands = _best_runs(votes, keys, "votes", F.greatest(0.42 * peak, 0.12 * F.col("usable"))).join(votes.select(*keys, "votes"), keys)
    size = F.col("end") - F.col("start")
    center = (F.col("start") + F.col("end")) / 2 / F.col("height")
    total = F.aggregate(F.slice("votes", (F.col("start") + 1).cast("int"), size.cast("int")), F.lit(0.0), lambda s, x: s + x)
    bands = bands.where((size >= F.greatest(F.lit(2), (0.025 * F.col("height")).cast("int"))) & (size <= (0.42 * F.col("height")).cast("int"))).withColumn("center", center).withColumn("score", total * (0.72 + 0.58 * center))
    best = Window.partitionBy(*keys)
    top = F.struct("score", "start", "end", "center")
    ranked = bands.withColumn("top", F.max(top).over(best)).withColumn("low", F.max(F.when((F.col("center") > 0.42) & (top < F.col("top")), top)).over(best)).select(*keys, "height", "top", "low").distinct()
    lower = (F.col("top.center") < 0.35) & (F.col("low.score") >= 0.58 * F.col("top.score"))
    band = ranked.select(*keys, "height", F.when(lower, F.col("low")).otherwise(F.col("top")).alias("b"))
    pad = F.greatest(F.lit(3), (0.055 * F.col("height")).cast("int"))
    y1, y2 = F.greatest(F.lit(0), F.col("b.start") - pad), F.least(F.col("height"), F.col("b.end") + pad)
    least = max(0.1, min(0.18, 0.32 * crop_bottom))
    tall = (y2 - y1) / F.col("height")
    placed = band.select(*keys, F.when(tall < least, F.greatest(F.lit(0.0), (y1 + y2) / 2 / F.col("height") - least / 2)).otherwise(y1 / F.col("height")).alias("y"), F.greatest(tall, F.lit(least)).alias("h"))
    shown = _best_runs(votes, keys, "active", F.greatest(F.lit(1.0), 0.35 * F.col("usable")))
    longest = shown.groupBy(*keys).agg(F.max_by(F.struct((F.col("start") / F.col("height")).alias("top"), (F.col("end") / F.col("height")).alias("bottom")), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("shown"))
    fitted = placed.join(longest, keys, "left").withColumn("r", F.when(F.col("shown").isNull(), F.struct("y", "h")).otherwise(refine_region(F.col("y"), F.col("h"), F.col("shown.top"), F.col("shown.bottom"), F.lit(least))))
    y = F.when(F.col("r.y") + F.col("r.h") > 1, F.greatest(F.lit(0.0), 1 - F.col("r.h"))).otherwise(F.col("r.y"))
    return fitted.select(*keys, F.struct(F.lit(0.0).alias("x"), F.bround(y, 6).alias("y"), F.lit(1.0).alias("w"), F.bround(F.least(F.col("r.h"), F.lit(1.0)), 6).alias("h")).alias("region"))


def edge_crop(means: Column, height: Column, lower_start: Column, band: Column) -> Column:
    """The share of a frame's height that holds captions, from edge means of bands of its lower part; null if none stand out."""
    top = F.array_max(means)
    active = F.array_position(F.transform(means, lambda m: m >= F.greatest(F.lit(2.0), 0.42 * top)), True)
    y = lower_start + F.greatest(F.lit(0), active.cast("int") - 1 - 2) * band
    return F.when(top >= 2.0, F.bround(F.greatest(F.least((height - y) / height, F.lit(0.65)), F.lit(0.35)), 2))


def preview_sheet(frames: DataFrame, keys: list[str], order: str, boxes: Column, n: int = 6) -> DataFrame:
    """(keys, height, width, sheet): up to n sampled frames of a job stacked, each crop box outlined, as raw pixels."""
    at = even_sample(frames, keys, [order], n).withColumn("box", boxes)

    def sheet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        panels = []
        for _, r in rows.sort_values(order).iterrows():
            image = pixels(r["data"], r["height"], r["width"])
            if image is None:
                continue
            image, b = image.copy(), r["box"]
            for y in (b["top"], b["bottom"] - 1):
                image[y, b["left"] : b["right"]] = (0, 255, 0)
            for x in (b["left"], b["right"] - 1):
                image[b["top"] : b["bottom"], x] = (0, 255, 0)
            panels.append(image)
        if not panels:
            return pd.DataFrame(columns=[*keys, "height", "width", "sheet"])
        wide = max(p.shape[1] for p in panels)
        whole = np.vstack([np.pad(p, ((0, 0), (0, wide - p.shape[1]), (0, 0))) for p in panels])
        return pd.DataFrame([(*key, whole.shape[0], wide, whole.tobytes())], columns=[*keys, "height", "width", "sheet"])

    return at.groupBy(*keys).applyInPandas(sheet, frames.select(*keys).schema.add("height", T.IntegerType()).add("width", T.IntegerType()).add("sheet", T.BinaryType()))


def band_means(image: np.ndarray) -> tuple[list[float], int, int]:
    """Edge means of bands of a frame's lower part, where that part starts, and the bands' height: edge_crop's inputs."""
    height = image.shape[0]
    start, band = int(0.45 * height), max(6, height // 90)
    p = np.pad(gray(image[start:]).astype(float), 2, mode="edge")
    soft = (p[:-2] + 2 * p[1:-1] + p[2:])[:, 1:-1] / 4
    dy, dx = np.abs(soft[2:, 1:-1] - soft[:-2, 1:-1]) * 4, np.abs(soft[1:-1, 2:] - soft[1:-1, :-2]) * 4
    strength = dx + dy
    weak, strong = strength > 80, np.where(strength > 180, 255, 0).astype(np.uint8)
    edges = np.where(weak & (shrunk(strong, (3, 3), least=False) > 0), 255, 0)
    return [float(edges[y : y + band].mean()) for y in range(0, edges.shape[0], band)], start, band


def estimated_crops(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, crop_bottom): the upper median of the crops that a job's frames at a quarter, half and three quarters give."""
    from cuelake.operators.sequence import at_shares, upper_median

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, d, h, w in zip(b[keys].itertuples(index=False), b["data"], b["height"], b["width"], strict=True):
                image = pixels(d, h, w)
                if image is not None:
                    out.append((*row, h, *band_means(image)))
            yield pd.DataFrame(out, columns=[*keys, "height", "means", "start", "band"])

    picked = at_shares(frames, keys, [order]).select(*keys, "height", "width", "data")
    schema = frames.select(*keys).schema.add("height", T.IntegerType()).add("means", T.ArrayType(T.DoubleType())).add("start", T.IntegerType()).add("band", T.IntegerType())
    crops = picked.mapInPandas(run, schema).select(*keys, edge_crop(F.col("means"), F.col("height"), F.col("start"), F.col("band")).alias("crop"))
    return upper_median(crops, keys, "crop", "crop_bottom")
