"""Crop boxes, drag rectangles and caption regions as expressions over doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box, or null if any part is."""
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h")))


def active_region(manual: Column, auto: Column) -> Column:
    """The manual box, else the found one, else none."""
    return F.coalesce(manual, auto)


def region_source(manual: Column, auto: Column) -> Column:
    """Where the active box comes from."""
    return F.when(manual.isNotNull(), F.lit("manual")).when(auto.isNotNull(), F.lit("auto"))


def crop_box(height: Column, width: Column, box: Column, crop_bottom: Column, full_frame: Column | bool = False) -> Column:
    """Pixel bounds (top, bottom, left, right) of a box, of the lower strip where there is none, or of the full frame."""
    full = F.lit(full_frame) if isinstance(full_frame, bool) else full_frame
    left, top = (_unit(box[a]) for a in ("x", "y"))
    right, bottom = _unit(box["x"] + box["w"]), _unit(box["y"] + box["h"])
    x0, x1 = (left * width).cast("int"), (right * width).cast("int")
    y0, y1 = (top * height).cast("int"), (bottom * height).cast("int")
    strip = height - F.greatest(F.lit(1), (height * crop_bottom).cast("int"))
    whole = lambda t: F.struct(t.cast("int").alias("top"), height.cast("int").alias("bottom"), F.lit(0).alias("left"), width.cast("int").alias("right"))
    good = box.isNotNull() & (x1 > x0) & (y1 > y0)
    return F.when(full, whole(F.lit(0))).when(good, F.struct(y0.alias("top"), y1.alias("bottom"), x0.alias("left"), x1.alias("right"))).otherwise(whole(strip))


def drag_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box between two corners."""
    return F.struct(F.least(x1, x2).alias("x"), F.least(y1, y2).alias("y"), F.abs(x2 - x1).alias("w"), F.abs(y2 - y1).alias("h"))


def fitted(width: Column, height: Column, room_width: Column, room_height: Column) -> Column:
    """Where a picture lies in its room with its aspect kept: (left, top, width, height)."""
    scale = F.least(room_width / width, room_height / height)
    w, h = width * scale, height * scale
    return F.struct(((room_width - w) / 2).alias("left"), ((room_height - h) / 2).alias("top"), w.alias("width"), h.alias("height"))


def point_in(x: Column, y: Column, fit: Column) -> Column:
    """A pointer's place in a fitted picture, each part in [0, 1]."""
    return F.struct(_unit((x - fit["left"]) / fit["width"]).alias("x"), _unit((y - fit["top"]) / fit["height"]).alias("y"))


def refine_region(y: Column, h: Column, top: Column, bottom: Column, least: Column) -> Column:
    """A caption band (y, h) fitted to a letterboxed picture's active rows [top, bottom]."""
    a = bottom - top
    boxed = a <= 0.72
    tall = boxed & ((h >= 0.62 * a) | ((y <= top + 0.18 * a) & (h >= F.greatest(F.lit(0.18), 0.5 * a))))
    high = F.least(F.greatest(least, 0.42 * a), F.least(F.lit(0.24), a))
    stray = boxed & (y + h < bottom - 0.12 * a)
    apart = (a <= 0) | (y + h <= top) | (y >= bottom)
    pair = lambda p, q: F.struct(p.cast("double").alias("y"), q.cast("double").alias("h"))
    return (
        F.when(apart, pair(y, h))
        .when(tall, pair(F.greatest(F.lit(0.0), bottom - high), high))
        .when(stray, pair(F.greatest(F.lit(0.0), bottom - h), h))
        .when(h > 0.28, pair(F.greatest(F.lit(0.0), y + h / 2 - 0.14), F.lit(0.28)))
        .otherwise(pair(y, h))
    )
