"""Boxes: column expressions over (x1, y1, x2, y2) in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def half(x: Column) -> Column:
    """Half, rounded down also below zero."""
    return F.floor(x / F.lit(2.0)).cast("int")


def whole(x: Column) -> Column:
    """Without its fraction."""
    return x.cast("int")


def clamp_int(x: Column, low: Column | int, high: Column | int) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(as_column(high), x))


def clamped(b: list[Column], width: Column, height: Column) -> list[Column]:
    return [clamp_int(whole(v), 0, size) for v, size in zip(b, (width, height, width, height))]


def is_valid(b: list[Column], width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = (whole(v) for v in b)
    return (x2 > x1) & (y2 > y1) & (x1 >= 0) & (y1 >= 0) & (x2 <= width) & (y2 <= height)


def cleaned(b: list[Column], width: Column, height: Column) -> list[Column]:
    """Corners in order, inside the image, at least a pixel wide and high."""
    x1, y1, x2, y2 = (whole(v) for v in b)
    width, height = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    left, top = clamp_int(F.least(x1, x2), 0, width - 1), clamp_int(F.least(y1, y2), 0, height - 1)
    return [left, top, F.greatest(left + 1, F.least(F.greatest(x1, x2), width)), F.greatest(top + 1, F.least(F.greatest(y1, y2), height))]


def padded(b: list[Column], share: float, width: Column, height: Column) -> list[Column]:
    """Grown by `share` of its size on each side, inside the image."""
    x1, y1, x2, y2 = b
    dx, dy = whole((x2 - x1) * F.lit(float(share))), whole((y2 - y1) * F.lit(float(share)))
    return [F.greatest(F.lit(0), x1 - dx), F.greatest(F.lit(0), y1 - dy), F.least(width, x2 + dx), F.least(height, y2 + dy)]


def fitted(b: list[Column], aspect_w: int, aspect_h: int) -> list[Column]:
    """The smallest box of that ratio around b's centre; it may leave the image."""
    x1, y1, x2, y2 = b
    ratio = aspect_w / aspect_h
    w, h = x2 - x1, y2 - y1
    wide, high = F.greatest(w, whole(h * F.lit(ratio))), F.greatest(h, whole(w / F.lit(ratio)))
    left, top = half(x1 + x2) - half(wide), half(y1 + y2) - half(high)
    return [left, top, left + wide, top + high]


def overhang(b: list[Column], width: Column, height: Column) -> list[Column]:
    """Pixels beyond the left, top, right and bottom edge."""
    x1, y1, x2, y2 = b
    zero = F.lit(0)
    return [F.greatest(zero, -x1), F.greatest(zero, -y1), F.greatest(zero, x2 - width), F.greatest(zero, y2 - height)]


def upscaled(w: Column, h: Column, least: int) -> list[Column]:
    """Size of a crop: larger by one factor if both sides are below `least`, so that the longer one reaches it."""
    small = (w < least) & (h < least)
    factor = F.lit(float(least)) / F.greatest(w, h)
    return [F.when(small, whole(w * factor)).otherwise(w), F.when(small, whole(h * factor)).otherwise(h)]


def shrunk(w: Column, h: Column, most: int | None) -> list[Column]:
    """Size of an image whose longer side is at most `most`."""
    if most is None:
        return [w, h]
    large, factor = F.greatest(w, h) > most, F.lit(float(most)) / F.greatest(w, h)
    return [F.when(large, whole(w * factor)).otherwise(w), F.when(large, whole(h * factor)).otherwise(h)]


def aspect_ratio(text: Column) -> Column:
    """struct<w, h> of "W:H" with positive whole numbers and a ratio from 0.1 to 100; else null."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^\s*([0-9]+)\s*:\s*([0-9]+)\s*$", i).try_cast("int")
    w, h = part(1), part(2)
    return F.when((w > 0) & (h > 0) & F.try_divide(w, h).between(0.1, 100.0), F.struct(w.alias("w"), h.alias("h")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
