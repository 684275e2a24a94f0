"""Image quality: column expressions over figures, and over small gray rasters held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def brightness_ramp(b: Column) -> Column:
    """1 from 80 to 180, 0 outside 30 to 225, straight between."""
    up, down = (b - 30.0) / 50.0, (225.0 - b) / 45.0
    return F.when(b.between(80, 180), 1.0).when((b < 30) | (b > 225), 0.0).when(b < 80, up).otherwise(down)


def overall(laplacian: Column, brightness: Column, contrast: Column) -> Column:
    one = F.lit(1.0)
    total = F.least(laplacian / 200.0, one) * 0.7 + brightness_ramp(brightness) * 0.2 + F.least(contrast / 60.0, one) * 0.1
    return F.when(laplacian.isNotNull() & brightness.isNotNull() & contrast.isNotNull(), F.greatest(F.lit(0.0), F.least(one, total)))


def issues(laplacian: Column, brightness: Column, contrast: Column) -> Column:
    found = [F.when(laplacian < 100, "blurry"), F.when(brightness < 30, "dark"), F.when(brightness > 225, "overexposed"), F.when(contrast < 20, "low_contrast")]
    return F.array_compact(F.array(*found))


def usable(total: Column) -> Column:
    return total >= 0.2


def person_overall(face: Column, body: Column) -> Column:
    return F.coalesce(face, F.lit(0.0)) * 0.7 + F.coalesce(body, F.lit(0.0)) * 0.3


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def exact_mean(values: Column) -> Column:
    """Mean of a group's figures from a sum of decimals, so that no order of rows shows in it. Figures that decimals do not hold (infinite, or of 10^10 and more) leave a plain mean."""
    whole = values.cast("double").try_cast("decimal(28,18)")
    return F.when(F.count(whole) == F.count(values), F.sum(whole).cast("double") / F.nullif(F.count(values), F.lit(0))).otherwise(F.avg(values))


def variance(values: Column) -> Column:
    """Population variance of doubles, in one pass, so that a costly `values` is evaluated once."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))
    return F.aggregate(values, start, step, lambda a: F.greatest(F.lit(0.0), a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"])))


def stencil(px: Column, width: int, height: int, weights: list[list[int]]) -> Column:
    """A 3x3 correlation of a row-major array; the border mirrors without repeating its edge."""
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    cells = []
    for y in range(height):
        for x in range(width):
            terms = [px[mirror(y + dy, height) * width + mirror(x + dx, width)] * weights[dy + 1][dx + 1] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if weights[dy + 1][dx + 1]]
            cells.append(sum(terms[1:], terms[0]).cast("double"))
    return F.array(*cells)
