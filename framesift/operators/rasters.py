"""Gray rasters as a binary column: one byte a pixel, row by row, with width and height beside it.

Arrow jobs read the bytes in place: a batch's pixels are one buffer, and a raster is a view of it. Nothing turns pixels into Python numbers. Rasters
of equal shape are stacked, at most PIXELS of them at once (one, if it is larger). With doubles for the pixels and some six arrays between, a
task holds about 60 MB besides its Arrow batch, or 100 MB for a raster of 1080p; a batch of n rasters of 1080p is 2 n MB itself, which
spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels that are worked on at once.
PIXELS = 1 << 20
#: The side of the reduced frame that is fingerprinted, and the unit of its weights.
SIDE, UNIT = 16, 2048


def as_bytes(px: Column) -> Column:
    """An array of numbers 0..255 as bytes."""
    return F.unhex(F.array_join(F.transform(px, lambda p: F.lpad(F.hex(p.cast("int")), 2, "0")), ""))


def as_values(px: Column) -> Column:
    """Bytes as an array of numbers, for small rasters."""
    digits = F.hex(px)
    each = F.transform(F.sequence(F.lit(1), F.octet_length(px)), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.octet_length(px) > 0, each).when(px.isNotNull(), F.array().cast("array<int>"))


def binary(rasters: DataFrame, px: str = "px") -> DataFrame:
    """rasters with bytes as px; a column of numbers is turned into them."""
    return rasters.withColumn(px, as_bytes(F.col(px))) if isinstance(rasters.schema[px].dataType, T.ArrayType) else rasters


def views(batch: pa.RecordBatch, px: str = "px", width: str = "width", height: str = "height") -> list[np.ndarray | None]:
    """The rasters of a batch, without a copy. None where a value is null or the bytes are not width times height."""
    column = batch.column(px)
    wide, high = batch.column(width).to_pylist(), batch.column(height).to_pylist()
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    valid = column.is_valid().to_pylist()
    out = []
    for i, (w, h) in enumerate(zip(wide, high)):
        whole = valid[i] and w is not None and h is not None and w > 0 and h > 0 and edges[i + 1] - edges[i] == w * h
        out.append(data[edges[i] : edges[i + 1]].reshape(h, w) if whole else None)
    return out


def stacks(images: list[np.ndarray | None], pixels: int = PIXELS) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and stack of images of one shape, at most `pixels` in one stack."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, image in enumerate(images):
        if image is not None:
            shapes.setdefault(image.shape, []).append(i)
    for (h, w), places in shapes.items():
        step = max(1, pixels // (h * w))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, np.stack([images[i] for i in some])


def weights(size: int, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear reduction of a side of `size` pixels, with half-pixel centres and no smoothing: the pixels it reads, and their weights (side x pixels) in units of 1/2048."""
    centre = np.clip((np.arange(side) + 0.5) * size / side - 0.5, 0, size - 1)
    low = np.floor(centre).astype(np.int64)
    high = np.minimum(low + 1, size - 1)
    share = np.rint((centre - low) * UNIT).astype(np.int64)
    pixels = np.unique(np.concatenate([low, high]))
    matrix = np.zeros((side, len(pixels)), np.int64)
    np.add.at(matrix, (np.arange(side), np.searchsorted(pixels, low)), UNIT - share)
    np.add.at(matrix, (np.arange(side), np.searchsorted(pixels, high)), share)
    return pixels, matrix


def reduced(images: list[np.ndarray | None], side: int = SIDE) -> list[bytes | None]:
    """Each image as side x side bytes. At most four pixels are read for one byte, so a large image costs no more than a small one."""
    out: list[bytes | None] = [None] * len(images)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, image in enumerate(images):
        if image is not None:
            shapes.setdefault(image.shape, []).append(i)
    for (h, w), places in shapes.items():
        rows, down = weights(h, side)
        cols, across = weights(w, side)
        for at in range(0, len(places), 4096):
            some = places[at : at + 4096]
            parts = np.stack([images[i][np.ix_(rows, cols)] for i in some]).astype(np.float64)  # products stay under 2^53
            small = (down.astype(np.float64) @ parts @ across.T.astype(np.float64)).astype(np.int64)
            small = (small + UNIT * UNIT // 2) // (UNIT * UNIT)
            for i, image in zip(some, small.astype(np.uint8)):
                out[i] = image.tobytes()
    return out


def with_fingerprint(rasters: DataFrame, name: str = "fingerprint") -> DataFrame:
    """The columns of rasters without px, and the MD5 of each frame reduced to 16x16; null where the raster is null or of another size than it says.

    Weights are units of 1/2048 and bytes are rounded half up. A column called as the result is replaced.
    """
    rasters = binary(rasters)
    kept = [f for f in rasters.schema.fields if f.name not in ("px", name)]
    small = T.StructType([*kept, T.StructField("_small", T.BinaryType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(reduced(views(b)), pa.binary())], names=small.names)

    return rasters.mapInArrow(run, small).withColumn(name, F.md5("_small")).drop("_small")


def distinct_frames(rasters: DataFrame, key: str, order: str) -> DataFrame:
    """(key, fingerprint, order, copies): the first frame, by `order`, of each 16x16 fingerprint within a key. Frames without a fingerprint are left out.

    A null key is a key. Partial aggregation, so that copies of a third of all frames are a row a task.
    """
    found = with_fingerprint(rasters.select(key, order, "px", "width", "height")).where("fingerprint is not null")
    return found.groupBy(key, "fingerprint").agg(F.min(order).alias(order), F.count("*").alias("copies"))
