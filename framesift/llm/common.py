"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators.store import delete_path, new_folder, shared_dir


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. A `scratch` block of the library deletes what was written in it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and nothing refers to any more."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if shared_dir(spark).split(":", 1)[-1].lstrip("/") in folder:
                delete_path(spark, folder)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes outside 0x20 and 0x09-0x0D; null has none."""
    return text.encode().split() if text else []


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashed in one step: words of up to SHORT bytes that start in PIECE bytes. Each byte value has a random number, each place a power of an odd base, and its inverse.
SHORT, PIECE = 64, 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_OF_BYTE = mix64(np.arange(256, dtype=np.uint64), 0x5851F42D4C957F2D)
_POWERS, _INVERSES = (np.cumprod(np.r_[np.uint64(1), np.full(PIECE + SHORT, x, np.uint64)], dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of all texts in order, and the number of words of each text. Equal words have equal hashes in every text."""
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = (raw != 0x20) & (raw - np.uint8(9) > 4)
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    limits = np.cumsum([0] + [len(t) + 1 for t in texts])
    sizes = np.diff(np.searchsorted(starts, limits))
    out, n = np.empty(len(starts), np.uint64), ends - starts
    edges = np.searchsorted(starts, np.arange(0, len(raw) + PIECE, PIECE))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        piece = _OF_BYTE[raw[k * PIECE : (k + 1) * PIECE + SHORT]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _POWERS[: len(piece)], out=sums[1:])
        at, to = starts[a:b] - k * PIECE, np.minimum(ends[a:b] - k * PIECE, len(piece))
        out[a:b] = (sums[to] - sums[at]) * _INVERSES[at]
    for i in np.flatnonzero(n > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return mix64(out ^ n.astype(np.uint64), 0x14057B7E), sizes


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all windows of `width` values, by doubling."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    done, done_len, part, part_len, left = None, 0, h, 1, width
    while left:
        factor = np.uint64(pow(base, part_len, 1 << 64))
        if left & 1:
            if done is None:
                done, done_len = part, part_len
            else:
                n = len(part) - done_len
                done = done[:n] * factor + part[done_len:]
                done_len += part_len
        left >>= 1
        if left:
            part = part[:-part_len] * factor + part[part_len:]
            part_len *= 2
    return done[: len(h) - width + 1]


def crc_fold(column: str, n: int):
    """crc32 of a value as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string")) % n


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (u, v), by alternating large-star and small-star steps.

    Nothing but aggregates and joins; no neighbour list is gathered, so a node may have any number of links.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = None
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialize(small, name)
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
