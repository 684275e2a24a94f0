"""Substring dedup: words covered by a window of `width` words that starts at two or more places are removed.

Rows are dealt to blocks by a number of their own, which a written table holds, so that repeated rows are spread like others and
blocks are as many as the texts' bytes and the rows ask for. Three passes over the blocks, which one shuffle lays out:

1. Each block sketches its windows: for each row of a count-min sketch, the sorted cells it touches with their
   counts (1, or 2 for more). Cell ranges go to shards; a shard adds up what the blocks sent and answers, for
   each block, which of its cells hold two or more. An answer is one bit a cell. The sketch has as many cells
   as a few times the windows, so it grows with the input, and no shard or message does.
2. A window is estimated repeated if all its cells are. The estimate is never too low, so no repeated window is
   missed. Only those windows send a 96-bit fingerprint to its shard, which groups them exactly and answers in bits.
3. Each block marks the words that repeated windows cover.

A block's windows are counted before they leave it, so a passage in a third of all documents costs a shard one
entry a block. A block holds about `block_bytes` of text; only one document longer than that makes it larger.

Null and empty texts have no words; texts of fewer than `width` words lose none. Repeated rows count as separate
documents. Ids may be null or repeated. A carried column called n_words, n_removed or kept_text is replaced; other names may clash
with none. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.common import hashed_words, materialize, mix64, rolling

#: Cells of one shard's range, as a power of two: the least and the most, which one task holds as bytes.
SHARD_BITS, MOST_BITS = 22, 26
#: Odd multipliers of the two window hashes, and seeds of the two word mixes.
BASES, SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0x243F6A8885A308D3, 0x13198A2E03707344)
REPLY = "block long, kind int, shard long, bits binary"


def pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as compressed differences, low and high bytes apart."""
    d = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint32)
    if len(d) and d.max() < 1 << 16:
        return b"2" + zstandard.compress(d.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)
    return b"4" + zstandard.compress(d.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    n, kind = int(blob[:1]), f"<u{blob[:1].decode()}"
    planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(n, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=np.uint32)


class Windows:
    """The windows of a block's documents (UTF-8, null as empty), as two 64-bit hashes each."""

    def __init__(self, texts: list[bytes | None], width: int):
        self.texts = [t or b"" for t in texts]
        h, self.sizes = hashed_words(self.texts)
        sizes, ends = self.sizes, np.cumsum(self.sizes)
        self.width, self.starts_of, self.total = width, ends - sizes, len(h)
        last = np.repeat(ends, sizes)[: max(0, len(h) - width + 1)]
        self.at = np.flatnonzero(last - np.arange(len(last)) >= width)
        self.h1, self.h2 = (mix64(rolling(mix64(h, s), width, b)[self.at], s) for s, b in zip(SEEDS, BASES))

    def cells(self, row: int, n_cells: int) -> np.ndarray:
        """Cell of each window in a row of the sketch: high bits of the product with the number of cells."""
        h = mix64(self.h1 ^ self.h2, row + 1)
        high, low, n = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF), np.uint64(n_cells)
        if n_cells >= 1 << 32:
            return h % n
        return (high * n + (low * n >> np.uint64(32))) >> np.uint64(32)

    def kept(self, repeated: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Removed words and the remaining ones joined by a space, of each document."""
        step = np.zeros(self.total + 1, np.int64)
        at = self.at[repeated]
        step[at] += 1
        np.subtract.at(step, at + self.width, 1)
        gone = np.cumsum(step[:-1]) > 0
        removed, left = [], []
        for w, start in zip(map(bytes.split, self.texts), self.starts_of):
            mask = gone[start : start + len(w)]
            removed.append(n := int(mask.sum()))
            left.append(b" ".join(w) if not n else b" ".join([x for x, m in zip(w, mask.tolist()) if not m]))
        return removed, left


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and whether each has two or more windows."""
    cells = np.sort(cells)
    first = np.ones(len(cells), bool)
    first[1:] = cells[1:] != cells[:-1]
    at = np.flatnonzero(first)
    return cells[at], np.diff(at, append=len(cells)) > 1


def _placed(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and the place of each window's cell among them. Cell and window are sorted as one number while both fit."""
    bits = len(cells).bit_length()
    if len(cells) and int(cells.max()) >> 64 - bits:
        order = np.argsort(cells)
    else:
        order = (np.sort(cells << np.uint64(bits) | np.arange(len(cells), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    ordered = cells[order]
    first = np.ones(len(cells), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(cells), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def _ranges(shards: np.ndarray):
    if len(shards):
        edge = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip(np.append(0, edge), np.append(edge, len(shards))):
            yield int(shards[a]), int(a), int(b)


def _messages(docs: pa.Table, out: list[tuple[int, bytes]]) -> pa.Table:
    block = docs.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(out), pa.int64()), "shard": pa.array([x for x, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})


def _bits(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: b for k, s, b in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "bits"))) if k == kind}


def _answers(found: np.ndarray, shards: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(found), bool)
    for shard, a, b in _ranges(shards):
        out[a:b] = np.unpackbits(np.frombuffer(replies[shard], np.uint8), count=b - a).astype(bool)
    return out


class _Job:
    """What every pass has to know."""

    def __init__(self, width: int, depth: int, n_cells: int, bits: int, columns: list[str]):
        self.width, self.depth, self.n_cells, self.bits, self.columns = width, depth, n_cells, bits, columns
        self.per_row = -(-n_cells >> bits) + 1

    def sketch(self, docs: pa.Table) -> pa.Table:
        """Messages of a block: (block, shard, blob), a shard for each range of each row's cells."""
        w = Windows(docs.column("text").cast(pa.binary()).to_pylist(), self.width)
        out = []
        for row in range(self.depth):
            found, twice = _distinct(w.cells(row, self.n_cells))
            local = ((found & np.uint64((1 << self.bits) - 1)) << np.uint64(1) | twice.astype(np.uint64)).astype(np.uint32)
            for shard, a, b in _ranges(found >> np.uint64(self.bits)):
                out.append((row * self.per_row + shard, pack(local[a:b])))
        return _messages(docs, out)

    def estimated(self, w: Windows, replies: dict[int, bytes]) -> np.ndarray:
        """Windows whose cell holds two or more in every row."""
        full = np.ones(len(w.at), bool)
        for row in range(self.depth):
            found, place = _placed(w.cells(row, self.n_cells))
            full &= _answers(found, (found >> np.uint64(self.bits)) + np.uint64(row * self.per_row), replies)[place]
        return np.flatnonzero(full)

    def suspects(self, w: Windows, replies: dict[int, bytes]):
        """Windows estimated repeated, their distinct fingerprints in order, whether each is twice here, shard of each, and place of each window's."""
        which = self.estimated(w, replies)
        keys = np.empty(len(which), [("a", ">u8"), ("b", ">u4")])
        keys["a"], keys["b"] = w.h1[which], w.h2[which] >> np.uint64(32) & np.uint64(0xFFFFFFFE)
        raw = keys.view("S12")  # big-endian, so bytes sort as numbers; trailing zero bytes only pad
        found, place, n = np.unique(raw, return_inverse=True, return_counts=True)
        found = found.view(keys.dtype)
        parts = max(1, self.per_row * self.depth)
        shards = (found["a"].astype(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        return which, found, n > 1, shards, place

    def fingerprints(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        w = Windows(docs.column("text").cast(pa.binary()).to_pylist(), self.width)
        _, found, twice, shards, _ = self.suspects(w, _bits(replies, 0))
        found = found.copy()
        found["b"] |= twice
        return _messages(docs, [(shard, found[a:b].tobytes()) for shard, a, b in _ranges(shards)])

    def removal(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        w = Windows(docs.column("text").cast(pa.binary()).to_pylist(), self.width)
        which, found, _, shards, place = self.suspects(w, _bits(replies, 0))
        repeated = np.zeros(len(w.at), bool)
        repeated[which] = _answers(found, shards, _bits(replies, 1))[place]
        removed, left = w.kept(repeated)
        out = {c: docs.column(c) for c in self.columns}
        out |= {"n_words": pa.array(w.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(left, pa.binary()).cast(pa.string())}
        return pa.table(out)


def _reply(kind: int, table: pa.Table, masks: list[np.ndarray]) -> pa.Table:
    n = len(masks)
    return pa.table({"block": table.column("block"), "kind": pa.array([kind] * n, pa.int32()), "shard": table.column("shard"), "bits": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())})


def _merge_sketch(bits: int):
    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        cells = np.zeros(1 << bits, np.uint8)
        for blob in blobs:
            x = unpack(blob)
            at = x >> np.uint32(1)
            cells[at] = np.minimum(cells[at] + 1 + (x & np.uint32(1)).astype(np.uint8), 2)
        return _reply(0, table, [cells[unpack(blob) >> np.uint32(1)] > 1 for blob in blobs])

    return run


def _merge_exact(table: pa.Table) -> pa.Table:
    kind = np.dtype([("a", ">u8"), ("b", ">u4")])
    sent = [np.frombuffer(x, kind) for x in table.column("blob").to_pylist()]
    both = np.concatenate(sent)
    keys = both.copy()
    keys["b"] &= np.uint32(0xFFFFFFFE)
    _, place, n = np.unique(keys.view("S12"), return_inverse=True, return_counts=True)
    n[place[(both["b"] & np.uint32(1)).astype(bool)]] += 1
    again = n[place] > 1
    return _reply(1, table, np.split(again, np.cumsum([len(x) for x in sent])[:-1]))


def remove_repeats(docs: DataFrame, width: int = 35, depth: int = 2, cells_per_window: int = 4, block_bytes: int = 4 << 20, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of every row of docs, and n_words, n_removed, kept_text (kept words joined by one space)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-(size["bytes"] + 64 * size["rows"]) // block_bytes))
    bits = min(MOST_BITS, max(SHARD_BITS, SHARD_BITS + size["bytes"].bit_length() - 31))
    carried = [c for c in carry if c not in ("text", "n_words", "n_removed", "kept_text")]
    columns = (["kept"] if carried else []) + (["text"] if "text" in carry else [])
    job = _Job(width, depth, max(1 << bits, cells_per_window * size["bytes"] // 6), bits, columns)
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
    laid = materialize(docs.select(block, *([F.struct(*carried).alias("kept")] if carried else []), "text"), "substring-blocks", "zstd")
    message = "block long, shard long, blob binary"
    sent = laid.groupBy("block").applyInArrow(lambda t: job.sketch(t), message)
    estimates = sent.groupBy("shard").applyInArrow(_merge_sketch(bits), REPLY)
    suspects = laid.groupBy("block").cogroup(estimates.groupBy("block")).applyInArrow(lambda left, right: job.fingerprints(left, right), message)
    exact = suspects.groupBy("shard").applyInArrow(_merge_exact, REPLY)
    schema = T.StructType([laid.schema[c] for c in columns]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    out = laid.groupBy("block").cogroup(estimates.unionByName(exact).groupBy("block")).applyInArrow(lambda left, right: job.removal(left, right), schema)
    return out.select(*[F.col("text") if c == "text" else F.col("kept")[c].alias(c) for c in carry if c == "text" or c in carried], "n_words", "n_removed", "kept_text")
