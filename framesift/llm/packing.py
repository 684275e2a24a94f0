"""Packing token ids into sequences, filled with what a BM25 index retrieves for each seed.

A document's ids are cut into full windows, which are sequences of their own, and a tail. Tails are packed. They are
put in order of their rarest id (by document frequencies over all documents), so that tails that share it are
neighbours however many there are, and range-partitioned; each run of `shard_rows` tails has an inverted index of its own.
The longest unused tail is the seed of a window. Its highest-weighted ids are the query; unused tails fill the
window by falling BM25 score, then in order. The last tail is cut where the window ends and what is left of it stays
unused. What remains at the end of a partition is cut into sequences whose lengths are powers of two, which need no padding.

Null texts count as empty and have the closing id alone. Very long texts, runs of one character included, are encoded whole. Repeated rows and null ids are packed like others. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialize

#: White space of this length goes to `tokenizers`: the other library takes time with its square, and runs out of stack on some of 50,000.
LONG, LONG_SPACE = 10_000, re.compile(r"\s{10000}")
#: Most tasks that the tails are packed by.
TASKS = 20_000
#: Fixed value: the byte-level tokenizer's pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a text as 16-bit numbers, as the `tokenizers` file gives them.

    With `ranks`, the same vocabulary as byte-pair ranks, tiktoken encodes, which is several times as fast and gives the same
    ids. Texts with a special token's string or very long white space always go through `tokenizers`.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.special = [t for t in (x.content for x in tokenizer.get_added_tokens_decoder().values()) if t]
        self.exact = self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None, end: int = 0) -> np.ndarray:
        if not text:
            return np.array([end], "<u2")
        plain = not any(s in text for s in self.special) and (len(text) < LONG or not LONG_SPACE.search(text))
        ids = array("H", self.encode(text) if plain else self.exact(text))
        ids.append(end)
        return np.frombuffer(ids, "<u2")


@lru_cache(maxsize=1)
def encoder(path: str, ranks: str | None) -> Encoder:
    """One a Python worker, for all its tasks."""
    return Encoder(path, ranks)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, tokenizer: str, ranks: str | None, window: int) -> DataFrame:
    """A row for each document: its length, checksums of its full windows, its tail; and rows of document frequencies, a few for each task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, df = encoder(tokenizer, ranks), np.zeros(1 << 16, np.int64)
        for b in batches:
            out = [[], [], []]
            for text in b.column("text").to_pylist():
                ids = encode(text)
                full = len(ids) // window
                out[0].append(len(ids))
                out[1].append([crc(ids[k * window : (k + 1) * window]) for k in range(full)])
                out[2].append(ids[full * window :].tobytes())
                df[np.unique(ids)] += 1
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([some.tolist()], pa.list_(pa.int32())), pa.array([df[some].tolist()], pa.list_(pa.int64()))], names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow, names = to_arrow_type(docs.schema["doc_id"].dataType), ["doc_id", "doc_tokens", "crcs", "tail", "seen", "df"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, crcs array<bigint>, tail binary, seen array<int>, df array<bigint>")


class Shard:
    """An inverted index of tails, with the BM25 weight of each posting."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.n = len(tails)
        sizes = np.array([len(t) for t in tails], np.int64)
        keys = np.concatenate(tails).astype(np.int64) * self.n + np.repeat(np.arange(self.n), sizes)
        found, tf = np.unique(keys, return_counts=True)
        ids, self.rows = found // self.n, found % self.n
        self.weight = idf[ids] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[self.rows] / max(1.0, mean)))
        self.first = np.searchsorted(ids, np.arange(len(idf) + 1))
        order = np.lexsort((-self.weight, self.rows))
        self.of_row, self.row_first = ids[order], np.searchsorted(self.rows[order], np.arange(self.n + 1))

    def neighbours(self, row: int, terms: int, unused: np.ndarray) -> np.ndarray:
        """Unused rows by falling score for the highest-weighted ids of `row`; ties in order. Rows without any of them are left out."""
        query = self.of_row[self.row_first[row] : min(self.row_first[row + 1], self.row_first[row] + terms)]
        spans = [slice(self.first[t], self.first[t + 1]) for t in query.tolist()]
        score = np.bincount(np.concatenate([self.rows[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int, terms: int):
    """Windows as lists of (row, from, to), each full but what is left at the end, which comes last."""
    shard = Shard(tails, idf, mean)
    at, sizes = np.zeros(shard.n, np.int64), np.array([len(t) for t in tails], np.int64)
    seeds, next_free = np.argsort(-sizes, kind="stable").tolist(), 0
    ordered = 0
    for seed in seeds:
        while at[seed] < sizes[seed]:
            pieces, room = [], window

            def take(row):
                nonlocal room
                n = min(room, sizes[row] - at[row])
                if n:
                    pieces.append((row, int(at[row]), int(at[row] + n)))
                    at[row] += n
                    room -= n

            take(seed)
            if room:
                for row in shard.neighbours(seed, terms, at < sizes).tolist():
                    take(row)
                    if not room:
                        break
            while room and ordered < shard.n:
                take(ordered)
                ordered += room > 0
            yield pieces


def _packer(idf: np.ndarray, mean: float, window: int, shard_rows: int, terms: int, kind: pa.DataType):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        base, n_sequences, waiting, rest = TaskContext.get().partitionId() << 40, 0, [], []

        def sequence(parts):
            """parts: (doc_id, doc_tokens, start, ids)"""
            nonlocal n_sequences
            offset, rows = 0, []
            for doc, tokens, start, ids in parts:
                rows.append((doc, start, len(ids), crc(ids), tokens, base + n_sequences, offset))
                offset += len(ids)
            n_sequences += 1
            return rows

        def flush():
            rows = []
            tails = [w[3] for w in waiting]
            for pieces in fill(tails, idf, mean, window, terms):
                parts = [(waiting[r][0], waiting[r][1], waiting[r][2] + a, tails[r][a:b]) for r, a, b in pieces]
                if sum(len(p[3]) for p in parts) == window:
                    rows += sequence(parts)
                else:
                    rest.extend(parts)
            waiting.clear()
            return rows

        def out(rows):
            cols = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(cols)], names)

        for b in batches:
            for doc, tokens, tail in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "tail"))):
                ids = np.frombuffer(tail, "<u2")
                waiting.append((doc, tokens, tokens - len(ids), ids))
                if len(waiting) >= shard_rows:
                    yield out(flush())
        if waiting:
            yield out(flush())
        left, rows = sum(len(p[3]) for p in rest), []
        while left:  # at most a window for each shard of the partition
            size, parts = min(window, 1 << (left.bit_length() - 1)), []
            left -= size
            while size:
                doc, tokens, start, ids = rest[0]
                n = min(size, len(ids))
                parts.append((doc, tokens, start, ids[:n]))
                size -= n
                if n == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = (doc, tokens, start + n, ids[n:])
            rows += sequence(parts)
        yield out(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = 1024, shard_rows: int = 1024, terms: int = 16, rows_per_task: int = 4096) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(encoded(docs, tokenizer, ranks, window), "packing-ids")
    counts = rows.where("seen is not null").select(F.explode(F.arrays_zip("seen", "df")).alias("x")).groupBy("x.seen").agg(F.sum("x.df").alias("df")).collect()  # one row an id of the vocabulary
    whole = rows.where("doc_tokens is not null")
    tails = whole.where(F.octet_length("tail") > 0).select("doc_id", "doc_tokens", "tail")
    size = tails.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.octet_length("tail") / 2), F.lit(0.0)).alias("mean")).first()
    total = whole.count()
    df = np.zeros(1 << 16)
    for r in counts:
        df[r["seen"]] = r["df"]
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    arrow = encoded_id(docs)

    def keyed(batches):
        for b in batches:
            found = [np.frombuffer(t, "<u2") for t in b.column("tail").to_pylist()]
            rare = [int(ids[np.lexsort((ids, -idf[ids]))[0]]) for ids in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rare, pa.int32())], ["doc_id", "doc_tokens", "tail", "rarest"])

    tasks = max(1, min(TASKS, -(-size["n"] // rows_per_task)))
    order = ["rarest", "doc_tokens", F.xxhash64("tail", "doc_id")]
    placed = tails.mapInArrow(keyed, f"doc_id {kind}, doc_tokens long, tail binary, rarest int").repartitionByRange(tasks, *order).sortWithinPartitions(*order, "doc_id")
    packed = placed.select("doc_id", "doc_tokens", "tail").mapInArrow(_packer(idf, size["mean"], window, shard_rows, terms, arrow), PIECE.format(id=kind))
    full = whole.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32"))
    place = F.monotonically_increasing_id()  # the rows come from a written table
    alone = full.select("doc_id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (-1 - place).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def encoded_id(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
