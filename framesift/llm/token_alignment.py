"""Cross-tokenizer alignment: byte groups of two tokenizations, and corpus-wide counts of the id pairs that end together.

Tokenizer A is a byte-level vocabulary and encodes a space and the text; B is a piece vocabulary, which adds the space itself. Byte
offsets where a token of each ends cut both into groups; a group's last A and B token are linked, as no token is empty.

1. Texts are cut before a space or newline that follows other characters. No token of A crosses such a place, and none of B, whose vocabulary is checked
   for it, so a cut text has the tokens of the whole one. Each worker remembers the groups of recent pieces. A block (consecutive documents of a task,
   about `block_links` links) writes for each some documents a record list (pair, document, links) and, at its end, one zstd run for each
   radix: its distinct pairs with their links, in the order B's low bits (the radix), rest of B, A.
2. A radix is merged by one task: a heap holds the next chunk of each run, chunks are opened in order, and what lies before the heap's
   least B id is complete. Its pairs are added up, the highest count of each B id found, and each run gets its contributions in its own order: the counts
   and whether they are the highest. Runs are written tables (the shared folder), so they survive executors; the merge holds one open chunk a run.
3. Each block looks its documents' records up in the answers and adds up n_best and count_sum.

A pair sends one entry a block, however many links it has, so a frequent pair or B id loads no task more than others. The radix count grows with the input
(`radix_bytes` of text each, up to 16,384), so runs and merges stay of bounded size.

Null and empty texts, and texts whose joined token bytes differ from a space and the text, have no tokens: zeros and ''. Special tokens' strings
are plain text. Repeated rows count each. Ids may be null or repeated. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain, islice, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framesift.llm.common import materialize
from framesift.llm.packing import PATTERN

#: A piece: white space (space and newline only), then all up to the next of these.
PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
ODD_SPACE = re.compile(r"[^\S \n\t\r\v\f\x1c-\x1f]|\x85")
#: Pieces up to this length are remembered, about so many at a time.
LONG, MOST = 256, 300_000
#: White space of this length goes to `tokenizers`, as the other library is slow on it.
LONG_SPACE = re.compile(r"\s{5000}")
#: Bytes of text that are aligned together, and entries of a chunk of a run.
TEXT, CHUNK = 1 << 20, 1 << 13


class Aligner:
    """Groups of texts under both tokenizers, and their links as 32-bit pairs B * 65536 + A."""

    def __init__(self, path_a: str, ranks_a: str | None, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path_a)
        whole.encode_special_tokens = True
        self.slow_a = self.fast_a = lambda text: whole.encode(text, add_special_tokens=False).ids
        letters = {c: b for b, c in byte_letters().items()}
        vocabulary = whole.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        if ranks_a:
            import tiktoken

            with open(ranks_a, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast_a = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_a) > 1 << 16 or len(pieces) > 1 << 15:
            raise ValueError("ids of A must fit into 16 bits, those of B into 15")
        texts = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.cuts = not any(re.search(r"[^ ] |\n", p) for p in texts)
        self.lengths = np.array([len(x) for x in self.bytes_a], np.int64), np.array([len(x) for x in self.bytes_b], np.int64)
        # texts of A's ids inside and at the end of a group, then B's
        self.base = np.cumsum([0, len(self.bytes_a), len(self.bytes_a), len(pieces)])
        self.shown = np.array([f"{i}{c}".encode() for n, c in ((len(self.bytes_a), ","), (len(self.bytes_a), "|"), (len(pieces), ","), (len(pieces), ";")) for i in range(n)], object)
        self.space = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()  # of pieces, which are places in what follows
        self.groups: list[bytes] = []
        self.sizes, self.links, self.first = np.zeros((0, 2), np.int64), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def encode_a(self, text: str) -> list[int]:
        return self.slow_a(text) if len(text) >= 5000 and LONG_SPACE.search(text) else self.fast_a(text)

    def encode_b(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, which the model adds, or a newline, before which it adds one that goes."""
        if text.startswith(" "):
            return self.b.encode(text[1:])
        ids = self.b.encode(text)
        return ids[1:] if ids[:1] == [self.space] else []

    def pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Groups, tokens of A and B, number of links, and all links in order, of some pieces encoded as one text. A has -1 tokens where joined bytes are not the piece's."""
        text = "".join(texts)
        a, b, raw = self.encode_a(text), self.encode_b(text), text.encode()
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            if len(texts) == 1:
                return [b""], np.array([[-1, 0]]), np.zeros(1, np.int64), np.zeros(0, "<u4")
            each = list(zip(*(self.pieces([t]) for t in texts)))
            return [g for x in each[0] for g in x], *(np.concatenate(x) for x in each[1:])
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.lengths[0][ids_a]), np.cumsum(self.lengths[1][ids_b])
        mark = np.zeros((2, len(raw) + 1), bool)
        mark[0, ends_a], mark[1, ends_b] = True, True
        end_a, end_b = mark[1, ends_a], mark[0, ends_b]
        last_a, last_b = np.flatnonzero(end_a), np.flatnonzero(end_b)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.append(0, last_b + 1)[np.cumsum(end_a) - end_a]] = ids_a + self.base[end_a.astype(np.int64)]
        out[np.arange(len(b)) + (last_a + 1)[np.cumsum(end_b) - end_b]] = ids_b + self.base[2 + end_b]
        shown = self.shown[out].tolist()
        stops = np.cumsum([len(t) for t in texts] if text.isascii() else [len(t.encode()) for t in texts])
        at = np.array([np.searchsorted(e, stops, "right") for e in (ends_a, ends_b, ends_a[last_a])]).T
        edges = [0, *(at[:, 0] + at[:, 1]).tolist()]
        sizes = np.diff(at, axis=0, prepend=0)
        return [b"".join(shown[i:j]) for i, j in zip(edges, edges[1:])], sizes[:, :2], sizes[:, 2], (ids_b[last_b] << 16 | ids_a[last_a]).astype("<u4")

    def learn(self) -> None:
        """Encode the pieces that got a number since the last time, in order, many as one text. White space at a piece's end must not meet another piece."""
        new, some, size, found = list(islice(self.known, len(self.groups), None)), [], 0, []
        for p, following in zip_longest(new, new[1:]):
            some.append(p)
            size += len(p)
            if size >= 1 << 16 or following is None or p[-1] in " \n":
                found.append(self.pieces(some))
                size, some = 0, []
        if found:
            groups, sizes, n, links = zip(*found)
            self.groups += [g for x in groups for g in x]
            self.sizes, self.links = np.concatenate([self.sizes, *sizes]), np.concatenate([self.links, *links])
            self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate(n)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Tokens of A and B of each text, groups of each, number of links of each, and all links in order."""
        if len(self.known) > MOST:
            self.forget()
        numbers, long, again = [], [], {}
        for i, text in enumerate(texts):
            cut = []
            if text and "▁" not in text:  # that letter becomes a space in B
                text = " " + text
                cut = PIECE.findall(text) if self.cuts and not odd_space(text) else [text]
                if len(text) > LONG:
                    long += [p for p in cut if len(p) > LONG]
            numbers.append(list(map(self.known.__getitem__, cut)))
        self.learn()
        counts = np.array([len(x) for x in numbers], np.int64)
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(counts.sum()))
        edges = np.append(0, np.cumsum(counts))
        bad = np.append(0, np.cumsum(self.sizes[flat, 0] < 0))[edges]
        for i in np.flatnonzero(np.diff(bad)).tolist():
            again[i] = self.pieces([" " + texts[i]])
        groups = [again[i][0][0] if i in again else b"".join(map(self.groups.__getitem__, x)) for i, x in enumerate(numbers)]
        sizes = np.diff(np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(self.sizes[flat], axis=0)])[edges], axis=0)
        each = np.diff(self.first)[flat]
        ends = np.cumsum(each)
        links = self.links[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[flat] - ends + each, each)]
        n = np.diff(np.append(0, ends)[edges])
        if again:
            parts = np.split(links, np.cumsum(n)[:-1])
            for i, (_, size, count, found) in again.items():
                sizes[i], n[i], parts[i] = np.maximum(size[0], 0), count[0], found
            links = np.concatenate(parts)
        for p in long:
            self.known.pop(p, None)
        if long:
            self.forget()
        return sizes, groups, n, links


class _Numbers(dict):
    """Numbers of pieces in order of appearance."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def odd_space(text: str) -> bool:
    """White space but space and newline, which the two pattern languages may see differently: such texts are encoded whole."""
    return any(c in text for c in "\t\r\v\f\x1c\x1d\x1e\x1f") or not text.isascii() and ODD_SPACE.search(text) is not None


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def aligner(path_a: str, ranks_a: str | None, path_b: str) -> Aligner:
    """One a Python worker, for all its tasks."""
    return Aligner(path_a, ranks_a, path_b)


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def radix_order(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Pairs B * 65536 + A with B's low bits moved to the top: sorted, they are in order of radix, B, A."""
    low = pairs >> np.uint32(16) & np.uint32((1 << bits) - 1)
    return low << np.uint32(31 - bits) | (pairs >> np.uint32(16 + bits)) << np.uint32(16) | pairs & np.uint32(0xFFFF)


ROW = "block long, kind int, radix int, ids array<{id}>, a array<bigint>, b array<bigint>, links array<bigint>, digest array<string>, blob array<binary>"


def _blocks(docs: DataFrame, files: tuple, bits: int, block_links: int):
    """Rows of blocks. Kind 0: some documents with their record lists (sorted pairs; links of each, per document). Kind 1: a run of one radix, in chunks of pairs and links."""
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["block", "kind", "radix", "ids", "a", "b", "links", "digest", "blob"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(id_type), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.list_(pa.binary())]

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def runs(block, parts):
        """Zstd runs of the block's distinct pairs."""
        pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        links = np.zeros(len(pairs), np.int64)
        np.add.at(links, place, np.concatenate([n for _, n in parts]))
        shards = (pairs >> np.uint32(31 - bits)).astype(np.int64)
        edges = np.searchsorted(shards, np.arange((1 << bits) + 1))
        for radix in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = int(edges[radix]), int(edges[radix + 1])
            blob = [x for at in range(lo, hi, CHUNK) for x in (pack(pairs[at : min(hi, at + CHUNK)]), pack(links[at : min(hi, at + CHUNK)]))]
            yield row(block, 1, radix, None, None, None, None, None, blob)

    def run(batches):
        align = aligner(*files)
        block, total, parts = TaskContext.get().partitionId() << 32, 0, []
        for b in batches:
            lengths = pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            some = (np.cumsum(lengths) - lengths) // TEXT  # documents that are aligned together
            for i, j in _ranges(some):
                found = align(b.column("text").slice(i, j - i).to_pylist())
                sizes, groups, counts, links = found
                pairs = radix_order(links, bits)
                keys, n = np.unique(np.repeat(np.arange(j - i, dtype=np.uint64), counts) << np.uint64(32) | pairs, return_counts=True)
                doc, pairs = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
                each = np.bincount(doc, minlength=j - i)
                digests = [hashlib.sha256(g[:-1]).hexdigest() if g else "" for g in groups]
                ids = b.column("doc_id").slice(i, j - i).to_pylist()
                yield row(block, 0, 0, ids, sizes[:, 0].tolist(), sizes[:, 1].tolist(), counts.tolist(), digests, [pack(pairs), pack(n.astype(np.uint32)), pack(each.astype(np.uint32))])
                if len(pairs):
                    distinct, place = np.unique(pairs, return_inverse=True)
                    parts.append((distinct, np.bincount(place, n).astype(np.int64)))
                total += int(counts.sum())
                if total >= block_links:
                    yield from runs(block, parts)
                    block, total, parts = block + 1, 0, []
        if parts:
            yield from runs(block, parts)

    schema = ROW.format(id=docs.schema["doc_id"].dataType.simpleString())
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def merge_runs(runs: list[list[bytes]], threshold: int = 1 << 18) -> list[list[bytes]]:
    """Contributions to each run, a zstd piece at a time: corpus counts of its pairs with the lowest bit telling whether they are their B id's highest.

    A run is a list of chunks, pairs and links in turn, in order of B, then A. A heap holds each run's next chunk by its first pair; a B id is
    complete when no chunk in the heap begins with it or a smaller one.
    """
    out: list[list[bytes]] = [[] for _ in runs]
    open_chunk = lambda r, c: (unpack(runs[r][c], np.uint32), unpack(runs[r][c + 1], np.int64))
    heap = []
    for r in range(len(runs)):
        chunk = open_chunk(r, 0)
        heap.append((int(chunk[0][0]), r, 0, chunk))
    heapq.heapify(heap)
    waiting, size, least = [], 0, threshold
    while heap:
        _, r, c, chunk = heapq.heappop(heap)
        waiting.append((r, *chunk))
        size += len(chunk[0])
        if c + 2 < len(runs[r]):
            following = open_chunk(r, c + 2)
            heapq.heappush(heap, (int(following[0][0]), r, c + 2, following))
        if size < least and heap:
            continue
        limit = np.uint32(heap[0][0] >> 16 << 16) if heap else None
        done, kept = [], []
        for r, pairs, links in waiting:
            cut = len(pairs) if limit is None else int(np.searchsorted(pairs, limit))
            done.append((r, pairs[:cut], links[:cut]))
            if cut < len(pairs):
                kept.append((r, pairs[cut:], links[cut:]))
        waiting, size = kept, sum(len(p) for _, p, _ in kept)
        least = size + threshold
        done = [d for d in done if len(d[1])]
        if not done:
            continue
        pairs, place = np.unique(np.concatenate([p for _, p, _ in done]), return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, place, np.concatenate([n for _, _, n in done]))
        side = pairs >> np.uint32(16)
        heads = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        highest = np.repeat(np.maximum.reduceat(count, heads), np.diff(heads, append=len(count)))
        told = (count << 1 | (count == highest))[place]
        at = 0
        for r, p, _ in done:
            out[r].append(pack(told[at : at + len(p)]))
            at += len(p)
    return out


def _ranges(values: np.ndarray):
    """Ranges of equal neighbours."""
    edges = np.flatnonzero(np.diff(values)) + 1
    return zip(np.append(0, edges).tolist(), np.append(edges, len(values)).tolist()) if len(values) else ()


def _merge(table: pa.Table) -> pa.Table:
    answers = merge_runs(table.column("blob").to_pylist())
    return pa.table({"block": table.column("block"), "radix": table.column("radix"), "told": pa.array(answers, pa.list_(pa.binary()))})


def _sums(schema: T.StructType):
    id_type = to_arrow_type(schema["doc_id"].dataType)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = {c: [] for c in schema.names}
        parts = rows.column("kind").to_pylist()
        order = sorted(zip(answers.column("radix").to_pylist(), range(answers.num_rows)))
        told_by = answers.column("told")
        told = np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.int64) for _, i in order for x in told_by[i].as_py())])
        runs = sorted((rows.column("radix")[i].as_py(), i) for i, kind in enumerate(parts) if kind == 1)
        blobs = rows.column("blob")
        known = np.concatenate([np.zeros(0, np.uint32), *(unpack(x, np.uint32) for _, i in runs for x in blobs[i].as_py()[::2])])
        for i, kind in enumerate(parts):
            if kind:
                continue
            pairs, n, each = (unpack(x, np.uint32) for x in blobs[i].as_py())
            found = told[np.searchsorted(known, pairs)] if len(pairs) else told[:0]
            edges = np.append(0, np.cumsum(each.astype(np.int64)))
            sums = [np.append(0, np.cumsum(x))[edges] for x in ((found & 1) * n, (found >> 1) * n)]
            links = rows.column("links")[i].as_py()
            for name, values in zip(
                schema.names,
                (rows.column("ids")[i].as_py(), rows.column("a")[i].as_py(), rows.column("b")[i].as_py(), links, links, np.diff(sums[0]).tolist(), np.diff(sums[1]).tolist(), rows.column("digest")[i].as_py()),
            ):
                out[name] += values
        kinds = {"doc_id": id_type, "groups_sha256": pa.string()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return run


def align(docs: DataFrame, path_a: str, ranks_a: str | None, path_b: str, block_links: int = 1 << 23, radix_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    bits = min(14, max(4, (size // radix_bytes).bit_length()))
    rows = materialize(_blocks(docs, (path_a, ranks_a, path_b), bits, block_links), "token-runs")
    answers = rows.where("kind = 1").select("block", "radix", "blob").groupBy("radix").applyInArrow(_merge, "block long, radix int, told array<binary>")
    schema = T.StructType([docs.schema["doc_id"]])
    for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        schema = schema.add(c, "long")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sums(schema.add("groups_sha256", "string")), schema)
