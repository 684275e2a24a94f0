"""Benchmark decontamination by latent semantic retrieval.

Terms are hashed words in lower case. Their inverse document frequencies come from all documents. A randomised SVD
of TF-IDF passages (all documents' and, weighted to a product of the same norm, the benchmark's) gives a latent basis: in the pass that counts documents, tasks
multiply their passages with a random matrix and back again, and the products are added up; the driver does so with one block's items, adds
both, and orthonormalises the terms-by-rank matrix. Every passage of every document is then projected on the items' terms. A passage is a candidate for an
item if their cosine reaches `near` and the passage has a share `cover` of the item's length along the item's direction. Around candidates
texts are compared word by word, in windows of as many words as the item and SLACK more, one at every STEP-th word: the
longest common subsequence of the item, and that of its last sentence, its answer. A document is contaminated by
an item if in one window `alone` of the item is found in order, or `with_answer` of it with `answer` of its answer.

Null and empty texts and items match nothing. Very long texts are read in pieces. Repeated rows each get their rows, and repeated items too. Ids may be null. With
no benchmark or no documents the result is empty. `contaminated` ignores other columns; `without_contaminated` keeps them all, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialize, mix64

BITS = 16
#: Words of a passage, and from one passage to the next.
PASSAGE, STRIDE = 32, 16
#: Words of an item that one target covers; longer items have several, that overlap by half.
TARGET = 64
#: Words that a window has beside an item's own, and from one window to the next.
SLACK, STEP = 64, 8
#: Bytes of items' texts searched in one pass over the documents; more take more passes. A worker holds the texts, their terms, and 640 bytes for every 32 words.
BLOCK = 24 << 20
#: Products of passages and targets at once.
PRODUCTS = 1 << 22
SENTENCE = re.compile(r"[.!?]\s+|\n+")


BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; longer texts are cut at white space.
PIECE = 1 << 22


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    row = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return row(BASE), row(pow(BASE, -1, 1 << 64))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of data, which ends in a space, and a term for each: differences of a running polynomial, mixed."""
    raw = np.frombuffer(data, np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = powers(1 << max(20, (len(raw) - 1).bit_length()))
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    return start, (mix64(h, 0) >> np.uint64(64 - BITS)).astype(np.int64)


def hashed_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all words of the texts, one text after the other, and how many each has."""
    whole = [(t.lower().encode() if t else b"") + b" " for t in texts]
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(whole):
        if len(t) <= PIECE:
            continue
        cut, whole[i] = 0, b" "
        while cut < len(t):  # a very long text by itself, in pieces that end in white space
            end = min(len(t), cut + PIECE)
            while end < len(t) and not SPACE[t[end - 1]]:
                end += 1
            parts.append((i, _hashed(t[cut:end])[1]))
            cut = end
    start, terms = _hashed(b"".join(whole))
    edges = np.searchsorted(start, np.cumsum([len(t) for t in whole]))
    counts[:] = np.diff(edges, prepend=0)
    if parts:
        pieces = np.split(terms, edges[:-1])
        for i in {i for i, _ in parts}:
            pieces[i] = np.concatenate([x for k, x in parts if k == i])
            counts[i] = len(pieces[i])
        terms = np.concatenate(pieces)
    return terms, counts


def term_list(words: list[bytes]) -> np.ndarray:
    return _hashed(b" ".join(words) + b" ")[1]


class Parsed:
    """An item's words, its answer, and what comparing needs: the places of each word as bits."""

    def __init__(self, text: str):
        self.words = tokens(text)
        sentences = [x for x in SENTENCE.split(text) if x.strip()]
        self.answer = tokens(sentences[-1]) if sentences else self.words
        self.places, self.answer_places = places(self.words), places(self.answer)


parsed = lru_cache(maxsize=1024)(Parsed)


class Item:
    """An item's text and terms. It travels as its text; what comparing needs is made when a passage comes near, and only the last of these are kept."""

    def __init__(self, item_id, text: str):
        self.id, self.text = item_id, text
        self.terms = term_list(tokens(text)).astype(np.int32)

    def __reduce__(self):
        return Item, (self.id, self.text)


def places(words: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def lcs(n: int, masks: dict[bytes, int], around: list[bytes]) -> int:
    """Length of the longest common subsequence of n words, given by their places, and the words around; by bits of one number."""
    full = (1 << n) - 1
    v = full
    for w in around:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return (full ^ v).bit_count()


#: A term that no text has; it fills documents up to whole strides.
PAD = 1 << BITS


class Layout:
    """Documents' terms one after the other, each filled up to whole strides and one more, so that no passage spans two documents."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray):
        strides = -(-counts // STRIDE) + 1
        self.first = np.cumsum(strides) - strides
        self.terms = np.full(int(strides.sum()) * STRIDE, PAD, np.int64)
        self.terms[np.arange(len(terms)) + np.repeat(self.first * STRIDE - (np.cumsum(counts) - counts), counts)] = terms

    @staticmethod
    def passages(rows: np.ndarray) -> np.ndarray:
        """Each passage is a stride and the next."""
        return rows + np.concatenate([rows[1:], np.zeros_like(rows[:1])])

    def place(self, passage: int) -> tuple[int, int]:
        """The document of a passage, and the word where it starts there."""
        d = int(np.searchsorted(self.first, passage, "right")) - 1
        return d, (passage - int(self.first[d])) * STRIDE


def batches_of(texts: list[str | None], most: int = 1 << 20):
    """(place of the first, texts) of runs of texts with about `most` characters in all."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= most or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, n = i + 1, 0


def _project(terms: np.ndarray, row: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sums over strides of terms of the rows of `matrix` (row 0 is none) of the terms that have one."""
    r = row[terms].reshape(-1, STRIDE)
    some = np.flatnonzero(r.any(1))
    out = np.zeros((len(r), matrix.shape[1]), np.float32)
    for at in range(0, len(some), 2048):  # small enough for the processor's cache
        part = some[at : at + 2048]
        total = matrix[r[part, 0]]
        for j in range(1, STRIDE):
            total += matrix[r[part, j]]
        out[part] = total
    return out


def item_terms(items: list[Item]) -> np.ndarray:
    """For each term its row among the items' terms, from 1; 0 for others. Only these are projected: other terms add nothing to a passage's product with an item."""
    active = np.zeros(PAD + 1, bool)
    for item in items:
        active[item.terms] = True
    row = np.zeros(PAD + 1, np.int32)
    row[active] = np.arange(1, active.sum() + 1)
    return row


def scales(items: list[Item], row: np.ndarray) -> np.ndarray:
    """What the rows of the random matrix are multiplied with: less for terms that many of the items have, as the documents' weights are known only after the pass."""
    have = np.zeros(int(row.max()) + 1)
    for item in items:
        have[np.unique(row[item.terms])] += 1
    return np.log1p(len(items) / np.maximum(have, 1)).astype(np.float32)


def random_matrix(scale: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    found = np.random.default_rng(seed).standard_normal((len(scale), rank), dtype=np.float32) * scale[:, None]
    found[0] = 0
    return found


def add_products(layout: Layout, row: np.ndarray, start: np.ndarray, total: np.ndarray, strides: int = 1 << 14) -> None:
    """Adds C'C times `start` to total, where C has a row of counts of terms for each passage; so many strides at once."""
    size = len(layout.terms) // STRIDE
    for a in range(0, size, strides):
        b, low = min(size, a + strides), max(0, a - 1)  # a stride lies in two passages, its own and the one before
        terms = layout.terms[low * STRIDE : (b + 1) * STRIDE]
        y = Layout.passages(_project(terms, row, start))
        y[terms[::STRIDE] == PAD] = 0  # a stride of no document
        back = y[a - low : b - low]
        back = back + (y[: b - a] if low < a else np.concatenate([np.zeros_like(y[:1]), y[: b - a - 1]]))
        r = row[layout.terms[a * STRIDE : b * STRIDE]]
        hit = np.flatnonzero(r)
        order = hit[np.argsort((r[hit] - 1).astype(np.uint16), kind="stable")]
        r, stride = r[order], order // STRIDE
        for at in range(0, len(order), 4096):  # small enough for the processor's cache
            part = r[at : at + 4096]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            total[part[edge]] += np.add.reduceat(back[stride[at : at + 4096]], edge, axis=0)


def counted(docs: DataFrame, row: np.ndarray, scale: np.ndarray, rank: int, fit: Column) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `row`'s terms the documents that have it, and the products of those to `fit`; the first figure, of no term, is the number of documents.

    One pass over the documents. The random matrix goes to the tasks as its seed; products are added up by term in tasks, and the driver gets one row a term of the items at most.
    """
    n = len(scale)

    def run(batches):
        have, total = np.zeros(n, np.int64), np.zeros((n, rank))
        matrix = random_matrix(scale, rank)
        for b in batches:
            fitted = b.column(1).to_numpy(zero_copy_only=False)
            for start, texts in batches_of(b.column(0).to_pylist()):
                terms, counts = hashed_terms(texts)
                r, text = row[terms], np.repeat(np.arange(len(texts)), counts)
                have += np.bincount(np.unique((text * n + r)[r > 0]) % n, minlength=n)
                chosen = fitted[start : start + len(texts)]
                if not chosen.all():
                    terms, counts = terms[chosen[text]], counts[chosen]
                if len(terms):
                    add_products(Layout(terms, counts), row, matrix, total)
            have[0] += b.num_rows
        some = np.flatnonzero(have)
        rows = [x.tobytes() for x in total[some].astype(np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(have[some]), pa.array(rows, pa.binary())], ["t", "have", "row"])

    def add(key, table):
        rows = np.sum([np.frombuffer(x, np.float32) for x in table.column("row").to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
        have = pa.array([sum(table.column("have").to_pylist())], pa.int64())
        return pa.table([table.column("t").slice(0, 1), have, pa.array([rows.tobytes()], pa.binary())], ["t", "have", "row"])

    kinds = "t int, have bigint, row binary"
    got = docs.select("text", F.coalesce(fit, F.lit(False)).alias("fit")).mapInArrow(run, kinds).groupBy("t").applyInArrow(add, kinds).toArrow()
    have, product = np.zeros(n, np.int64), np.zeros((n, rank), np.float32)
    for t, h, values in zip(*(got.column(c).to_pylist() for c in got.column_names)):
        have[t], product[t] = h, np.frombuffer(values, np.float32)
    return have, product


def latent_basis(docs: DataFrame, items: list[Item], row: np.ndarray, rank: int, fit: Column) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies by term, and orthonormal columns (a row a term of `row`) that span most of the TF-IDF passages: a randomised range finder."""
    have, product = counted(docs, row, scales(items, row), rank, fit)
    weight = np.maximum(np.log((1.0 + have[0]) / (1.0 + have)), 0).astype(np.float32)
    weight[0] = 0
    idf = np.zeros(PAD + 1, np.float32)
    idf[row > 0] = weight[row[row > 0]]
    start, own = random_matrix(weight, rank), np.zeros((len(weight), rank))
    for at in range(0, len(items), 256):
        some = [i.terms for i in items[at : at + 256]]
        add_products(Layout(np.concatenate(some), np.array([len(t) for t in some])), row, start, own)
    own, product = own * weight[:, None], product * weight[:, None]
    if product.any() and own.any():
        own += product * (np.linalg.norm(own) / np.linalg.norm(product))
    used = np.flatnonzero(np.abs(own).sum(1))
    basis = np.zeros(own.shape, np.float32)
    if len(used):
        q, _ = np.linalg.qr(own[used])
        basis[used, : q.shape[1]] = q
    return idf, basis


class Targets:
    """Latent directions of the items, and what projects a document's passages."""

    def __init__(self, items: list[Item], row: np.ndarray, idf: np.ndarray, basis: np.ndarray):
        self.items, self.row = items, row
        weight = np.zeros(len(basis), np.float32)
        weight[row[row > 0]] = idf[np.flatnonzero(row)]
        self.projection = (basis * weight[:, None]).astype(np.float32)
        self._aim()

    def _aim(self) -> None:
        places = [(k, at) for k, item in enumerate(self.items) for at in range(0, max(1, len(item.terms) - TARGET // 2), TARGET // 2)]
        self.owner, self.origin = ([p[i] for p in places] for i in (0, 1))
        self.directions = np.empty((len(places), self.projection.shape[1]), np.float32)
        for i, (k, at) in enumerate(places):
            self.directions[i] = self.projection[self.row[self.items[k].terms[at : at + TARGET]]].sum(0)
        self.lengths = np.linalg.norm(self.directions, axis=1).astype(np.float32)
        self.directions /= np.maximum(self.lengths, 1e-9)[:, None]

    def __getstate__(self):
        return self.items, self.row, self.projection

    def __setstate__(self, state):
        self.items, self.row, self.projection = state
        self._aim()

    def candidates(self, layout: Layout, near: float, cover: float):
        """(passage, target) of passages with a term of the items, in order: cosine of at least `near`, and `cover` of the target's length along it."""
        some = np.flatnonzero(Layout.passages((self.row[layout.terms] > 0).reshape(-1, STRIDE).any(1)))
        if not len(some):
            return
        whole = Layout.passages(_project(layout.terms, self.row, self.projection))
        step = max(16, min(4096, PRODUCTS // len(self.directions)))
        for at in range(0, len(some), step):
            x = whole[some[at : at + step]]
            along = x @ self.directions.T
            least = np.maximum(near * np.linalg.norm(x, axis=1, keepdims=True), cover * self.lengths)
            p, d = np.nonzero(along >= np.maximum(least, 1e-9))
            cosine = along[p, d] / np.linalg.norm(x[p], axis=1)
            yield from zip((some[at + p]).tolist(), d.tolist(), cosine.tolist())


class Match:
    """Best match of each item in a document. A window has an item's words and SLACK more, and starts at every STEP-th word."""

    def __init__(self, alone: float, with_answer: float, answer: float):
        self.alone, self.with_answer, self.answer = alone, with_answer, answer

    def best(self, item: Item, words: list[bytes], low: int, high: int) -> tuple[float, float] | None:
        """(share of the item found in order, share of its answer) of the best window that starts in low..high and counts as contaminated."""
        n, low, about = len(item.terms), -(-max(0, low) // STEP) * STEP, parsed(item.text)
        size, around = n + SLACK, words[low : high + n + SLACK]
        known = list(accumulate(map(about.places.__contains__, around), initial=0))
        starts = [s for s in range(0, max(1, min(high - low, len(around))), STEP) if known[min(s + size, len(around))] - known[s] >= self.with_answer * n]
        if not starts or lcs(n, about.places, around[starts[0] : starts[-1] + size]) < self.with_answer * n:
            return None
        out = None
        for s in starts:
            near = around[s : s + size]
            found = lcs(n, about.places, near) / n
            if found >= self.with_answer and (out is None or found >= out[0]):
                told = lcs(len(about.answer), about.answer_places, near) / len(about.answer)
                if (found >= self.alone or told >= self.answer) and (out is None or (found, told) > out):
                    out = found, told
        return out

    def all(self, texts: list[str | None], targets: Targets, near: float, cover: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item) -> (found, answer found, cosine) of the contaminated texts."""
        terms, counts = hashed_terms(texts)
        layout, best, words, seen = Layout(terms, counts), {}, {}, {}
        for passage, target, cosine in targets.candidates(layout, near, cover):
            d, at = layout.place(passage)
            k, origin = targets.owner[target], targets.origin[target]
            item = targets.items[k]
            # the passage lies in the item from the target on, or some way into a window that holds the item
            low, high = at - origin - min(len(item.terms) - origin, TARGET) - SLACK, at - origin + PASSAGE
            if d not in words:
                words[d] = tokens(texts[d])
            low = max(low, seen.get((d, target), low))  # passages come in order, so windows before have been compared
            seen[d, target] = max(low, high)
            if low < high and (found := self.best(item, words[d], low, high)):
                known = best.get((d, k))
                if known is None or found > known[:2]:
                    best[d, k] = (*found, cosine)
        return best


def search(docs: DataFrame, targets: Targets, near: float, cover: float, match: Match) -> DataFrame:
    """Contaminated (doc_id, item, cosine, found, answer_found); item is the place among the targets' items."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out, ids = [[], [], [], [], []], b.column("doc_id").to_pylist()
            for start, texts in batches_of(b.column("text").to_pylist()):
                for (d, k), (found, told, cosine) in match.all(texts, targets, near, cover).items():
                    for column, x in zip(out, (ids[start + d], k, cosine, found, told)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field("doc_id").type), pa.array(out[1], pa.int32()), *[pa.array(c, pa.float64()) for c in out[2:]]], ["doc_id", "item", "cosine", "found", "answer_found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item int, cosine double, found double, answer_found double")


def _blocks(docs: DataFrame, benchmark: DataFrame, rank: int, sample_rows: int | None):
    """Targets of the benchmark's items, about BLOCK bytes of text at a time: the driver holds one block."""
    usable = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.rlike("text", F.lit(r"[^\x09-\x0D\x20]")))
    blocks = -(-(usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK)
    if not blocks:
        return
    fit = F.lit(True)
    if sample_rows is not None:
        fit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, docs.count())))
    for at in range(blocks):
        block = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == at).toLocalIterator()
        items = sorted((Item(r["item_id"], r["text"]) for r in block), key=lambda i: (str(i.id), i.text))
        if items:
            row = item_terms(items)
            yield Targets(items, row, *latent_basis(docs, items, row, rank, fit))


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 160, sample_rows: int | None = None, near: float = 0.4, cover: float = 0.25, alone: float = 0.7, with_answer: float = 0.5, answer: float = 0.8) -> DataFrame:
    """(doc_id, item_id, cosine, found, answer_found) of each document and each item that it contains.

    The benchmark is the query set: its items go out in blocks, two passes over the documents each. The latent basis is fitted on all documents, or on
    about `sample_rows` of them by hash, if asked.
    """
    spark = docs.sparkSession
    kinds = {"d": docs.schema["doc_id"].dataType.simpleString(), "i": benchmark.schema["item_id"].dataType.simpleString()}
    out = None
    for targets in _blocks(docs, benchmark, rank, sample_rows):
        found = search(docs, targets, near, cover, Match(alone, with_answer, answer))
        names = spark.createDataFrame([(k, i.id) for k, i in enumerate(targets.items)], "item int, item_id " + kinds["i"])
        rows = found.join(F.broadcast(names), "item").select("doc_id", "item_id", "cosine", "found", "answer_found")  # a short row an item of the block
        out = rows if out is None else materialize(out, "leaks").unionByName(rows)
    return spark.createDataFrame([], "doc_id {d}, item_id {i}, cosine double, found double, answer_found double".format(**kinds)) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 160, sample_rows: int | None = None, near: float = 0.4, cover: float = 0.25, alone: float = 0.7, with_answer: float = 0.5, answer: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item. Rows are judged one by one, so ids may be null or repeated."""
    match = Match(alone, with_answer, answer)

    def keep(targets: Targets, place: int):
        def run(batches):
            for b in batches:
                hit = np.zeros(b.num_rows, bool)
                for start, texts in batches_of(b.column(place).to_pylist()):
                    hit[[start + d for d, _ in match.all(texts, targets, near, cover)]] = True
                yield b.filter(pa.array(~hit))

        return run

    clean = docs
    for n, targets in enumerate(_blocks(docs.select("doc_id", "text"), benchmark, rank, sample_rows)):
        clean = (materialize(clean, "clean") if n else clean).mapInArrow(keep(targets, docs.columns.index("text")), docs.schema)
    return clean
