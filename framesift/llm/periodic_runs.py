"""Periodic runs of words, found in an enhanced suffix array, and texts without a run's repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(least, power * q) words
long, that neither neighbouring word extends. Documents of a batch share one suffix array, in which suffixes of different documents never share a word:

1. Prefix doubling sorts the suffixes; only those that are still tied are sorted again. The ranks of each round are kept and give
   the LCP array by binary lifting, for those neighbours alone that a later round told apart.
2. Every LCP interval is a pair of nearest smaller LCP values; no tree is built. An interval of depth d holds the suffixes that begin with the same d
   words. For each suffix j in all of its children but the largest, the inverse suffix array tells whether j + d or j - d lies in the interval
   but in another child: that is the branching square of period d, which ends where its run ends. An enumerated suffix at least doubles its set with each
   interval, so there are O(n log n) tests. A run of `power` periods puts `power` suffixes into its interval and has power squares' worth of
   starts before it, so smaller intervals are passed over and squares without those starts are dropped. That loses no run.
3. The rightmost square is rotated to the left while words agree, which gives the run. Squares of a multiple of a run's
   period that end with it are the same run.

Rows need no other rows: there is no shuffle, no key, and a lost executor repeats its own rows. Memory is bounded by a batch
(`batch_words`) or the longest document: some 4 bytes a word for each doubling of its longest repeat, and some 200 a word besides.

Null and empty texts have no words and no runs. Repeated rows are judged apart. Ids may be null. Ties of the greatest exponent go to the
smallest start, then the smallest period. An empty table gives an empty result. Columns but `text` and the carried ones are ignored; a carried column
named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framesift.llm.common import words

RESULT = (
    T.StructType().add("n_words", "long").add("n_runs", "long").add("start", "long").add("length", "long").add("period", "long")
    .add("exponent_milli", "long").add("runs", T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long")))
    .add("runs_sha256", "string").add("collapsed_text", "string")
)


class _Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def suffix_array(key: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes, place of each, and LCP of each with the one before. ends[i] is where i's document ends; documents share no key."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order][1:] != key[order][:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, lcp, width = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], np.zeros(n, np.int64), 1
    slots = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(slots):
        at = order[slots]
        after = at + width
        keys = rank[at] * (n + 1) + np.where(after < ends[at], rank[after], -1) + 1
        turn = np.argsort(keys, kind="stable")
        at, keys = at[turn], keys[turn]
        order[slots] = at
        first = np.ones(len(slots), bool)
        first[1:] = keys[1:] != keys[:-1]
        lcp[slots[first & (keys // (n + 1) != slots)]] = width
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        levels.append(rank.astype(levels[0].dtype))
        slots = slots[~(first & np.append(first[1:], True))]
        width *= 2
    rank[order] = np.arange(n)
    for level in range(len(levels) - 3, -1, -1):  # told apart between 2^k and 2^(k+1) words: the bits below k are open
        slots = np.flatnonzero(lcp >= 2 << level)
        a, b = order[slots - 1] + lcp[slots], order[slots] + lcp[slots]
        lcp[slots] += (levels[level][a] == levels[level][b]).astype(np.int64) << level
    return order, rank, lcp


def _nearest_smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place of `at` (those with LCP above 0), the nearest place in the direction of step whose LCP is smaller."""
    jump = np.arange(len(lcp)) + step
    left = at
    while len(left):
        to = jump[left]
        high = lcp[to] >= lcp[left]
        left, to = left[high], to[high]
        jump[left] = jump[to]
    return jump[at]


def branching_squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray, sizes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of the squares that no word to the right extends and that begin with `power` periods, by end, then period.

    sizes[i] is the number of words of i's document.
    """
    n = len(order)
    at = np.flatnonzero(lcp > 0)
    bounded = np.append(lcp, 0)
    lo, hi = _nearest_smaller(bounded, at, -1), _nearest_smaller(bounded, at, 1)
    fits = (hi - lo >= power) & (lcp[at] * power <= sizes[order[at]])
    at, lo, hi = at[fits], lo[fits], hi[fits]
    if not len(at):
        return at, at
    turn = np.argsort(lo * (n + 1) + hi, kind="stable")
    at, lo, hi = at[turn], lo[turn], hi[turn]
    head = np.ones(len(at), bool)
    head[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    heads = np.flatnonzero(head)
    # children in order: the one before an interval's first split, then the one after each split
    place = np.arange(len(at)) + np.cumsum(head)
    starts, interval = np.empty(len(at) + len(heads), np.int64), np.repeat(np.arange(len(heads)), np.diff(heads, append=len(at)) + 1)
    starts[place] = at
    starts[place[heads] - 1] = lo[heads]
    stops = np.append(starts[1:], 0)
    lasts = np.append(place[heads][1:] - 2, len(starts) - 1)
    stops[lasts] = hi[heads]
    big = stops - starts
    most = np.maximum.reduceat(big, place[heads] - 1)[interval]
    largest = np.flatnonzero(big == most)
    largest = largest[np.append(True, interval[largest][1:] != interval[largest][:-1])]
    small = np.ones(len(starts), bool)
    small[largest] = False
    starts, stops, interval = starts[small], stops[small], interval[small]
    of = np.repeat(np.arange(len(starts)), stops - starts)
    ahead = np.cumsum(stops - starts) - (stops - starts)
    suffix = order[starts[of] + np.arange(len(of)) - ahead[of]]
    depth, low, high = lcp[at[heads]], lo[heads], hi[heads]
    d = depth[interval[of]]

    def inside(i, k):
        found = np.where((i >= 0) & (i < n), rank[np.clip(i, 0, n)], -1)
        return found, (found >= low[k]) & (found < high[k])

    out_end, out_d = [], []
    for other, first in ((suffix + d, suffix), (suffix - d, suffix - d)):
        found, good = inside(other, interval[of])
        good &= (found < starts[of]) | (found >= stops[of])
        k, i, q = interval[of][good], first[good], d[good]
        for back in range(1, power - 1):
            held = inside(i - back * q, k)[1]
            k, i, q = k[held], i[held], q[held]
        out_end.append(i + 2 * q)
        out_d.append(q)
    found = np.unique(np.concatenate(out_end) * (n + 1) + np.concatenate(out_d))
    return found // (n + 1), found % (n + 1)


def find_runs(docs: list[list[int]], least: int = 6, power: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence of numbers, by start, then period. power is 3 or more."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    counts = np.array([len(x) for x in docs], np.int64)
    if not counts.sum():
        return out
    values = np.concatenate([np.asarray(x, np.int64) for x in docs])
    doc = np.repeat(np.arange(len(docs)), counts)
    ends = np.cumsum(counts)
    key = doc * (int(values.max()) + 1) + values
    order, rank, lcp = suffix_array(key, ends[doc])
    seen: list[tuple[int, int]] = []  # (start, period) of the runs that end at `last`
    last = -1
    for end, q in zip(*(x.tolist() for x in branching_squares(order, rank, lcp, counts[doc], power))):
        if end != last:
            last = end
            seen.clear()
        if any(q % p == 0 and end - 2 * q >= s for s, p in seen):
            continue
        k = int(doc[end - 1])
        floor = int(ends[k] - counts[k])
        start, step = end - power * q, max(q, 64)
        while start > floor:  # rotate to the left, in growing steps
            step = min(2 * step, start - floor)
            differ = np.flatnonzero(key[start - step : start] != key[start - step + q : start + q])
            start = start - step if not len(differ) else start - step + int(differ[-1]) + 1
            if len(differ):
                break
        seen.append((start, q))
        if end - start >= max(least, power * q):
            out[k].append((start - floor, end - start, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; the first of those."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(text_words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(text_words)
    step = np.zeros(len(text_words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    keep = np.cumsum(step[:-1]) == 0
    return b" ".join([w for w, k in zip(text_words, keep.tolist()) if k])


def looped(text_words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words of a document that its id chooses (crc32 of the decimal id divisible by ten): from word a on, the first p of them over and over."""
    if doc_id is None or not text_words:
        return text_words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text_words
    n, g = len(text_words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return text_words[:a] + (text_words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(
    docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), change: tuple[str, Callable] | None = None, least: int = 6, power: int = 4, batch_words: int = 1 << 19
) -> DataFrame:
    """The columns `carry` of every row of docs and those of RESULT: all runs, the greatest, and the collapsed text.

    `change` is a column and a function of (words, its value) that replaces a document's words before they are searched.
    """
    carried = [c for c in carry if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in carried] + RESULT.fields)
    extra = [change[0]] if change and change[0] not in carried else []
    runs_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def result(kept: pa.Table, texts: list[list[bytes]], numbered: list[list[int]]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in RESULT.names]
        for w, runs in zip(texts, find_runs(numbered, least, power)):
            best = greatest(runs)
            lines = "".join([f"{s},{n},{q}\n" for s, n, q in runs])
            row = (len(w), len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], [dict(zip(("start", "length", "period"), r)) for r in runs],
                   hashlib.sha256(lines.encode()).hexdigest(), collapsed(w, runs))
            for col, x in zip(cols, row):
                col.append(x)
        types = [pa.int64()] * 6 + [runs_type, pa.string()]
        made = [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array(cols[-1], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*(kept.column(c).combine_chunks() for c in carried), *made], names=schema.names)

    def run(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            values = b.column(change[0]) if change else None
            texts, numbered, numbers, total, begun = [], [], _Numbers(), 0, 0
            for i, text in enumerate(b.column("text")):
                w = words(text.as_py())
                if change:
                    w = change[1](w, values[i].as_py())
                texts.append(w)
                numbered.append(list(map(numbers.__getitem__, w)))
                total += len(w)
                if total >= batch_words:
                    yield result(table.slice(begun, i + 1 - begun), texts, numbered)
                    texts, numbered, numbers, total, begun = [], [], _Numbers(), 0, i + 1
            if texts:
                yield result(table.slice(begun), texts, numbered)

    return docs.select(*carried, *extra, *([] if "text" in carried + extra else ["text"])).mapInArrow(run, schema)
