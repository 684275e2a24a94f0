"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted on a bounded sample of labelled rows (the `sample_rows` with the smallest hash of their id) and
flattened into arrays, which numpy walks for a whole batch at once, one level a step.

Null text counts as empty, and empty texts are scored like any other. Repeated rows each get their row, null ids
too. Without usable labels every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.common import crc_fold

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
STOPS, SYMBOLS = b".,;:?'\"()-", b"#$%&*|<>{}[]=+~^_@/\\"
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
NAMES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "longest_word", "short_words", "upper", "digits",
    "stops", "symbols", "exclamations", "bars", "other_bytes", "distinct_words", "distinct_pairs", "top_word", "same_as_previous",
    "odd_word_ends", "log_lines", "line_length", "repeated_lines", "spaces", "distinct_by_root", "upper_words",
)


def statistics(text: str | None) -> list[float]:
    """The figures NAMES of one document."""
    raw = (text or "").encode()
    found = raw.split()
    n, size = len(found), max(1, len(raw))
    count = lambda which: len(raw) - len(raw.translate(None, which))
    letters = max(1, count(LETTERS))
    lengths = np.fromiter(map(len, found), np.int64, n) if n else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = Counter(found)
    pairs = len(set(zip(found, islice(found, 1, None))))
    same = sum(a == b for a, b in zip(found, islice(found, 1, None)))
    odd = sum(x[-1] not in LETTERS for x in found)
    loud = sum(map(bytes.isupper, found))
    w = max(1, n)
    return [
        np.log1p(len(raw)), np.log1p(n), lengths.mean(), lengths.std(), float(lengths.max()), (lengths <= 2).mean(), count(UPPER) / letters, count(DIGITS) / size,
        count(STOPS) / size, count(SYMBOLS) / size, raw.count(b"!") / size, raw.count(b"|") / size, 1 - letters / size, len(distinct) / w, pairs / max(1, n - 1), max(distinct.values(), default=0) / w, same / w,
        odd / w, np.log1p(len(lines)), len(raw) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), (raw.count(b" ") + raw.count(b"\n")) / size, len(distinct) / w**0.5, loud / w,
    ]


class Trees:
    """Boosted binary trees of one depth in heap order: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.cut, self.leaf, self.start = feature, cut, leaf, start

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the log loss; each level's histograms of all nodes come from one count a feature."""
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = [np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)]
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, inner = np.full(len(y), start), 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.zeros(wide)
            for f, b in enumerate(binned):
                key = (node - first) * bins + b
                gl = np.cumsum(np.bincount(key, g, wide * bins).reshape(wide, bins), 1)
                hl = np.cumsum(np.bincount(key, h, wide * bins).reshape(wide, bins), 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(wide), at] > best + 1e-9):
                    best[k] = gain[k, at[k]]
                    feature[t, first + k], cut[t, first + k] = f, edges[f][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        score += leaf[t, at]
    return Trees(feature, cut, leaf, start)


def labelled(labels: DataFrame, column: str, keep, most: int) -> DataFrame:
    """(doc_id, y) of at most `most` labelled ids that satisfy `keep`: those with the smallest hash. An id labelled twice counts once."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(F.lit(True) if keep is None else keep)
    return rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", keep=None, sample_rows: int = 20_000) -> Trees:
    """Fit on at most `sample_rows` labelled documents, of which only the statistics come to the driver."""
    wanted = F.broadcast(labelled(labels, column, keep, sample_rows))  # at most sample_rows short rows
    # an id that documents repeat counts once, with its first text in order
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], ["x", "y"])

    found = rows.select("text", "y").mapInArrow(run, "x array<double>, y int").toPandas()  # at most sample_rows
    x = np.array(found["x"].tolist(), float).reshape(-1, len(NAMES))
    order = np.lexsort([*x.T, found["y"].to_numpy()])  # the same trees in whatever order rows arrive
    return fit(x[order], found["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """All columns of docs, and quality_score (0 to 1). A column of docs of that name is replaced."""
    docs = docs.drop("quality_score")
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 2048):
                part = b.column(place).slice(at, 2048).to_pylist()
                out.append(model.scores(np.array([statistics(t) for t in part], float)))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def held_out(n: int, rest: int):
    return F.coalesce(crc_fold("doc_id", n) == rest, F.lit(False))
