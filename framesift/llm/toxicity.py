"""Toxicity by a classifier chain over words and word beginnings.

Categories have an order. Each has a logistic model over the presence of selected words and word beginnings and the
probabilities of the categories before it. In learning, a later model sees out-of-fold probabilities of the earlier
ones: those of models that were fitted without that row's fold. Models are fitted on a bounded sample: the
`sample_rows` labelled ids with the smallest hash.

The query's categories come from both label columns of the table: `unfit` (toxic, or of low quality), `toxic`, and `toxic_prose` (toxic in
an otherwise good text). A category whose label is null for a row counts as absent there.

Null texts count as empty; an empty text has the base rate's probability. Rows whose labels are all null are no labels. An id labelled twice counts once (the
larger of each category). Repeated rows each get their row, null ids too. With nothing to learn from, probabilities are 0. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialize

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that count as features beside the words themselves.
HEADS = (4, 5, 6)


def terms(text: str | None) -> set[str]:
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {w[:n] + "-" for w in words for n in HEADS if len(w) > n}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 12) -> np.ndarray:
    """Weights, the intercept last, by Newton steps on a penalised log loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """Selected terms and a model for each category, which also takes the earlier categories' probabilities."""

    def __init__(self, names: list[str], chosen: list[str], weights: list[np.ndarray]):
        self.names, self.weights = names, weights
        self.place = {t: i for i, t in enumerate(chosen)}
        self.words = {t for t in chosen if not t.endswith("-")}
        self.heads = {n: {t[:-1] for t in chosen if t.endswith("-") and len(t) == n + 1} for n in HEADS}

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.place)))
        for i, text in enumerate(texts):
            found = set(WORD.findall(text.lower())) if text else set()
            hits = found & self.words
            for n, heads in self.heads.items():
                if heads:
                    hits |= {w[:n] + "-" for w in found if len(w) > n and w[:n] in heads}
            x[i, [self.place[t] for t in hits]] = 1
        return x

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """A column for each category."""
        if not self.weights:
            return np.zeros((len(texts), len(self.names)))
        x = self.matrix(texts)
        out = np.zeros((len(texts), 0))
        for w in self.weights:
            out = np.hstack([out, apply(w, np.hstack([x, out]))[:, None]])
        return out


def choose(marked: DataFrame, target: str, most: int, least: int) -> list[str]:
    """The `most` terms that tell rows of the category from others best, by the z-score of the difference of their shares; at least 3."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(terms(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string())), b.column(1)], ["terms", "y"])

    n = marked.agg(F.count_if(target).alias("pos"), F.count_if(~F.col(target)).alias("neg")).first()
    pos, neg = max(1, n["pos"]), max(1, n["neg"])
    counts = marked.select("text", F.col(target).cast("int").alias("y")).mapInArrow(run, "terms array<string>, y int").select(F.explode("terms").alias("term"), "y")
    counts = counts.groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(F.col("n") >= least)
    share = F.col("n") / F.lit(float(pos + neg))
    there, elsewhere = F.col("a") / F.lit(float(pos)), (F.col("n") - F.col("a")) / F.lit(float(neg))
    z = F.abs(there - elsewhere) / F.sqrt(share * (1 - share) * F.lit(1 / pos + 1 / neg) + F.lit(1e-9))
    return [r["term"] for r in counts.where(z >= 3).orderBy(z.desc(), "term").limit(most).select("term").collect()]


def fit_chain(x: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of each category's model, and the out-of-fold probabilities (a column a category) that later models learned from."""
    weights, earlier = [], np.zeros((len(x), 0))
    for target in targets.T:
        inputs = np.hstack([x, earlier])
        weights.append(logistic(inputs, target))
        outside = np.zeros(len(x))
        for k in np.unique(fold):
            here = fold == k
            if not here.all():
                outside[here] = apply(logistic(inputs[~here], target[~here]), inputs[here])
        earlier = np.hstack([earlier, outside[:, None]])
    return weights, earlier


def labelled_rows(labels: DataFrame, categories: dict[str, object], keep, most: int) -> DataFrame:
    """(doc_id, a boolean for each category) of at most `most` labelled ids that satisfy `keep`: those with the smallest hash."""
    flags = [F.coalesce(F.max(c.cast("int")), F.lit(0)).cast("boolean").alias(n) for n, c in categories.items()]
    any_label = F.coalesce(*[c.cast("int") for c in categories.values()]).isNotNull()
    rows = labels.where(F.col("doc_id").isNotNull() & any_label).where(F.lit(True) if keep is None else keep)
    return rows.groupBy("doc_id").agg(*flags).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, object], keep=None, sample_rows: int = 6000, folds: int = 4, features: int = 128, least: int = 5) -> Chain:
    """categories: name -> condition on the columns of labels, in chain order. Fitted on at most `sample_rows` labelled documents; only their features come to the driver."""
    names = list(categories)
    wanted = F.broadcast(labelled_rows(labels, categories, keep, sample_rows))  # at most sample_rows short rows
    rows = docs.select("doc_id", "text").join(wanted, "doc_id")
    # an id that documents repeat counts once, with its first text in order
    rows = rows.groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), *[F.max(n).alias(n) for n in names])
    marked = materialize(rows, "toxicity-sample")
    kinds = marked.agg(*[F.count_if(n).alias(n) for n in names], F.count("*").alias("_rows")).first()
    if not any(0 < kinds[n] < kinds["_rows"] for n in names):
        return Chain(names, [], [])
    chosen = sorted({t for n in names for t in choose(marked, n, features, least)})  # some hundred terms
    bare = Chain(names, chosen, [])

    def run(batches):
        for b in batches:
            x = bare.matrix(b.column("text").to_pylist()).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([np.packbits(r).tobytes() for r in x], pa.binary()), *b.columns[2:]], ["doc_id", "x", *b.schema.names[2:]])

    schema = "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", x binary, " + ", ".join(f"`{n}` boolean" for n in names)
    got = marked.mapInArrow(run, schema).toArrow()  # at most sample_rows
    got = got.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.array([np.unpackbits(np.frombuffer(r, np.uint8), count=len(chosen)) for r in got.column("x").to_pylist()], float).reshape(got.num_rows, len(chosen))
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % folds for i in got.column("doc_id").to_pylist()])
    targets = np.stack([got.column(n).to_numpy().astype(float) for n in names], axis=1)
    return Chain(names, chosen, fit_chain(x, targets, fold)[0])


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """Every column of docs but the text, and a probability p_<category> for each category; clashing columns are replaced."""
    docs = docs.drop(*[f"p_{n}" for n in model.names])
    place, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept).schema
    for n in model.names:
        schema = schema.add(f"p_{n}", "double")

    def run(batches):
        for b in batches:
            parts = [model.probabilities(b.column(place).slice(at, 512).to_pylist()) for at in range(0, b.num_rows, 512)]
            p = np.vstack(parts) if parts else np.zeros((0, len(model.names)))
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != place] + [pa.array(p[:, i], pa.float64()) for i in range(len(model.names))], schema.names)

    return docs.mapInArrow(run, schema)
