"""Language identification: nearest of several centroids per language, by cosine of hashed TF-IDF n-gram vectors.

Inverse document frequencies come from all learning rows. Centroids are clustered (spherical k-means) from a
bounded sample of them: about `sample_rows`, the same number for each language (`per_language` at least), by a hash of the id. At most `languages` values of
lang are learned, the most frequent ones (ties: the first in order), so a dirty column cannot fill the driver. A text is rejected
if its similarity to the nearest centroid is below what all but a small share of that language's sample reaches.

Null texts and texts without a letter are `und` with score 0. Every other text gets the nearest learned language,
and `rejected` tells those too far from it. With nothing to learn from all are `und`. Ties go to the language first
in order. Repeated rows each get their row, null ids too. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 12
#: Bytes that are no letters in any language become spaces.
PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-byte n-grams of the lower-cased text; none without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    out = np.zeros(1 << BITS, np.float32)
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split()) + b" "
    for at in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[max(0, at - 2) : at + (1 << 20)], np.uint8).astype(np.uint32)
        pair = b[:-1] << np.uint32(8) | b[1:]
        for code, salt in ((pair, 1), (pair[:-1] << np.uint32(8) | b[2:], 2)):
            key = (code * np.uint32(0x9E3779B1) + np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
            out += np.bincount(key, minlength=1 << BITS)
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


class Centroids:
    def __init__(self, idf: np.ndarray, languages: list[str], owner: np.ndarray, centroids: np.ndarray, floor: np.ndarray):
        self.idf, self.languages, self.owner, self.centroids, self.floor = idf, languages, owner, centroids, floor

    def predict(self, texts: list[str | None]):
        """(language, similarity from 0 to 1, rejected) of each text."""
        found = [features(t) for t in texts]
        known = [i for i, f in enumerate(found) if f is not None] if self.languages else []
        out = [("und", 0.0, True)] * len(texts)
        if known:
            near = _weighted(np.stack([found[i] for i in known]), self.idf) @ self.centroids.T
            best = near.argmax(1)
            for i, c, s in zip(known, best.tolist(), near.max(1).tolist()):
                out[i] = (self.languages[self.owner[c]], min(1.0, max(0.0, s)), s < self.floor[self.owner[c]])
        return out


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of the unit rows of x; each starts at the row farthest from those before it."""
    centers = x[[int((x @ x.mean(0)).argmax())]]
    while len(centers) < min(k, len(x)):
        centers = np.vstack([centers, x[[int((x @ centers.T).max(1).argmin())]]])
    for _ in range(rounds):
        owner = (x @ centers.T).argmax(1)
        sums = np.stack([x[owner == c].sum(0) if (owner == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def train(docs: DataFrame, keep=None, sample_rows: int = 3000, per_language: int = 4, lost: float = 0.005, languages: int = 1000) -> Centroids:
    """Fit on the rows of docs with a language that satisfy `keep`."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(F.lit(True) if keep is None else keep).select("doc_id", "text", "lang")

    def seen(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                f = features(t)
                if f is not None:
                    total, n = total + (f > 0), n + 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["df", "n"])

    df = rows.select("text").mapInArrow(seen, "df array<bigint>, n bigint")
    sums = df.select(F.posexplode("df").alias("i", "d"), "n").groupBy("i").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).toPandas()  # one row a feature
    idf, n = np.zeros(1 << BITS, np.float32), int(sums["n"].max()) if len(sums) else 0
    if n:
        idf[sums["i"].to_numpy()] = np.log((1 + n) / (1 + sums["d"].to_numpy()))  # what every text has tells nothing
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not n or not per:
        return Centroids(idf, [], np.zeros(0, int), np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    each = max(per_language, sample_rows // len(per))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 2 * each / count)) for lang, count in per.items()], "lang string, share double")  # `languages` rows at most
    # twice what is wanted passes by its hash, so that few rows of a frequent language are sorted
    rare = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text"))
    sample = rare.withColumn("place", place).where(F.col("place") <= each)

    def vectors(batches):
        for b in batches:
            found = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([None if f is None else f.tobytes() for f in found], pa.binary()), b.column(1)], ["v", "lang"])

    got = sample.select("text", "lang").mapInArrow(vectors, "v binary, lang string").where("v is not null").toPandas()
    x = _weighted(np.stack([np.frombuffer(v, np.float32) for v in got["v"]]), idf) if len(got) else np.zeros((0, 1 << BITS))
    x = x[order := np.lexsort(x.T[:8])] if len(x) else x
    lang = got["lang"].to_numpy()[order] if len(x) else np.array([])
    known = sorted(set(lang))
    parts = [cluster(x[lang == one], per_language) for one in known]
    floor = np.array([np.quantile((x[lang == one] @ c.T).max(1), lost) for one, c in zip(known, parts)])
    owner = np.repeat(np.arange(len(parts)), [len(c) for c in parts]) if parts else np.zeros(0, int)
    return Centroids(idf, known, owner, np.vstack(parts).astype(np.float32) if parts else np.zeros((0, 1 << BITS), np.float32), floor)


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """Every column of docs but the text, and lang_pred, score, rejected; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    place, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 512):
                out += model.predict(b.column(place).slice(at, 512).to_pylist())
            new = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != place] + new, schema.names)

    return docs.mapInArrow(run, schema)
