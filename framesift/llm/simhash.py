"""SimHash near-duplicate groups, with candidate pairs from covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of radius + 1 bits. Table t (every non-zero vector t) keys a
fingerprint by those bits whose vector has an odd number of ones in common with t. Any `radius` differing
bits span less than the whole space, so some t is orthogonal to all of them: in that table both fingerprints
have the same key. With radius 2 that makes 7 tables of 36 or 37 bits each.

Null and empty texts have no words and the fingerprint zero, linked like any other. Repeated rows each get
their row. Null ids keep their row and count only if no id of the component is known. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import components, materialize

#: Fingerprints of one bucket compared in one task; larger buckets are keyed again by their free bits.
BUCKET = 1024


def fingerprint(text: str | None, shingle: int) -> int:
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    n = max(1, len(found) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        some = min(n, at + (1 << 15))
        parts = map(b" ".join, zip(*(found[at + k : some + k] for k in range(shingle)))) if len(found) >= shingle else [b" ".join(found)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, some - at)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set of 64-bit hashes, as signed 64-bit numbers; an empty set has zero."""
    out = np.zeros(len(sets), np.int64)
    for i, hashes in enumerate(sets):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * ones > len(hashes)).view(">i8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def masks(bits: list[int], radius: int) -> list[int]:
    """Covering masks over the given bit positions, as signed 64-bit numbers."""
    size = 1 << (radius + 1)
    vectors = {b: 1 + i * 0x9E37 % (size - 1) for i, b in enumerate(bits)} if size - 1 > len(bits) else {b: 1 + i % (size - 1) for i, b in enumerate(bits)}
    out = [sum(1 << b for b, m in vectors.items() if (m & t).bit_count() % 2) for t in range(1, size)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _stars(radius: int):
    def run(batches):
        for b in batches:
            left, right = [], []
            for fps in b.column(0).to_pylist():
                x = np.sort(np.array(fps, np.int64))
                root = np.arange(len(x))
                for i in range(len(x) - 1):
                    near = np.flatnonzero(np.bitwise_count((x[i + 1 :] ^ x[i]).view(np.uint64)) <= radius) + i + 1
                    if len(near):
                        joined = np.unique(root[np.append(near, i)])
                        root[np.isin(root, joined)] = joined[0]
                far = np.flatnonzero(root != np.arange(len(x)))
                left += x[far].tolist()
                right += x[root[far]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return run


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(u, v): a forest with the same components as all pairs of the distinct fingerprints `fps` (fp) within the radius.

    Buckets of up to BUCKET fingerprints are compared in tasks, and each gives at most one link per member.
    Members of a larger bucket agree on its mask's bits, so they are keyed again by covering masks over the
    other bits only, until buckets are small. That ends: with 10 free bits a bucket has at most 1,024 members.
    """
    found = None
    todo = [(fps.select("fp", F.lit("").alias("path")), list(range(64)))]
    while todo:
        rows, free = todo.pop()
        tables = masks(free, radius)
        keyed = rows.select("fp", "path", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("t", "key"))
        sizes = keyed.groupBy("path", "t", "key").count().where("count > 1")
        kept = materialize(keyed.join(sizes, ["path", "t", "key"]), "simhash-buckets")
        small = kept.where(F.col("count") <= BUCKET).groupBy("path", "t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        edges = small.mapInArrow(_stars(radius), "u long, v long")
        found = edges if found is None else found.unionByName(edges)
        large = kept.where(F.col("count") > BUCKET)
        for t in sorted(r["t"] for r in large.select("t").distinct().collect()):  # at most one per table
            rest = [b for b in free if not (tables[t] >> b) & 1]
            todo.append((large.where(F.col("t") == t).select("fp", F.concat_ws("/", "path", F.col("t").cast("string"), F.col("key").cast("string")).alias("path")), rest))
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (smallest doc_id of the component)."""
    marked = materialize(fingerprints(docs, shingle), "simhash-fingerprints")
    each = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(each, radius), "simhash-components").withColumnRenamed("node", "fp")
    joined = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(joined.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
