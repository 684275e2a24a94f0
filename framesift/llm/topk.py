"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers. Rows are dealt to shards by a number of their own, which a written table holds; a shard's index holds, for each dimension,
its rows in order of that component. Queries are packed in blocks and copied to every shard, so that the table itself is
shuffled once and only the queries travel often. In each (shard, block) row of that equi-join a query walks the lists of its
dimensions from their better end, scores every row it meets for the first time, and stops once the best total of what the
lists still hold is below its k-th score. A last step keeps the k best of a query's k a shard.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Rows with an id in common are
candidates each, also as repeated rows; a query leaves out the rows with its own id, and several rows of one query id are
answered together: the k best (vec_id, score) of all their pairs. Only vectors of one length are compared. Ties go to the smaller id. Fewer than k
candidates give fewer rows, and an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import materialize

SHARD, BLOCK = 8192, 1024
#: Most tasks of the search; each takes its shards one after the other.
TASKS = 20_000


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, x): floor(scale * component) as array<bigint>, for the rows that take part."""
    value = lambda c: c.cast("double")
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(value(c)) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(sound)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(value(c) * F.lit(float(scale)))).alias("x"))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("vec_id").to_numpy()
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(len(ids), -1)
    order = np.lexsort([*x.T[::-1], ids])
    return ids[order], x[order]


def _narrow(x: np.ndarray) -> np.ndarray:
    """In 32 bits where they suffice."""
    return x.astype("<i4") if np.abs(x).max(initial=0) < 1 << 31 else x.astype("<i8")


def _wide(blob: bytes, rows: int, dim: int) -> np.ndarray:
    kind = "<i8" if rows * dim and len(blob) == 8 * rows * dim else "<i4"
    return np.frombuffer(blob, kind).reshape(rows, dim).astype(np.int64)


def _pack(order: bool):
    def run(rows: pa.Table) -> pa.Table:
        ids, x = _matrix(rows)
        out = {"part": rows.column("part").slice(0, 1), "dim": rows.column("dim").slice(0, 1), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "x": pa.array([_narrow(x).tobytes()], pa.binary())}
        if order:
            out["lists"] = pa.array([np.argsort(x, axis=0, kind="stable").T.astype("<i4").tobytes()], pa.binary())
        return pa.table(out)

    return run


def threshold_topk(q: np.ndarray, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of x for q, without the rows of id `own`."""
    n, dims = len(ids), np.flatnonzero(q)
    ways = np.where(q[dims, None] > 0, lists[dims, ::-1], lists[dims])
    seen, at, depth = np.zeros(n, bool), np.zeros(0, np.int64), 0
    best_at, best = at, np.zeros(0, np.int64)
    while depth < n:
        step = min(n, max(16, 4 * depth))
        new = np.zeros(n, bool)
        new[ways[:, depth:step].ravel()] = True
        depth = step
        if depth == n or not len(dims):
            new[:], depth = True, n
        new &= ~seen
        seen |= new
        at = np.flatnonzero(new & (ids != own))
        score = (x[at] @ q).astype(np.int64)
        best_at, best = np.append(best_at, at), np.append(best, score)
        keep = np.lexsort((ids[best_at], -best))[:k]
        best_at, best = best_at[keep], best[keep]
        if depth < n and len(best) == k and int(np.sum(q[dims] * x[ways[:, depth - 1], dims])) < best[-1]:
            break
    return ids[best_at], best


def _search(k: int):
    def run(batches):
        for b in batches:
            out = [[], [], []]
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                ids, qids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                x, qs = _wide(r["x"], r["n"], r["dim"]), _wide(r["q_x"], r["q_n"], r["dim"])
                lists = np.frombuffer(r["lists"], "<i4").reshape(-1, r["n"])
                if np.abs(x).max(initial=0) * float(np.abs(qs).max(initial=0)) * max(1, r["dim"]) < 2**52:
                    x, qs = x.astype(float), qs.astype(float)  # exact, and faster
                for own, q in zip(qids.tolist(), qs):
                    found, score = threshold_topk(q, ids, x, lists, own, k)
                    out[0] += [own] * len(found)
                    out[1] += found.tolist()
                    out[2] += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that satisfies `is_query` (a condition on vec_id)."""
    whole = materialize(integers(vectors, scale).withColumn("place", F.monotonically_increasing_id()), "topk-rows")
    total = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    shards, blocks = max(1, -(-total["n"] // shard)), max(1, -(-total["q"] // block))
    dealt = lambda df, n: df.select(F.pmod(F.xxhash64("place"), F.lit(n)).alias("part"), F.size("x").alias("dim"), F.col("vec_id").cast("long").alias("vec_id"), "x")
    packed = "part long, dim int, n int, ids binary, x binary"
    index = dealt(whole, shards).groupBy("part", "dim").applyInArrow(_pack(True), packed + ", lists binary")
    asked = dealt(whole.where(is_query), blocks).groupBy("part", "dim").applyInArrow(_pack(False), packed)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    asked = asked.select(copies.alias("part"), "dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    tasks = min(shards, TASKS)
    pairs = index.repartition(tasks, "part", "dim").join(asked.repartition(tasks, "part", "dim").hint("shuffle_merge"), ["part", "dim"])
    found = pairs.select("dim", "n", "ids", "x", "lists", "q_n", "q_ids", "q_x").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
