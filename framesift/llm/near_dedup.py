"""Near copies by five-word shingles: candidates by covering SimHash tables and by bands of minhashes, kept at an exact Jaccard similarity.

A text's set holds 64-bit hashes of its shingles in lower case (a text of fewer words is one shingle). Of each distinct set a SimHash fingerprint
is taken and keyed by the covering tables of `simhash` (7 for RADIUS 2), so every pair within the radius meets. Fingerprints of a similarity of 0.8 are mostly
farther apart, so 20 keys of five minhashes each are taken too, and a pair of similarity 0.8 meets in some band with probability 0.9996.
The sets of a bucket are compared with one of them, pair by pair, which joins most copies. Where a bucket still spans two components,
it is compared whole in a task, or, if it is larger than BUCKET sets or HASHES hashes, its sets are keyed again by more
and longer bands, which unlike texts share less often, at most twice. Every set has as many keys a level as there are bands, so rows grow with the sets, not with their groups.
A bucket that is still too large then is compared in blocks: its sets outside its most common component, block by block, with each block of all its sets. No pair of a bucket is left out.

Rows are told apart by a number of their own, which a written table holds, so ids may be null or repeated. Null and empty texts have the
same, empty set. `near_copies` gives repeated rows a row each; a row without an id gets its component's smallest id, null if there
is none. An empty table gives an empty result. `near_copies` ignores other columns; `one_of_each` keeps them all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import components, discard, materialize, mix64
from framesift.llm.decontaminate import batches_of
from framesift.llm.simhash import masks, set_fingerprints
from framesift.llm.substring_dedup import Windows

#: (bands, minhashes a band) of each level. At a similarity of 0.8 a pair misses all bands with probability 0.0004, 0.0002 and 0.0003.
LEVELS = ((20, 5), (75, 10), (227, 15))
#: Differing bits of SimHash fingerprints that surely meet, in 2^(RADIUS + 1) - 1 tables.
RADIUS = 2
TABLES = np.array(masks(list(range(64)), RADIUS), np.int64)
#: Sets of one bucket compared in one task, and their hashes in all.
BUCKET, HASHES = 4096, 1 << 19
#: Tasks that share the rows of a hot key.
SALTS = 64
FACTORS = mix64(np.arange(1, 1 + sum(b * r for b, r in LEVELS), dtype=np.uint64), 42) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted hashes."""
    found = Windows([t.encode().lower() if t else None for t in texts], width)
    edges = np.searchsorted(found.at, np.append(found.starts_of, found.total))
    out = []
    for text, low, high in zip(found.texts, edges[:-1], edges[1:]):
        own = found.h1[low:high] if high > low else np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if (words := text.split()) else [], np.uint64)
        out.append(np.unique(own))
    return out


def band_keys(sets: list[np.ndarray], level: int = 0) -> np.ndarray:
    """A row of keys for each set, one a band of the level; an empty set has zeros."""
    bands, rows = LEVELS[level]
    keys = np.zeros((len(sets), bands), np.int64)
    some = [i for i, x in enumerate(sets) if len(x)]
    if some:
        sizes = np.array([len(sets[i]) for i in some])
        h, first = np.concatenate([sets[i] for i in some]), np.cumsum(sizes) - sizes
        factor = iter(FACTORS[sum(b * r for b, r in LEVELS[:level]) :])
        for band in range(bands):
            key = np.full(len(some), band + 1000 * level, np.uint64)
            for k in range(rows):
                key = mix64(key ^ np.minimum.reduceat(h * next(factor), first), k)
            keys[some, band] = key.view(np.int64)
    return keys


def table_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys for each set, one a covering table of its SimHash fingerprint; an empty set has zeros."""
    kept = (set_fingerprints(sets)[:, None] & TABLES).view(np.uint64)
    keys = mix64(kept ^ mix64(np.arange(len(TABLES), dtype=np.uint64), 7), 7).view(np.int64)
    keys[[len(x) == 0 for x in sets]] = 0
    return keys


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if min(len(a), len(b)) == 0:
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _marked(rows: DataFrame, width: int) -> DataFrame:
    """(row, s, size, keys): a hash of the text's set, its hashes, and its keys of the covering tables and the first level's bands."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for start, texts in batches_of(b.column(1).to_pylist(), 1 << 19):
                sets = shingle_sets(texts, width)
                s = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.array(s), pa.array([len(x) for x in sets], pa.int64()), pa.array(np.hstack([table_keys(sets), band_keys(sets)]).tolist(), pa.list_(pa.int64()))], ["row", "s", "size", "keys"])

    return rows.select("row", "text").mapInArrow(run, "row long, s long, size long, keys array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(s, hashes): the set of each text."""

    def run(batches):
        for b in batches:
            for _, some in batches_of(b.column(0).to_pylist(), 1 << 19):
                sets = [x.tobytes() for x in shingle_sets(some, width)]
                s = np.array([xxhash.xxh3_64_intdigest(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(sets, pa.binary())], ["s", "hashes"])

    return texts.select("text").mapInArrow(run, "s long, hashes binary")


def _keyed(sets: DataFrame, level: int) -> DataFrame:
    """(s, key): the keys of each set at this level."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys = band_keys([np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()], level)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], ["s", "key"])

    return sets.select("s", "hashes").mapInArrow(run, "s long, key long")


def spanning_links(ids: np.ndarray, root: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links between sets of different roots, at most one less than the roots. A list of the sets of each hash counts what a set shares with all others at once."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owners = owner[np.argsort(place, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(place))])
    mine, left, right = np.split(place, np.cumsum(sizes)[:-1]), [], []
    _, root, members = np.unique(root, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(root != members.argmax()):  # of two sets with different roots one at least is not of the largest
        if not sizes[i]:
            continue
        shared = np.bincount(np.concatenate([owners[first[p] : first[p + 1]] for p in mine[i]]), minlength=len(sets))
        near = np.flatnonzero((shared >= least * (sizes + sizes[i] - shared)) & (root != root[i]))
        for j in near[np.unique(root[near], return_index=True)[1]]:
            left.append(int(ids[i]))
            right.append(int(ids[j]))
            root[root == root[j]] = root[i]
    return left, right


def _whole(least: float):
    """The links of a bucket."""

    def run(bucket: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in bucket.column("hashes").to_pylist()]
        left, right = spanning_links(bucket.column("s").to_numpy(), bucket.column("root").to_numpy(), sets, least)
        return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    return run


def with_buckets(rows: DataFrame, buckets: DataFrame, name: str) -> DataFrame:
    """A written table of the rows (key, s and more) with what is known of their buckets (key, n and more; n: rows of the key), by key.

    The rows of a key with over a thousandth of all rows are dealt to SALTS tasks. There are fewer than a thousand such keys, which is what is broadcast.
    """
    buckets = materialize(buckets, "near-extents")
    hot = F.col("n") > F.lit((buckets.agg(F.sum("n")).first()[0] or 0) / 1000)
    zero = F.lit(0).cast("long")
    marks = F.broadcast(buckets.where(hot).select("key", F.lit(True).alias("hot")))
    salted = rows.join(marks, "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("s", F.lit("salt")), F.lit(SALTS))).otherwise(zero)).drop("hot")
    copies = buckets.withColumn("salt", F.explode(F.when(hot, F.sequence(zero, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(zero))))
    out = materialize(salted.join(copies, ["key", "salt"]).drop("salt"), name)
    discard(buckets)
    return out


def _blocks(large: DataFrame) -> DataFrame:
    """(b, s, root): sets of large buckets (s, size, root, key) in groups of about BUCKET sets or HASHES hashes. Any two sets of a bucket that have different roots meet in a group.

    The sets outside the bucket's most common root are dealt to blocks, and those of that root to others. Each of the former
    blocks meets all blocks, so a set has a copy for each block it meets: one or a few where most of the bucket is one component.
    """
    each = large.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    found = each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max(F.struct("n", "root", "total")).alias("most"))
    parts = lambda n, total: F.ceil(2 * F.greatest(n / BUCKET, total / HASHES))
    most = F.col("most")
    found = found.select("key", "n", most["root"].alias("main"), parts(F.col("n") - most["n"], F.col("total") - most["total"]).alias("others"), parts(most["n"], most["total"]).alias("mains"))
    sides = with_buckets(large.select("key", "s", "root"), found, "near-sides").withColumn("other", F.col("root") != F.col("main"))
    dealt = lambda n: F.pmod(F.xxhash64("s", F.lit("block")), F.greatest(n, F.lit(1)))
    own = F.when(F.col("other"), dealt(F.col("others"))).otherwise(F.col("others") + dealt(F.col("mains")))
    met = F.sequence(F.lit(0).cast("long"), F.col("others") - 1 + F.when(F.col("other"), F.greatest("mains", F.lit(1))).otherwise(0))
    copies = sides.withColumn("own", own).select("key", "s", "root", "own", F.explode(met).alias("with")).where("own <> with")
    return copies.select(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("b"), "s", "root")


def _pairs(least: float):
    def run(batches):
        for b in batches:
            keep = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["u", "v"])

    return run


def near_groups(rows: DataFrame, width: int, least: float) -> DataFrame:
    """(row, root) of rows (row: a number of its own, text): rows of one component have one root."""
    marked = materialize(_marked(rows, width), "near-marked")
    each = materialize(marked.groupBy("s").agg(F.min("row").alias("first_row"), F.first("size").alias("size"), F.first("keys").alias("keys")), "near-distinct")

    def shared(keyed: DataFrame, level: int) -> DataFrame:
        """The sets of buckets of two or more components, each with its bucket's extent and leader. keyed: s, size, root, key."""
        found = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min(F.struct(F.xxhash64("s", F.lit(level)), "s")).alias("leader"), F.min("root").alias("a"), F.max("root").alias("z"))
        return with_buckets(keyed.select("s", "size", "key"), found.where("a <> z").select("key", "n", "total", F.col("leader.s").alias("leader")), "near-buckets")

    kept = shared(each.select("s", "size", F.col("s").alias("root"), F.explode("keys").alias("key")), 0)
    members = kept.select("s").distinct().join(each.select("s", "first_row"), "s").select(F.col("first_row").alias("row"))
    sets = materialize(_sets(rows.select("row", "text").join(members, "row", "left_semi"), width), "near-sets")
    discard(each)
    links = None
    for level in range(len(LEVELS)):
        star = kept.where("s <> leader").select("s", "leader").distinct()
        star = star.join(sets, "s").join(sets.select(F.col("s").alias("leader"), F.col("hashes").alias("other")), "leader").select("s", "leader", "hashes", "other")
        found = star.mapInArrow(_pairs(least), "u long, v long")
        before, links = links, materialize(found if links is None else found.unionByName(links), "near-links")
        roots = components(links, "near-components").withColumnRenamed("node", "s")
        # buckets within one component are done, and so are pairs
        placed = kept.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))
        mixed = placed.where("n > 2").groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("key", "n")
        left = with_buckets(placed.select("s", "size", "root", "key", "total"), mixed, "near-mixed")
        whole = (F.col("n") <= BUCKET) & (F.col("total") <= HASHES)
        groups = left.where(whole).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "root"))).alias("m")).select("m").distinct()
        groups = groups.select(F.xxhash64("m").alias("b"), F.explode("m").alias("m")).select("b", "m.*")
        small = left.where(~whole).isEmpty()
        if (last := level + 1 == len(LEVELS)) and not small:
            groups = groups.unionByName(_blocks(left.where(~whole)))
        found = groups.join(sets, "s").groupBy("b").applyInArrow(_whole(least), "u long, v long")
        stars, links = links, materialize(found.unionByName(links), "near-links")
        discard(*filter(None, (before, stars, kept)))
        if last or small:
            discard(left)
            break
        large = left.where(~whole).groupBy("s").agg(F.first("size").alias("size"), F.first("root").alias("root"))
        again = _keyed(sets.join(large.select("s"), "s", "left_semi"), level + 1).distinct().join(large, "s")
        kept = shared(again, level + 1)
        discard(left)
    roots = components(links, "near-components").withColumnRenamed("node", "s")
    discard(sets, links)
    return marked.select("row", "s").join(roots, "s", "left").select("row", F.coalesce("root", "s").alias("root"))


def numbered(docs: DataFrame) -> DataFrame:
    """A written table with the columns of docs as the struct `kept`, and a number of each row."""
    return materialize(docs.select(F.struct(*docs.columns).alias("kept")).withColumn("row", F.monotonically_increasing_id()), "near-rows", "zstd")


def _found(rows: DataFrame, width: int, least: float) -> DataFrame:
    """(row, doc_id, root)"""
    return rows.select("row", F.col("kept.doc_id").alias("doc_id")).join(near_groups(rows.select("row", F.col("kept.text").alias("text")), width, least), "row")


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row for each row of docs: doc_id, component_id (smallest doc_id of the component)."""
    found = _found(numbered(docs.select("doc_id", "text")), width, least)
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, without near copies: of each component the row with the smallest doc_id stays.

    Of rows with that id the first one stays. A row without an id cannot stand for one with an id, nor the other way
    round: of a component's rows without an id one stays too.
    """
    rows = numbered(docs)
    stay = _found(rows, width, least).groupBy("root", F.isnull("doc_id").alias("unnamed")).agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    return rows.join(stay, "row", "left_semi").select("kept.*")
