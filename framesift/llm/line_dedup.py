r"""Line dedup: lines found in many documents stay in one document only, by levelled sorted runs of line hashes.

A text is split at \n (null and empty texts are one empty line). A line's key is the line without `[\x20\x09-\x0D]` at both ends and with A-Z
lower-cased; keys of at least `least` code points count, as 128-bit hashes of their UTF-8. Each row of documents is a document, so repeated rows
count apart. Keys in at least `documents` documents lose all their lines except in the rows with the largest id that holds them. A null id is below
all others: rows without an id keep such lines only if no holder has one.

`LineRuns` keeps the keys of all batches added so far as runs: partitions of a table that is bucketed by the key and sorted in each bucket, so
that a batch is merged with them without moving them. Each new batch is reduced to a row a key (before and after its shuffle, so a line of a third of all documents is a few rows a
task), merge-anti-joined with the runs, and written as a run of level 0: its unseen keys, and its counts of those seen before, marked
so. `fan_in` runs of a level are compacted into one of the next, which adds up a key's rows; a key is rewritten once a level. The store
takes any number of batches in any order; a batch whose write did not end is no run.

`drop_repeated_lines` adds its rows in batches, takes the frequent keys from the merged runs, and finds the rows that hold them: at most `hot` keys,
those with more than one row in `hot`, may be broadcast; all others meet their rows by a shuffle in which no key has more than one row in
`hot`. The keys to drop then go to their documents, which are known by id and a hash of the text (repeated rows lose the same lines).

Very long texts are handled line by line. An empty table gives an empty result. A carried column called n_lines, n_dropped or kept_text is
replaced; other names may clash with none. The runs are deleted once the dropped keys are written.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framesift.llm.common import discard, materialize
from framesift.operators.store import delete_path, shared_dir


def key_of(line: bytes, least: int) -> bytes | None:
    """The line's key, or None if it has fewer than `least` code points."""
    key = line.strip()  # of bytes: 0x20 and 0x09-0x0D
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode()) < least):
        return None
    return key.lower()  # of bytes: A-Z


def line_keys(docs: DataFrame, id_column: str, batch, least: int) -> DataFrame:
    """(key, id, body, batch): a row for each distinct key of each row of docs. body is a hash of the text."""
    kind = docs.schema[id_column].dataType

    def run(batches):
        for b in batches:
            rows, keys = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                found = {key_of(line, least) for line in (text or "").encode().split(b"\n")} - {None}
                rows += [i] * len(found)
                keys += map(xxhash.xxh3_128_digest, found)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(b.column(c).take(take) for c in ("id", "body", "batch"))], names=["key", "id", "body", "batch"])

    schema = T.StructType().add("key", "binary").add("id", kind).add("body", "long").add("batch", "integer")
    return docs.select(F.col(id_column).alias("id"), F.xxhash64("text").alias("body"), batch.alias("batch"), "text").mapInArrow(run, schema)


class LineRuns:
    """Levels of sorted runs of keys with their number of documents and largest id: partitions of one table, which is bucketed by the key."""

    def __init__(self, spark: SparkSession, fan_in: int = 4):
        self.spark, self.fan_in, self.levels, self.made = spark, fan_in, [[]], 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"framesift_lines_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.table}"

    def _write(self, rows: DataFrame, level: int) -> None:
        sorted_run = rows.select("key", "n", "keeper", "seen", F.lit(self.made).alias("run")).repartition(self.buckets, "key").write.mode("append")
        sorted_run.partitionBy("run").bucketBy(self.buckets, "key").sortBy("key").option("path", self.path).option("compression", "zstd").saveAsTable(self.table)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(self.made)
        self.made += 1

    def _rows(self, runs: list[int]) -> DataFrame:
        return self.spark.table(self.table).where(F.col("run").isin(runs))

    def _merged(self, runs: list[int]) -> DataFrame:
        return self._rows(runs).groupBy("key").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"), F.min("seen").alias("seen"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch: a row for each line key of each document, (key, id)."""
        batch = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        known = [run for level in self.levels for run in level]
        if known:
            met = batch.join(self._rows(known).where("not seen").select("key", F.lit(True).alias("found")), "key", "left")
            batch = met.withColumn("seen", F.col("found").isNotNull())
        else:
            batch = batch.withColumn("seen", F.lit(False))
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            for run in full:
                delete_path(self.spark, f"{self.path}/run={run}")
            level += 1

    def counts(self) -> DataFrame:
        """(key, n, keeper) of all batches."""
        return self._merged([run for level in self.levels for run in level]).drop("seen")

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
        delete_path(self.spark, self.path)


def dropped_keys(docs: DataFrame, id_column: str, least: int, documents: int, batches: int, fan_in: int, hot: int) -> DataFrame:
    """(id, body, gone): the keys that a document loses, for documents that lose any."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64(F.col(id_column), F.col("text")), F.lit(batches)).cast("int")
    lines = materialize(line_keys(docs, id_column, batch, least), "line-keys", "zstd")
    runs = LineRuns(spark, fan_in)
    try:
        for k in range(batches):
            runs.add(lines.where(F.col("batch") == k))
        frequent = materialize(runs.counts().where(F.col("n") >= documents), "frequent-lines", "zstd")
    finally:
        runs.close()
    bound = max(1, lines.count() // hot)
    lower = F.col("keeper").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("keeper")))
    common = lines.join(F.broadcast(frequent.where(F.col("n") > bound)), "key")  # fewer than `hot` keys have so many lines
    rest = lines.join(frequent.where(F.col("n") <= bound), "key")
    gone = common.unionByName(rest).where(lower).groupBy("id", "body").agg(F.collect_set("key").alias("gone"))
    out = materialize(gone, "dropped-lines", "zstd")
    discard(lines, frequent)
    return out


def drop_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", carry: tuple[str, ...] = ("doc_id",), least: int = 40, documents: int = 5, batches: int = 8, fan_in: int = 4, hot: int = 1000
) -> DataFrame:
    """The columns `carry` of every row of docs, and n_lines, n_dropped and kept_text (the other lines, joined by newlines)."""
    gone = dropped_keys(docs, id_column, least, documents, batches, fan_in, hot)
    results = ("n_lines", "n_dropped", "kept_text")
    carried = [c for c in carry if c not in results]
    schema = T.StructType([docs.schema[c] for c in carried]).add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    kept_type = to_arrow_type(T.StructType([docs.schema[c] for c in carried])) if carried else None

    def run(found):
        for b in found:
            lines, dropped, kept = [], [], []
            for text, keys in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                split = (text or "").encode().split(b"\n")
                lines.append(len(split))
                if keys:
                    keys = set(keys)
                    left = [x for x in split if (key := key_of(x, least)) is None or xxhash.xxh3_128_digest(key) not in keys]
                    dropped.append(len(split) - len(left))
                    kept.append(b"\n".join(left).decode())
                else:
                    dropped.append(0)
                    kept.append(text or "")
            carried_columns = b.column("kept").flatten() if kept_type else []
            yield pa.RecordBatch.from_arrays([*carried_columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    kept = [F.struct(*carried).alias("kept")] if carried else []
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64("text").alias("body"), "text", *kept).alias("d")
    # the dropped keys grow with the documents: a merge at any size
    met = rows.join(gone.hint("merge").alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.body") == F.col("g.body")), "left")
    return met.select("d.text", "g.gone", *([F.col("d.kept")] if carried else [])).mapInArrow(run, schema)
