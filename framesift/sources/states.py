"""Whole-video state documents: one JSON object a video, with its head (metadata, steps, progress) and an array `frames` of frame documents.

A document is never one row. An Arrow task reads it piece by piece and cuts out the elements of `frames` as they end; what is around them is the
head's text. So a task holds a piece and the frame that it is in, and a video of a million frames is a million rows. Files are read in parallel, each by one task.

Written documents are lines of one file in a folder a video: the head up to its frames, then a frame a line. Spark's writer makes them, so a lost
executor leaves no half document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.operators.store import materialize
from framesift.sources.tables import FRAME_JSON, as_json, with_defaults

#: The keys of a state document's head.
HEAD_JSON = """
    video_file string, video_hash string,
    video_metadata struct<duration:double,fps:double,width:int,height:int,codec:string,total_frames:long,file_size_bytes:long,format:string>,
    model_versions map<string,string>, created_at string, last_updated string, current_step string, completed_steps array<string>, failed_steps array<string>,
    step_progress map<string,struct<total_items:long,processed_count:long,completed:boolean,started_at:string,completed_at:string,step_data:string>>,
    processing_stats string, config_snapshot string, frame_selections string, _corrupt_record string"""
#: Keys that a head must have, and keys whose values are any JSON and kept as text.
REQUIRED = ("video_file", "video_hash", "video_metadata", "model_versions", "created_at", "last_updated")
AS_TEXT = ("processing_stats", "config_snapshot", "frame_selections")

#: What ends or begins something, at the top of the frames and elsewhere.
BETWEEN, MARK = re.compile(rb"[^\s]"), re.compile(rb'\\.|["{}\[\]]', re.DOTALL)
PIECE, OUTPUT = 4 << 20, 4 << 20
HEAD, FRAME, BROKEN = "head", "frame", "broken"


class Scanner:
    """Cuts a document that comes in pieces. feed() and end() give (kind, place, text)."""

    def __init__(self, key: bytes = b"frames"):
        self.key, self.head, self.rest = key, bytearray(), b""
        self.depth, self.string_from, self.last = 0, None, b""
        self.inside, self.element, self.base, self.n = False, bytearray(), 0, 0

    def feed(self, piece: bytes) -> Iterator[tuple[str, int, bytes]]:
        data = self.rest + piece
        self.rest = b""
        if len(data) - len(data.rstrip(b"\\")) & 1:  # an escape that is cut in two
            data, self.rest = data[:-1], data[-1:]
        at = 0
        while at < len(data):
            if self.inside and self.depth == self.base and self.string_from is None and not self.element:
                found = BETWEEN.search(data, at)
                if not found:
                    return
                at, mark = found.start(), found.group()
                if mark == b"]":  # the frames end
                    self.inside, self.depth = False, self.depth - 1
                    self.head += b"]"
                    at += 1
                elif mark == b",":
                    at += 1
                elif mark in b'{["':
                    self.element += mark
                    self.depth += mark != b'"'
                    self.string_from = 0 if mark == b'"' else None
                    at += 1
                else:  # a number or a word
                    end = re.compile(rb"[,\]\s]").search(data, at)
                    stop = end.start() if end else len(data)
                    if end:
                        yield self._cut(data[at:stop])
                    else:
                        self.rest = data[at:] + self.rest
                    at = stop
                continue
            found = MARK.search(data, at)
            stop = found.end() if found else len(data)
            (self.element if self.inside else self.head).extend(data[at:stop])
            at = stop
            if not found or found.group()[:1] == b"\\":
                continue
            mark = found.group()
            if self.string_from is not None:
                if mark == b'"':
                    if not self.inside and self.depth == 1:
                        self.last = bytes(self.head[self.string_from : -1])
                    self.string_from = None
            elif mark == b'"':
                self.string_from = len(self.head)
            elif mark in b"{[":
                self.depth += 1
                if mark == b"[" and self.depth == 2 and not self.inside and self.last == self.key:
                    self.inside, self.base = True, self.depth
            else:
                self.depth -= 1
            if self.inside and self.element and self.depth == self.base and self.string_from is None:
                yield self._cut(bytes(self.element))
                self.element.clear()

    def _cut(self, text: bytes) -> tuple[str, int, bytes]:
        self.n += 1
        return FRAME, self.n - 1, text

    def end(self) -> Iterator[tuple[str, int, bytes]]:
        """The head; or, of a document that ends too early, what was being read."""
        if self.depth or self.inside or self.string_from is not None:
            yield BROKEN, self.n, bytes(self.element or self.head) + self.rest
        else:
            yield HEAD, -1, bytes(self.head) + self.rest


def scan(spark: SparkSession, path: str, glob: str = "*", in_row: int = 1 << 24) -> DataFrame:
    """(path, kind, idx, value): the text of each document's head and of each of its frames. Documents of up to `in_row` bytes come through Spark's reader, larger ones as a stream."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    schema = "path string, kind string, idx long, value string"

    def pieces(uri, content):
        if content is not None:
            for at in range(0, len(content), PIECE):
                yield content[at : at + PIECE]
            return
        system, place = FileSystem.from_uri(uri)
        with system.open_input_stream(place) as data:
            while piece := data.read(PIECE):
                yield piece

    def run(batches):
        for b in batches:
            paths, contents = b.column("path").to_pylist(), b.column("content")
            for i, uri in enumerate(paths):
                scanner, out, size = Scanner(), [], 0

                def flush():
                    cols = list(zip(*out)) or [[]] * 3  # noqa: B023
                    text = pa.array([v.decode("utf-8", "replace") for v in cols[2]], pa.string())
                    return pa.RecordBatch.from_arrays([pa.array([uri] * len(out), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), text], names=["path", "kind", "idx", "value"])  # noqa: B023

                for piece in pieces(uri, contents[i].as_py()):
                    for item in scanner.feed(piece):
                        out.append(item)
                        size += len(item[2])
                        if size >= OUTPUT:
                            yield flush()
                            out, size = [], 0
                out += scanner.end()
                yield flush()

    small = files.where(F.col("length") <= in_row).select("path", "content")
    large = files.where(F.col("length") > in_row).select("path", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).mapInArrow(run, schema)


def read_states(spark: SparkSession, path: str, glob: str = "*", in_row: int = 1 << 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads, frames and quarantine of the documents under `path`.

    heads: path and the head's fields; values of any form are JSON text. frames: path, idx (place in the document) and the frame's fields, with
    defaults. quarantine: path, idx (null for a head), error, value: frames and heads that are no JSON of their form or lack what they must have, and the
    end of a document that is cut off. A document with a bad head keeps its frames. Missing optional fields are null or empty; files of no bytes, which Spark does not list, give nothing.
    """
    found = materialize(scan(spark, path, glob, in_row), "states")
    read = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    heads = found.where(F.col("kind") == HEAD).select("path", "value", F.from_json("value", HEAD_JSON, read).alias("h"))
    lacking = F.when(F.col("h").isNull() | F.col("h._corrupt_record").isNotNull(), "not a state document")
    for name in REQUIRED:
        lacking = lacking.when(F.col(f"h.{name}").isNull(), f"no {name}")
    heads = heads.withColumn("error", lacking)
    steps = {"current_step": F.lit("initialization"), "completed_steps": F.array().cast("array<string>"), "failed_steps": F.array().cast("array<string>")}
    steps |= {"step_progress": F.create_map().cast(T.StructType.fromDDL(HEAD_JSON)["step_progress"].dataType)} | {c: F.lit("{}") for c in AS_TEXT}
    good = heads.where("error is null").select("path", "h.*").drop("_corrupt_record").withColumns({c: F.coalesce(c, x) for c, x in steps.items()})
    frames = found.where(F.col("kind") == FRAME).select("path", "idx", "value", F.from_json("value", FRAME_JSON, read).alias("f"))
    wrong = F.when(F.col("f").isNull() | F.col("f._corrupt_record").isNotNull(), "not a frame document").when(F.col("f.selections").isNull(), "no selections")
    frames = frames.withColumn("error", wrong)
    kept = with_defaults(frames.where("error is null").select("path", "idx", "f.*").drop("_corrupt_record"))
    cut = found.where(F.col("kind") == BROKEN).select("path", "idx", F.lit("document ends early").alias("error"), "value")
    bad = frames.where("error is not null").select("path", "idx", "error", "value")
    bad_heads = heads.where("error is not null").select("path", F.lit(None).cast("long").alias("idx"), "error", "value")
    return good, kept, bad.unionByName(bad_heads).unionByName(cut)


def write_states(heads: DataFrame, frames: DataFrame, path: str, key: str = "video_hash", order: str = "idx") -> None:
    """A document a head, in a folder of its own (`state=<key>`), with the frames of that key in order.

    Both have `key`; heads the fields of HEAD_JSON (missing ones are left out), frames those of a frame document and `order`. Frames of a key without a head are not
    written. A document is written by one task as a stream of lines; the sort before it spills.
    """
    fields = [f for f in T.StructType.fromDDL(HEAD_JSON).fields if f.name in heads.columns]
    plain = F.to_json(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields if f.name not in (*AS_TEXT, "step_progress")]), {"ignoreNullFields": "false"})
    parts = [F.substring(plain, 2, F.char_length(plain) - 2)]
    if "step_progress" in heads.columns:
        # step_data is any JSON and goes in as it is
        one = lambda v: F.concat(
            F.lit("{"), F.substring(F.to_json(v.dropFields("step_data"), {"ignoreNullFields": "false"}), F.lit(2), F.char_length(F.to_json(v.dropFields("step_data"), {"ignoreNullFields": "false"})) - 2),
            F.lit(', "step_data": '), F.coalesce(v["step_data"], F.lit("{}")), F.lit("}"),
        )
        each = F.transform(F.map_entries(F.coalesce("step_progress", F.create_map().cast(heads.schema["step_progress"].dataType))), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(": "), one(e["value"])))
        parts.append(F.concat(F.lit('"step_progress": {'), F.array_join(F.transform(each, lambda t: F.regexp_replace(t, r'^\[(".*?(?<!\\)")\]: ', "$1: ")), ", "), F.lit("}")))
    parts += [F.concat(F.lit(f'"{c}": '), F.coalesce(F.col(c), F.lit("{}"))) for c in AS_TEXT if c in heads.columns]
    opening = heads.select(F.col(key).cast("string").alias("state"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_o"), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit(', "frames": [')).alias("value"))
    closing = heads.select(F.col(key).cast("string").alias("state"), F.lit(2).alias("_side"), F.lit(0).cast("long").alias("_o"), F.lit("]}").alias("value"))
    document = [c for c in frames.columns if c in T.StructType.fromDDL(FRAME_JSON).names and c != "_corrupt_record"]
    text = as_json(frames.select(F.struct(F.col(key).cast("string").alias("state"), F.col(order).cast("long").alias("_o")).alias("_at"), *document), carry=["_at"])
    known = text.select("_at.*", "value").join(heads.select(F.col(key).cast("string").alias("state")), "state", "left_semi")
    lines = opening.unionByName(known.select("state", F.lit(1).alias("_side"), "_o", "value")).unionByName(closing)
    before = F.lag("_side").over(Window.partitionBy("state").orderBy("_side", "_o"))
    lines = lines.withColumn("value", F.when((F.col("_side") == 1) & (before == 1), F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")))
    lines.sortWithinPartitions("state", "_side", "_o").select("state", "value").write.mode("overwrite").partitionBy("state").text(path)
