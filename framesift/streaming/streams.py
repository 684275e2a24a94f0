"""Structured Streaming forms: ingest, deduplication, windowed counts, arrival-order selection, incremental reselection."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from framesift.operators.store import discard, materialize, scratch
from framesift.sources import tables


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append what is new under `source` to `target`, exactly once, and stop. Run again, it takes only newer files."""
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def ingest_frames(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Frame documents, one a line of the text files that are new under `source`, into tables under `target`: frames, faces, poses, persons and quarantine; then stop.

    Each micro-batch is parsed once and writes a folder `batch=<its number>` in every table, replacing it, so a batch that is replayed after a crash, or a run that
    finds nothing new, changes nothing. quarantine has the text of lines that are no frame document and why. Empty lines are left out.
    """

    def each(batch: DataFrame, number: int):
        with scratch(spark):
            read = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
            # `inline` makes f once; conditions on f itself would parse the text again, each of them
            parsed = batch.where(F.trim("value") != "").select("value", F.inline(F.array(F.struct(F.from_json("value", tables.FRAME_JSON, read).alias("f")))))
            wrong = F.when(F.col("f").isNull() | F.col("f._corrupt_record").isNotNull(), "not a frame document").when(F.col("f.selections").isNull(), "no selections")
            # columns of their own, so that each table reads what it has; only quarantine wants the text
            marked = parsed.withColumn("error", wrong).select(F.when(F.col("error").isNotNull(), F.col("value")).alias("framesift_text"), F.col("error").alias("framesift_error"), "f.*")
            lines = materialize(marked.drop("_corrupt_record"), "frame-lines")
            frames = lines.where("framesift_error is null").drop("framesift_text", "framesift_error")
            wrong_lines = lines.where("framesift_error is not null").select(F.col("framesift_text").alias("value"), F.col("framesift_error").alias("error"))
            found = {
                "frames": tables.with_defaults(frames).drop("face_detections", "pose_detections", "persons"), "faces": tables.child(frames, "face_detections", fill=True),
                "poses": tables.child(frames, "pose_detections", fill=True), "persons": tables.persons(frames), "quarantine": wrong_lines,
            }
            for name, rows in found.items():
                rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    lines = spark.readStream.schema("value string").text(source)
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns that a stream carries besides its own; names that begin with a line are changed on their way.
VIDEO, FRAME, PART, ARRIVED = "framesift_video", "framesift_frame", "framesift_part", "framesift_arrived"


def _text(column: str):
    """An id as text, never null: rows of a null key would not come together."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def keyed_state(spark: SparkSession) -> None:
    """The state store that the operators with state of their own need. Set before their query starts; other streams keep working with it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _FirstFrames(StatefulProcessor):
    """Frames seen of one part of all (video, frame), each until `keep_ms` of arrival time after it last came."""

    def __init__(self, time: str, keep_ms: int):
        self.time, self.keep_ms = time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType().add("frames", T.ArrayType(T.StringType())).add("times", T.ArrayType(T.LongType())))

    def _known(self, now: int) -> dict[str, int]:
        return {f: t for f, t in zip(*self.seen.get()) if t + self.keep_ms > now} if self.seen.exists() else {}

    def _keep(self, known: dict[str, int]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if known:
            self.seen.update((list(known), list(known.values())))
            self.handle.registerTimer(min(known.values()) + self.keep_ms)
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows, timerValues):
        arrived = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        now = int(arrived[ARRIVED].iloc[0].timestamp() * 1000)
        known = self._known(now)
        new = ~arrived[FRAME].isin(list(known)) & ~arrived[FRAME].duplicated()
        known.update((f, now) for f in arrived[FRAME])
        self._keep(known)
        yield arrived[new].drop(columns=[FRAME, PART, ARRIVED])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._keep(self._known(timerValues.getCurrentWatermarkInMs()))
        yield from ()

    def close(self) -> None:
        pass


def dedup_frames(rows: DataFrame, time: str = "ts", delay: str | None = None, keep_ms: int = 7 * 86_400_000, parts: int = 1024) -> DataFrame:
    """The first row to arrive of each (video, frame), in micro-batches the earliest by `time`. A copy is one that arrives within `keep_ms` of the last row of its frame.

    Nothing is dropped for being late: a frame that was never seen is written however old its `time` is, and a late copy is still a copy. State is a frame's id and when it
    last came, and goes by an event-time timer over the time of arrival, `keep_ms` after that. It is kept in `parts` parts, dealt by video and frame, so that a video with a
    third of all rows is no single task, and many small videos cost no call to the state store each: a micro-batch reads and writes each part that it touches once. Choose parts for
    some ten thousand frames each; a checkpoint holds for its number of parts. Null ids are ids. `delay` is ignored, as rows wait for no watermark. A copy that arrives later than `keep_ms` is a first row again.
    """
    keyed_state(rows.sparkSession)
    video = _text("video_id")
    named = F.concat(F.length(video).cast("string"), F.lit(":"), video, _text("frame_id"))  # the length tells where the video's id ends
    marked = rows.withColumns({FRAME: named, PART: F.pmod(F.xxhash64("video_id", "frame_id"), F.lit(parts)).cast("int"), ARRIVED: F.current_timestamp()})
    return marked.withWatermark(ARRIVED, "0 seconds").groupBy(PART).transformWithStateInPandas(_FirstFrames(time, keep_ms), rows.schema, "append", "EventTime")


def windowed_counts(rows: DataFrame, label: str, size: str = "1 hour", slide: str | None = None, gap: str | None = None, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows of each label in event-time windows: tumbling, sliding (slide) or session windows (gap)."""
    span = F.session_window(time, gap) if gap else F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.withWatermark(time, delay).groupBy(span.alias("w"), label).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), label, "n")


class _Diverse(StatefulProcessor):
    """Times taken of one video, at most k, until `expire_ms` of event time after its last rows."""

    def __init__(self, k: int, gap: float, time: str, expire_ms: int):
        self.k, self.gap, self.time, self.expire_ms = k, gap, time, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", T.StructType().add("t_sec", "double"))

    def _wait(self, last: int) -> None:
        """Until `expire_ms` after the latest time seen."""
        known = list(self.handle.listTimers())
        if not known or max(known) < last + self.expire_ms:
            for at in known:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(last + self.expire_ms)

    def handleInputRows(self, key, rows, timerValues):
        taken, out = [float(x[0]) for x in self.taken.get()], []
        before = len(taken)
        arrived = pd.concat([part[["video_id", "t_sec", "frame_id", self.time]] for part in rows]).sort_values(["t_sec", "frame_id"])
        for video, t, frame in zip(arrived["video_id"], arrived["t_sec"], arrived["frame_id"]):
            if len(taken) < self.k and all(abs(t - x) >= self.gap for x in taken):
                taken.append(float(t))
                out.append((video, frame, t))
        if len(taken) > before:
            self.taken.put([(t,) for t in taken])
        latest = arrived[self.time].max()
        if not pd.isna(latest):
            self._wait(int(latest.timestamp() * 1000))
        if out:
            yield pd.DataFrame(out, columns=["video_id", "frame_id", "t_sec"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.taken.appendList([(float(t),) for t in initialState["t_sec"]])  # a timer starts with the video's first rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.taken.clear()
        yield from ()

    def close(self) -> None:
        pass


def diverse_select(rows: DataFrame, k: int, gap: float, time: str = "ts", delay: str = "1 hour", expire_ms: int = 7_200_000, chosen: DataFrame | None = None) -> DataFrame:
    """In order of arrival: a row is taken if it is at least `gap` seconds from all taken of its video, at most k of them.

    Rows of one micro-batch arrive in order of (t_sec, frame_id), whatever order a shuffle gives them. Not the batch selection, as later scores are unknown. State is a list of at most
    k times a video; an event-time timer clears it `expire_ms` after the video's last rows. `chosen` (video_id, t_sec) is what an earlier run has
    selected: a batch table that a new checkpoint starts from, so that nothing is chosen again. Rows behind the watermark are not taken.
    """
    keyed_state(rows.sparkSession)
    marked = rows.withWatermark(time, delay).select(_text("video_id").alias(VIDEO), "video_id", "frame_id", "t_sec", time)
    schema = T.StructType().add("video_id", "long").add("frame_id", "long").add("t_sec", "double")
    first = None if chosen is None else chosen.select(_text("video_id").alias(VIDEO), F.col("t_sec").cast("double").alias("t_sec")).groupBy(VIDEO)
    return marked.groupBy(VIDEO).transformWithStateInPandas(_Diverse(k, gap, time, expire_ms), schema, "append", "EventTime", initialState=first)


def bucket_of(video, buckets: int):
    """The bucket of a video: a column to partition a history by, so that only touched buckets are read."""
    return F.pmod(F.xxhash64(video), F.lit(buckets)).cast("int")


class Selections:
    """A selection in versions: folders of buckets, and manifests that name the folder of each bucket.

    A manifest is written under another name and renamed once all its rows are, so readers see the version before or the one after and a crash between leaves
    the one before. It holds the number of the micro-batch it comes from: a batch that is replayed is passed over. Folders that no manifest of the last two
    names are deleted.
    """

    def __init__(self, spark: SparkSession, target: str, schema: str):
        self.spark, self.target, self.schema = spark, target.rstrip("/"), schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.target).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self.path(f"{self.target}/manifests")
        names = [x.getPath().getName() for x in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        versions = self._versions()
        if not versions:
            return {"batch": -1, "buckets": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.target}/manifests/v{version or versions[-1]}.json").first()["value"]
        return json.loads(text)

    def read(self) -> DataFrame:
        """The rows of the last version."""
        folders = self.manifest()["buckets"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.target}/rows/{folder}/bucket={b}" for b, folder in folders.items() if folder])

    def _announce(self, draft, version: int) -> None:
        if not self.fs.rename(draft, self.path(f"{self.target}/manifests/v{version}.json")):
            raise RuntimeError(f"version {version} of {self.target} was published by another stream")

    def publish(self, rows: DataFrame, touched: list[int], batch: int) -> None:
        """Replace the touched buckets by `rows`, which have a column bucket."""
        now = self.manifest()
        if batch <= now["batch"]:
            return
        folder = f"{batch}-{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.target}/rows/{folder}")
        written = {x.getPath().getName() for x in self.fs.listStatus(self.path(f"{self.target}/rows/{folder}"))}
        buckets = now["buckets"] | {str(b): folder if f"bucket={b}" in written else None for b in touched}
        version = (self._versions() or [0])[-1] + 1
        draft = self.path(f"{self.target}/manifests/draft-{folder}")
        self.fs.mkdirs(draft.getParent())
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "buckets": buckets}).encode()))
        out.close()
        self._announce(draft, version)
        named = {f for v in self._versions()[-2:] for f in self.manifest(v)["buckets"].values()}
        for old in self.fs.listStatus(self.path(f"{self.target}/rows")):
            if old.getPath().getName() not in named:
                self.fs.delete(old.getPath(), True)


def reselect_buckets(spark: SparkSession, updates: DataFrame, history: DataFrame, select, target: str, checkpoint: str, schema: str, buckets: int = 64) -> StreamingQuery:
    """For each micro-batch select again in the buckets that it touches, and publish them as a new version of `target` (see Selections).

    history: all rows, partitioned by `bucket` (bucket_of with the same number), of which only the touched partitions are read. select(rows) gives the chosen rows with
    the columns of `schema`, among them video_id; it may be called again for the same batch. A video of which nothing is chosen any more is gone. Null videos are a video.
    """

    def each(batch: DataFrame, number: int):
        selections = Selections(spark, target, schema)
        if number <= selections.manifest()["batch"]:
            return
        touched = [r[0] for r in batch.select(bucket_of("video_id", buckets)).distinct().collect()]  # at most `buckets` numbers
        if touched:
            with scratch(spark):
                chosen = select(history.where(F.col("bucket").isin(touched)).drop("bucket"))
                selections.publish(chosen.withColumn("bucket", bucket_of("video_id", buckets)), touched, number)

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reselect(spark: SparkSession, updates: DataFrame, everything, select, target: str, checkpoint: str) -> StreamingQuery:
    """For each micro-batch select again for the videos that it touches, and overwrite only their partitions of `target`.

    everything() gives all rows seen so far, select(rows) the chosen ones with a column video_id. If the rows are partitioned by video, only
    the touched partitions are read. A touched video of which nothing is chosen any more loses its partition.
    """

    def each(batch: DataFrame, _):
        touched = materialize(batch.select("video_id").where("video_id is not null").distinct(), "touched")
        chosen = materialize(select(everything().join(touched, "video_id", "left_semi")), "chosen")
        chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(target)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for r in touched.join(chosen.select("video_id").distinct(), "video_id", "left_anti").toLocalIterator():
            emptied = jvm.org.apache.hadoop.fs.Path(f"{target}/video_id={r['video_id']}")
            emptied.getFileSystem(conf).delete(emptied, True)
        discard(touched)
        discard(chosen)

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
