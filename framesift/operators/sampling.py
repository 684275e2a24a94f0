"""Candidate frames of videos: sampling, merging and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames per second of each step at up to 1080p.
STEP_RATES = {"frame_extraction": 100.0, "face_detection": 10.0, "pose_analysis": 5.0, "quality_assessment": 20.0}


def keyframes(probe: DataFrame, videos: DataFrame) -> DataFrame:
    """Key frames inside the video; a missing time reads as 0."""
    rows = probe.where("pict_type = 'I'").select("video_id", F.coalesce("pts", F.lit(0.0)).alias("t_sec"))
    rows = rows.join(videos.select("video_id", "duration", "fps"), "video_id").where("t_sec <= duration")
    return rows.select("video_id", (F.col("t_sec") * F.col("fps")).cast("int").alias("frame_number"), "t_sec", F.lit("i_frame").alias("method"), F.lit(1.0).alias("confidence"))


def temporal(videos: DataFrame, interval: float = 0.25) -> DataFrame:
    """A sample every `interval` seconds, before the end and inside the frame count."""
    steps = F.greatest(F.ceil(F.col("duration") / interval).cast("int") - 1, F.lit(0))
    rows = spread(videos.where("duration > 0").select("video_id", "fps", "duration", "total_frames")).select("*", F.explode(F.sequence(F.lit(0), steps)).alias("i"))
    t = F.col("i") * F.lit(interval)
    rows = rows.withColumn("t_sec", t).withColumn("frame_number", (t * F.col("fps")).cast("int")).where("t_sec < duration and frame_number < total_frames")
    return rows.select("video_id", "frame_number", "t_sec", F.lit("temporal_sampling").alias("method"), F.lit(0.8).alias("confidence"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are about to become many, dealt to as many tasks as a shuffle has: a small file of them is one task otherwise."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def candidate_lists(probe: DataFrame, videos: DataFrame, existing: DataFrame | None = None, interval: float = 0.25) -> DataFrame:
    """A row a video (videos has one each): what `merge_candidates` makes of key frames and temporal samples, less the frames of `existing` (video_id, frame_number).

    Only key frames and existing ones are shuffled, once a frame; samples are made beside them. keys: (t_sec, frame_number) of the key frames left; steps: the numbers of the samples
    left, which are hashed against those that a key frame or an existing one stands for; considered: both lists before merging. An array has a place for each sample or frame of the video at most.
    """
    each = keyframes(probe, videos).groupBy("video_id", "frame_number").agg(F.min("t_sec").alias("t_sec"), F.count("*").alias("n"), F.lit(False).alias("gone"))
    if existing is not None:
        gone = existing.select("video_id", F.col("frame_number").cast("int").alias("frame_number")).distinct()
        each = each.unionByName(gone.select("*", F.lit(None).cast("double").alias("t_sec"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("gone")))
        each = each.groupBy("video_id", "frame_number").agg(F.min("t_sec").alias("t_sec"), F.sum("n").alias("n"), F.max("gone").alias("gone"))
    key = F.when(~F.col("gone"), F.struct("t_sec", "frame_number"))
    known = each.groupBy("video_id").agg(F.collect_list(key).alias("keys"), F.collect_list("frame_number").alias("met"), F.sum("n").alias("n"))
    rows = spread(videos.select("video_id", "duration", "fps", "total_frames"), "video_id").join(known, "video_id", "left")
    frame = lambda i: (i * F.lit(interval) * F.col("fps")).cast("int")
    last = F.greatest(F.ceil(F.col("duration") / interval).cast("int") - 1, F.lit(0))
    per = F.when(F.col("fps") > 0, F.col("fps") * F.lit(interval))  # frames a step

    def stands_for(f):
        """The samples of a frame."""
        low = F.coalesce(F.greatest(F.lit(0), F.floor(f / per).cast("int") - 1), F.lit(0))
        high = F.coalesce(F.least(last, F.ceil((f + 1) / per).cast("int") + 1), last)
        return F.filter(F.sequence(low, F.greatest(low, high)), lambda i: frame(i) == f)

    inside = lambda i: (i * F.lit(interval) < F.col("duration")) & (frame(i) < F.col("total_frames"))
    all_steps = F.when(F.col("duration") > 0, F.filter(F.sequence(F.lit(0), last), inside))
    rows = rows.withColumn("all", F.coalesce(all_steps, F.array().cast("array<int>")))
    first = F.filter("all", lambda i: (i == 0) | (frame(i - 1) != frame(i)))
    left = F.when(F.size("met") > 0, F.array_except(first, F.flatten(F.transform("met", stands_for)))).otherwise(first)
    none = F.array().cast("array<struct<t_sec:double,frame_number:int>>")
    return rows.select("video_id", "fps", F.coalesce("keys", none).alias("keys"), left.alias("steps"), (F.coalesce("n", F.lit(0)) + F.size("all")).alias("considered"))


def listed(lists: DataFrame, interval: float = 0.25, most: int | None = None) -> DataFrame:
    """The candidates of `candidate_lists`, a row each; at most `most` a video, by time."""
    t = lambda i: i * F.lit(interval)
    of = lambda c, p: F.struct(c["t_sec"].alias("t_sec"), c["frame_number"].alias("frame_number"), F.lit(p).alias("p"))
    keys = F.transform("keys", lambda c: of(c, 0))
    samples = F.transform("steps", lambda i: F.struct(t(i).alias("t_sec"), (t(i) * F.col("fps")).cast("int").alias("frame_number"), F.lit(1).alias("p")))
    found = F.concat(keys, samples)
    rows = lists.select("video_id", F.inline(found if most is None else F.slice(F.sort_array(found), 1, most)))
    key = F.col("p") == 0
    return rows.select("video_id", "frame_number", "t_sec", F.when(key, "i_frame").otherwise("temporal_sampling").alias("method"), F.when(key, 1.0).otherwise(0.8).alias("confidence"))


def merge_candidates(first: DataFrame, second: DataFrame, most: int | None = None) -> DataFrame:
    """Both lists; of one frame the first list's candidate stays, and of equals the earliest. At most `most` a video, by time."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    kept = both.groupBy("video_id", "frame_number").agg(F.min_by(F.struct("t_sec", "method", "confidence"), F.struct("_p", "t_sec")).alias("c")).select("video_id", "frame_number", "c.*")
    if most is None:
        return kept
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("t_sec", "frame_number"))
    return kept.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def without_existing(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    return candidates.join(existing.select("video_id", "frame_number").distinct(), ["video_id", "frame_number"], "left_anti")


def first_per_fingerprint(rows: DataFrame, key: str, order: str, fingerprint) -> DataFrame:
    """The first row of each fingerprint within a key. Partial aggregation, so that a fingerprint of a third of all rows is no burden."""
    return rows.withColumn("fingerprint", fingerprint).groupBy(key, "fingerprint").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def raster_fingerprint(px):
    return F.md5(F.concat_ws(",", F.transform(px, lambda p: p.cast("string"))))


def extraction_stats(lists: DataFrame, videos: DataFrame, interval: float = 0.25) -> DataFrame:
    """A row a video, from its `candidate_lists`; nothing but their sizes is read."""
    seen = lists.select("video_id", "considered", (F.size("keys") + F.size("steps")).alias("extracted"))
    rows = videos.select("video_id", "duration").join(seen, "video_id", "left").na.fill(0, ["considered", "extracted"])
    n, d = F.col("extracted"), F.col("duration")
    return rows.select(
        "video_id", "considered", (F.col("considered") - n).alias("duplicates_removed"), n,
        F.coalesce(F.try_divide(n * F.lit(interval), F.nullif(d, F.lit(0.0))) * 100, F.lit(0.0)).alias("coverage_pct"), F.coalesce(F.try_divide(d, F.nullif(n, F.lit(0)).cast("double")), F.lit(0.0)).alias("mean_interval"),
    )


def processing_estimate(videos: DataFrame) -> DataFrame:
    """Seconds of each step; a larger image than 1080p slows every step."""
    factor = F.greatest(F.lit(1.0), F.col("width") * F.col("height") / F.lit(1920.0 * 1080.0))
    steps = [(F.col("total_frames") / (F.lit(r) / factor)).alias(f"{s}_s") for s, r in STEP_RATES.items()]
    out = videos.select("video_id", *steps)
    return out.withColumn("total_s", sum((F.col(f"{s}_s") for s in STEP_RATES), F.lit(0.0)))
