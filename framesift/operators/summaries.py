"""Counts over detections, and the result of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frames_per_label(rows: DataFrame, label: str) -> DataFrame:
    """Distinct frames of each label in a video."""
    return rows.where(F.col(label).isNotNull()).groupBy("video_id", label).agg(F.countDistinct("frame_id").alias("frames"))


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    """Detections of each label in a video."""
    return rows.where(F.col(label).isNotNull()).groupBy("video_id", label).agg(F.count("*").alias("n"))


def shot_counts(rows: DataFrame) -> DataFrame:
    """Detections of each shot type, and all of them under `total`."""
    return rows.rollup("shot_type").agg(F.count("*").alias("n")).select(F.coalesce("shot_type", F.lit("total")).alias("shot_type"), "n")


def face_coverage(frames: DataFrame, faces: DataFrame) -> DataFrame:
    """A row a video: faces, frames with faces and their share. The faces are counted before the join."""
    n = faces.groupBy("video_id", "frame_id").agg(F.count("*").alias("n"))
    out = frames.join(n, ["video_id", "frame_id"], "left").groupBy("video_id").agg(F.count("*").alias("frames"), F.coalesce(F.sum("n"), F.lit(0)).alias("faces"), F.count_if(F.col("n") > 0).alias("with_faces"))
    return out.withColumn("coverage_pct", F.col("with_faces") * F.lit(100.0) / F.col("frames"))


def persons_per_frame(persons: DataFrame) -> DataFrame:
    each = persons.groupBy("video_id", "frame_id").agg(F.count("*").alias("n"))
    return each.groupBy("video_id").agg(F.sum("n").alias("persons"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"), F.avg("n").alias("mean_persons"))


def top_labels(counts: DataFrame, label: str, n: str, most: int = 3) -> DataFrame:
    """A row a video: its most frequent labels as "name (count), ..", ties by name."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc(n), label))
    top = counts.withColumn("_r", rank).where(F.col("_r") <= most)
    items = F.array_sort(F.collect_list(F.struct("_r", F.format_string("%s (%d)", F.col(label), F.col(n)).alias("s"))))
    return top.groupBy("video_id").agg(F.array_join(F.transform(items, lambda x: x["s"]), ", ").alias("summary"))


def timings_total(timings: DataFrame) -> DataFrame:
    """timings: video_id, frame_id, step, ms. Null times do not count."""
    return timings.groupBy("video_id", "frame_id").agg(F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"))


def run_result(frames: DataFrame, faces: DataFrame, poses: DataFrame, directions: DataFrame, outputs: DataFrame) -> DataFrame:
    """A row a video: frames, faces, maps of frames by pose and by direction, files."""
    count = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    as_map = lambda df, label, name: frames_per_label(df, label).groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "frames")))).alias(name))
    out = count(frames, "frames")
    for part in (count(faces, "faces"), as_map(poses, "pose_label", "poses"), as_map(directions, "direction", "head_angles"), count(outputs, "files")):
        out = out.join(part, "video_id", "left")
    return out.na.fill(0, ["faces", "files"])
