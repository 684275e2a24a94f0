"""Validation of videos and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions import angles, geometry, poses

#: Containers and codecs that are known to work.
FORMATS = ("mp4", "avi", "mov", "mkv", "webm", "flv", "m4v", "3gp", "wmv", "mpg", "mpeg")
CODECS = ("h264", "h265", "hevc", "vp8", "vp9", "av1", "mpeg4", "xvid", "divx", "wmv3", "msmpeg4v3")


def video_problems(videos: DataFrame) -> DataFrame:
    """Adds rejects and warnings (arrays of codes) and valid."""
    col = F.col
    rejects = [
        F.when(col("duration") < 0.1, "too_short"), F.when((col("fps") < 1) | (col("fps") > 240), "bad_frame_rate"),
        F.when((col("width") < 100) | (col("height") < 100), "too_small"), F.when(col("file_size_bytes") < 1024, "file_too_small"),
    ]
    warnings = [F.when(~F.lower("format").isin(*FORMATS), "unknown_format"), F.when(~F.lower("codec").isin(*CODECS), "unknown_codec")]
    out = videos.withColumn("rejects", F.array_compact(F.array(*rejects))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    return out.withColumn("valid", F.size("rejects") == 0)


def clamp_boxes(detections: DataFrame, least: float) -> DataFrame:
    """Detections of at least that confidence, their boxes cut to whole pixels inside the image; empty ones go."""
    kept = detections.where(F.col("conf") >= least)
    kept = kept.withColumns(dict(zip(geometry.BOX, geometry.clamped(geometry.box(), F.col("width"), F.col("height")))))
    return kept.where("x2 > x1 and y2 > y1")


def face_complete(box: list[Column], landmarks: Column, width: Column, height: Column, edge: int = 10, chin: int = 15) -> Column:
    """Clear of the edges; with five landmarks (eyes, nose, mouth corners) the estimated chin and cheeks too."""
    x1, y1, x2, y2 = box
    clear = (y2 < height - edge) & (x1 > edge) & (x2 < width - edge) & (y1 > edge)
    at = lambda i, axis: landmarks[i][axis]
    eye_y, mouth_y = (at(0, "y") + at(1, "y")) / 2, (at(3, "y") + at(4, "y")) / 2
    drop = mouth_y - eye_y
    half = F.abs(at(1, "x") - at(0, "x")) * 1.4 / 2
    middle = (at(0, "x") + at(1, "x")) / 2
    inside = (mouth_y + drop * 1.4 + chin < height) & (middle - half > 10) & (middle + half < width - 10)
    known = landmarks.isNotNull() & (F.size(landmarks) >= 5)
    return clear & F.when(known, F.when(drop <= 0, F.lit(True)).otherwise(inside)).otherwise(F.lit(True))


def face_valid(box: list[Column], conf: Column, landmarks: Column, width: Column, height: Column, least: float = 0.3, side: int = 30) -> Column:
    x1, y1, x2, y2 = box
    inside = (x1 >= 0) & (y1 >= 0) & (x2 <= width) & (y2 <= height) & (x2 > x1) & (y2 > y1)
    return inside & (x2 - x1 >= side) & (y2 - y1 >= side) & (conf >= least) & face_complete(box, landmarks, width, height)


def forward_facing_faces(faces: DataFrame, head_poses: DataFrame) -> DataFrame:
    """Faces whose padded crop is large enough and whose head faces the camera; a face without an estimate stays."""
    x1, y1, x2, y2 = geometry.box()
    w, h = F.col("width"), F.col("height")
    wide = F.least(w, x2 + 10) - F.greatest(F.lit(0), x1 - 10)
    high = F.least(h, y2 + 10) - F.greatest(F.lit(0), y1 - 10)
    both = faces.join(head_poses, ["video_id", "frame_id", "idx"], "left")
    ok = F.coalesce(angles.forward_facing(F.col("yaw"), F.col("pitch"), F.col("roll")), F.lit(True))
    return both.where((wide >= 30) & (high >= 30) & ok).select(*faces.columns)


def pose_valid(box: list[Column], conf: Column, keypoints: Column, width: Column, height: Column, least: float = 0.3, side: int = 50) -> Column:
    x1, y1, x2, y2 = box
    inside = (x1 >= 0) & (y1 >= 0) & (x2 <= width) & (y2 <= height) & (x2 > x1) & (y2 > y1)
    good = F.size(F.filter(F.map_values(keypoints), lambda p: p["conf"] > poses.LEAST)) >= 3
    return inside & (x2 - x1 >= side) & (y2 - y1 >= side) & (conf >= least) & good
