"""Shot types and closeups of faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions import geometry, poses


def shot_type(ratio: Column) -> Column:
    return F.when(ratio >= 0.25, "extreme_closeup").when(ratio >= 0.15, "closeup").when(ratio >= 0.08, "medium_closeup").when(ratio >= 0.03, "medium_shot").otherwise("wide_shot")


def interocular(landmarks: Column) -> Column:
    """Distance of the first two of at least five landmarks."""
    return F.when(F.size(landmarks) >= 5, geometry.distance(F.try_element_at(landmarks, F.lit(1)), F.try_element_at(landmarks, F.lit(2))))


def distance_label(iod: Column) -> Column:
    return F.when(iod >= 80, "very_close").when(iod >= 50, "close").when(iod >= 25, "medium").when(iod.isNotNull(), "far")


def confidence(face_conf: Column, ratio: Column, iod: Column) -> Column:
    one = F.lit(1.0)
    near = F.when(iod > 0, F.least(one, iod / 50.0))
    return F.greatest(F.lit(0.3), poses.mean_of(face_conf, F.least(one, ratio / 0.08), near))


def detect(faces: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """A row a face. The body of the same keys lends its shoulders: wide ones make a distant shot a medium closeup.

    faces: keys, box, conf, landmarks, width, height; bodies: keys, keypoints. The keys end in the list index for
    index pairing, or hold a person id for pairing by person.
    """
    # figures are taken before the join, so that neither landmarks nor keypoints are shuffled by its keys
    ratio = poses.box_ratio(geometry.box(), F.col("width"), F.col("height"))
    figures = faces.select(*keys, "conf", "width", ratio.alias("face_ratio"), interocular(F.col("landmarks")).alias("iod"))
    spans = bodies.select(*keys, poses.shoulder_ratio(F.col("keypoints"), F.lit(1.0)).alias("span"))
    rows = figures.join(spans, keys, "left").withColumn("shoulders", F.col("span") / F.col("width")).withColumn("base", shot_type(F.col("face_ratio")))
    raised = F.coalesce(F.col("shoulders") >= 0.35, F.lit(False)) & F.col("base").isin("medium_shot", "wide_shot")
    conf = confidence(F.col("conf"), F.col("face_ratio"), F.col("iod"))
    shot = F.when(raised, "medium_closeup").otherwise(F.col("base"))
    return rows.select(
        *keys, shot.alias("shot_type"), shot.isin("extreme_closeup", "closeup", "medium_closeup").alias("is_closeup"), F.when(raised, F.least(F.lit(1.0), conf + 0.1)).otherwise(conf).alias("confidence"),
        "face_ratio", "iod", distance_label(F.col("iod")).alias("distance"), F.col("shoulders").alias("shoulder_ratio"),
    )
