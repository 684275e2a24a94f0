"""Faces and bodies of a frame, paired to persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions import geometry

FRAME = ["video_id", "frame_id"]


def _side(detections: DataFrame, kind: str) -> DataFrame:
    """Boxes of one kind, with twice the centre, which stays whole."""
    rows = detections.where(F.col("kind") == kind)
    center = [(F.col("x1") + F.col("x2")).alias(f"{kind}_cx2"), (F.col("y1") + F.col("y2")).alias(f"{kind}_cy2")]
    return rows.select(*FRAME, F.col("idx").alias(f"{kind}_idx"), *[F.col(c).alias(f"{kind}_{c}") for c in geometry.BOX], F.col("conf").alias(f"{kind}_conf"), *center)


def faces_in_bodies(detections: DataFrame) -> DataFrame:
    """Pairs of a frame whose face centre lies in the body box, edges included; d2 is four times the squared centre distance."""
    pairs = _side(detections, "face").join(_side(detections, "body"), FRAME)
    inside = F.col("face_cx2").between(2 * F.col("body_x1"), 2 * F.col("body_x2")) & F.col("face_cy2").between(2 * F.col("body_y1"), 2 * F.col("body_y2"))
    dx, dy = (F.col("face_cx2") - F.col("body_cx2")).cast("long"), (F.col("face_cy2") - F.col("body_cy2")).cast("long")
    return pairs.where(inside).withColumn("d2", dx * dx + dy * dy).withColumn("distance", F.sqrt("d2") / 2)


def _accepted(sorted_pairs: Column) -> Column:
    """Of an array of pairs in order, those whose sides are both free when their turn comes."""

    def step(acc, p):
        taken = F.exists(acc, lambda a: (a["face_idx"] == p["face_idx"]) | (a["body_idx"] == p["body_idx"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(sorted_pairs, F.array().cast("array<struct<d2:bigint,face_idx:int,body_idx:int>>"), step)


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs accepted by rising distance while both sides are free; ties by face, then body. A frame has few pairs, so a fold of its array does it."""
    order = F.array_sort(F.collect_list(F.struct("d2", "face_idx", "body_idx")))
    slim = pairs.select(*FRAME, "d2", F.col("face_idx").cast("int").alias("face_idx"), F.col("body_idx").cast("int").alias("body_idx"))
    found = slim.groupBy(*FRAME).agg(_accepted(order).alias("ps"))
    return found.select(*FRAME, F.explode("ps").alias("p")).select(*FRAME, "p.face_idx", "p.body_idx", "p.d2", (F.sqrt("p.d2") / 2).alias("distance"))


def leftover_pairs(detections: DataFrame, matched: DataFrame) -> DataFrame:
    """Unmatched faces and bodies, ranked from left to right and paired by rank; what is over has a null partner."""

    def ranked(kind):
        free = _side(detections, kind).join(matched.select(*FRAME, f"{kind}_idx"), [*FRAME, f"{kind}_idx"], "left_anti")
        order = Window.partitionBy(*FRAME).orderBy(f"{kind}_cx2", f"{kind}_idx")
        return free.select(*FRAME, f"{kind}_idx", F.row_number().over(order).alias("rn"))

    return ranked("face").join(ranked("body"), [*FRAME, "rn"], "full_outer").select(*FRAME, "rn", "face_idx", "body_idx")


def persons(detections: DataFrame, box_quality: str | None = None) -> DataFrame:
    """Every face and body in one person: spatial pairs, then pairs by rank, then those alone. Initial quality from confidences.

    creation_seq is the order in which they arise: spatial pairs by distance, then the others by rank, pairs before faces before bodies.
    A frame holds what one image shows, so its detections are gathered by a single shuffle and matched as arrays.
    box_quality: a column of detections that persons bring along as `face_quality` and `body_quality`, so that no join has to.
    """
    # idx follows the centre, so that the struct's own order is that of the ranks from left to right
    own = [F.col(box_quality).alias("own")] if box_quality else []
    box = F.struct(F.expr("x1 + x2").alias("cx2"), F.col("idx").cast("int").alias("idx"), F.expr("y1 + y2").alias("cy2"), "conf", *geometry.BOX, *own)
    side = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, box)))
    frames = detections.where(F.col("kind").isin("face", "body")).groupBy(*FRAME).agg(side("face").alias("faces"), side("body").alias("bodies"))

    def around(face):
        """The face with each body that holds its centre."""
        inside = lambda b: face["cx2"].between(2 * b["x1"], 2 * b["x2"]) & face["cy2"].between(2 * b["y1"], 2 * b["y2"])

        def pair(b):
            dx, dy = (face["cx2"] - b["cx2"]).cast("long"), (face["cy2"] - b["cy2"]).cast("long")
            return F.struct((dx * dx + dy * dy).alias("d2"), face["idx"].alias("face_idx"), b["idx"].alias("body_idx"))

        return F.transform(F.filter("bodies", inside), pair)

    frames = frames.withColumn("spatial", _accepted(F.array_sort(F.flatten(F.transform("faces", around)))))
    free = lambda side, index: F.filter(side, lambda x: ~F.exists("spatial", lambda m: m[index] == x["idx"]))
    of = lambda side, index: F.get(F.filter(side, lambda x: x["idx"] == index), F.lit(0))
    near = F.transform("spatial", lambda m: F.struct(of("faces", m["face_idx"]).alias("face"), of("bodies", m["body_idx"]).alias("body"), F.lit(True).alias("spatial")))
    by_rank = F.transform(F.arrays_zip(free("faces", "face_idx").alias("face"), free("bodies", "body_idx").alias("body")), lambda z: F.struct(z["face"].alias("face"), z["body"].alias("body"), F.lit(False).alias("spatial")))
    rows = frames.select(*FRAME, F.posexplode(F.concat(near, by_rank)).alias("place", "p")).select(*FRAME, (F.col("place") + 1).alias("creation_seq"), "p.*")
    method = F.when(F.col("spatial"), "spatial").when(F.col("face").isNotNull() & F.col("body").isNotNull(), "index").when(F.col("face").isNotNull(), "face_only").otherwise("body_only")
    quality = F.coalesce("face.conf", F.lit(0.0)) * 0.7 + F.coalesce("body.conf", F.lit(0.0)) * 0.3
    return rows.select(
        *FRAME, "creation_seq", method.alias("method"), F.col("face.idx").alias("face_idx"), F.col("body.idx").alias("body_idx"), F.col("face.conf").alias("face_conf"),
        F.col("body.conf").alias("body_conf"), F.coalesce("body.cx2", "face.cx2").alias("cx2"), quality.alias("quality"),
        *([F.col("face.own").alias("face_quality"), F.col("body.own").alias("body_quality")] if box_quality else []),
    )


def with_person_ids(found: DataFrame) -> DataFrame:
    """person_id: rank from left to right by the body's centre, else the face's; ties as created."""
    return found.withColumn("person_id", F.row_number().over(Window.partitionBy(*FRAME).orderBy("cx2", "creation_seq")) - 1)


def attach_head_pose(found: DataFrame, head_poses: DataFrame, mode: str = "first") -> DataFrame:
    """Adds yaw, pitch, roll, direction to persons with a face: those of the frame's first head pose, or `by_face` of their own."""
    poses = head_poses.select(*FRAME, F.col("idx").cast("int").alias("hp_idx"), "yaw", "pitch", "roll", "direction")
    if mode == "first":
        return found.withColumn("hp_idx", F.when(F.col("face_idx").isNotNull(), 0)).join(poses, [*FRAME, "hp_idx"], "left").drop("hp_idx")
    return found.withColumn("hp_idx", F.col("face_idx")).join(poses, [*FRAME, "hp_idx"], "left").drop("hp_idx")


def frames_with(frames: DataFrame, *children: DataFrame) -> DataFrame:
    """Frames that have a row in any of the child tables."""
    keys = children[0].select(*FRAME)
    for c in children[1:]:
        keys = keys.unionByName(c.select(*FRAME))
    return frames.join(keys.distinct(), FRAME, "left_semi")


def best_detection(detections: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """`value` of the row with the highest confidence; of equals the first."""
    return detections.groupBy(*keys).agg(F.max_by(value, F.struct("conf", (-F.col("idx")).alias("i"))).alias("best"))


def marked_refs(refs: DataFrame, found: DataFrame) -> DataFrame:
    """References (video_id, frame_id, person_id) with their person's columns and whether there is one (`known`), by a single join, so that persons are made once."""
    return refs.join(found.withColumn("known", F.lit(True)), [*FRAME, "person_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def resolve_refs(refs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (video_id, frame_id, person_id) with their persons, and those without one."""
    keys = [*FRAME, "person_id"]
    return refs.join(found, keys), refs.join(found.select(*keys), keys, "left_anti")
