"""Queries of head angles, poses and shots."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import angles, geometry, poses
from framesift.operators import closeups
from framesift.plans.registry import add
from framesift.plans.shared import ANGLES, CENTERS, CLOSEUP, CONFS, DIRECTION_SQL, SITTING, SQUATTING, STANDING, WIDE, as_map, landmarks, posed

HEAD = "v_headpose"

add(
    "normalize_angle", HEAD, lambda h: h.select("vec_id", angles.normalize_angle(F.col("yaw") * 7).alias("angle")),
    "select vec_id, round(case when yaw * 7 > 180 then yaw * 7 - 360 * ceil((yaw * 7 - 180) / 360) when yaw * 7 < -180 then yaw * 7 + 360 * ceil((-180 - yaw * 7) / 360) else yaw * 7 end, 6) as angle from v_headpose",
)


def _six(e):
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    return e.select("vec_id", angles.euler_from_6d(v).alias("r")).select("vec_id", "r.*")


add(
    "rot6d_to_euler", "embeddings", _six,
    """with v as (select vec_id, cast(embedding[1] as double) as p1, cast(embedding[2] as double) as p2, cast(embedding[3] as double) as p3, cast(embedding[4] as double) as q1, cast(embedding[5] as double) as q2, cast(embedding[6] as double) as q3 from embeddings),
    n as (select *, greatest(sqrt(p1 * p1 + p2 * p2 + p3 * p3), 1e-12) as l from v), a as (select vec_id, p1 / l as a1, p2 / l as a2, p3 / l as a3, q1, q2, q3 from n),
    d as (select *, a1 * q1 + a2 * q2 + a3 * q3 as d from a), u as (select *, q1 - d * a1 as u1, q2 - d * a2 as u2, q3 - d * a3 as u3 from d),
    m as (select *, greatest(sqrt(u1 * u1 + u2 * u2 + u3 * u3), 1e-12) as k from u), b as (select *, u1 / k as b1, u2 / k as b2, u3 / k as b3, sqrt(a1 * a1 + a2 * a2) as sy from m)
    select vec_id, round(degrees(case when sy < 1e-6 then atan2(-b1, b2) else atan2(a2, a1) end), 6) as yaw, round(degrees(atan2(-a3, sy)), 6) as pitch, round(degrees(case when sy < 1e-6 then 0e0 else atan2(b3, a1 * b2 - a2 * b1) end), 6) as roll from b""",
)
add(
    "binned_softmax_angle", "embeddings", lambda e: e.select("vec_id", angles.binned_angle(F.transform("embedding", lambda x: x.cast("double") * 10)).alias("angle")),
    """with l as (select vec_id, unnest(embedding) as x, unnest(range(0, len(embedding))) as i from embeddings), w as (select vec_id, i, exp(cast(x as double) * 10) as w from l)
    select vec_id, round(sum(w * (3 * i - 99)) / sum(w), 6) as angle from w group by 1""",
)
add(
    "angle_confidence", HEAD, lambda h: h.select("vec_id", angles.angle_confidence(F.col("yaw"), F.col("pitch"), F.col("roll")).alias("confidence")),
    "select vec_id, round(greatest(0, 1 - abs(yaw) / 9e1) * 4e-1 + greatest(0, 1 - abs(pitch) / 9e1) * 4e-1 + greatest(0, 1 - abs(roll) / 45e0) * 2e-1, 6) as confidence from v_headpose",
)
add("head_direction", HEAD, lambda h: h.select("vec_id", angles.head_direction(F.col("yaw"), F.col("pitch")).alias("direction")), f"select vec_id, {DIRECTION_SQL} as direction from v_headpose")
add(
    "head_direction_confidence", HEAD,
    lambda h: h.withColumn("direction", angles.head_direction(F.col("yaw"), F.col("pitch"))).select("vec_id", "direction", angles.direction_confidence(F.col("direction"), F.col("yaw"), F.col("pitch"), F.col("roll"), F.col("conf")).alias("confidence")),
    f"""with d as (select *, {DIRECTION_SQL} as direction from v_headpose)
    select vec_id, d.direction, round(greatest(1e-1, least(1e0, (conf * coalesce(weight, 5e-1) * case when abs(roll) > 30 then greatest(1e-1, 1 - (abs(roll) - 30) / 6e1) else 1 end
    + case when c.direction is null then 5e-1 else (greatest(0, 1 - abs(yaw - cy) / 9e1) + greatest(0, 1 - abs(pitch - cp) / 45e0)) / 2 end) / 2)), 6) as confidence from d left join {CENTERS} on c.direction = d.direction""",
)
add("head_pose_valid_orientation", HEAD, lambda h: h.select("vec_id", angles.valid_orientation(F.col("roll")).alias("valid")), "select vec_id, abs(roll) <= 30 as valid from v_headpose")

K = "v_keypoints"


def figures(k):
    return as_map(posed(k))


def box():
    return [F.col(c) for c in geometry.BOX]


WH = lambda: (F.lit(1920), F.lit(1080))
START = f"with {WIDE}, {ANGLES} "
pair = lambda f: [f(F.col("keypoints"), s).alias(s) for s in ("left", "right")]
add("knee_angle", K, lambda k: figures(k).select("vec_id", *pair(poses.knee_angle)), START + 'select vec_id, round(lk, 6) as "left", round(rk, 6) as "right" from a')
add("knee_angle_flexible", K, lambda k: figures(k).select("vec_id", *pair(poses.knee_angle_flexible)), START + 'select vec_id, round(lf, 6) as "left", round(rf, 6) as "right" from a')
add("torso_angle", K, lambda k: figures(k).select("vec_id", poses.torso_angle(F.col("keypoints")).alias("torso")), START + "select vec_id, round(torso, 6) as torso from a")
add("pose_is_standing", K, lambda k: figures(k).select("vec_id", poses.is_standing(F.col("keypoints")).alias("standing")), START + f"select vec_id, {STANDING} as standing from a")
add("pose_is_sitting", K, lambda k: figures(k).select("vec_id", poses.is_sitting(F.col("keypoints")).alias("sitting")), START + f"select vec_id, {SITTING} as sitting from a")
add("pose_is_squatting", K, lambda k: figures(k).select("vec_id", poses.is_squatting(F.col("keypoints")).alias("squatting")), START + f"select vec_id, {SQUATTING} as squatting from a")
add("pose_is_closeup", K, lambda k: figures(k).select("vec_id", poses.is_closeup(F.col("keypoints"), box(), *WH()).alias("closeup")), START + f"select vec_id, {CLOSEUP} as closeup from a")
add(
    "pose_label_confidence", K, lambda k: figures(k).select("vec_id", *[c.alias(n) for n, c in poses.label_confidences(F.col("keypoints"), box(), *WH()).items()]),
    START + "select vec_id, " + ", ".join(f"round({c}, 6) as {n}" for n, c in CONFS.items()) + " from a",
)
HOLDS = {"closeup": CLOSEUP, "standing": STANDING, "sitting": SITTING, "squatting": SQUATTING}
add(
    "pose_classify", K, lambda k: figures(k).select("vec_id", F.posexplode(poses.classify(F.col("keypoints"), box(), *WH())).alias("pos", "l")).select("vec_id", "pos", "l.label", "l.conf"),
    START + ", l as (" + " union all ".join(f"select vec_id, {i} as i, '{n}' as label, {CONFS[n]} as conf from a where {HOLDS[n]}" for i, n in enumerate(HOLDS)) + ") select vec_id, row_number() over (partition by vec_id order by i) - 1 as pos, label, round(conf, 6) as conf from l",
)

DET = "v_detections"
RATIO = "(x2 - x1) * (y2 - y1) / (1920e0 * 1080)"
SHOT = "case when {r} >= 25e-2 then 'extreme_closeup' when {r} >= 15e-2 then 'closeup' when {r} >= 8e-2 then 'medium_closeup' when {r} >= 3e-2 then 'medium_shot' else 'wide_shot' end"
grown = lambda d: d.where("kind = 'face'").withColumn("x2", F.col("x1") + (F.col("x2") - F.col("x1")) * 4).withColumn("y2", F.col("y1") + (F.col("y2") - F.col("y1")) * 4)
GROWN = "g as (select video_id, frame_id, idx, x1, y1, x1 + (x2 - x1) * 4 as x2, y1 + (y2 - y1) * 4 as y2, conf from v_detections where kind = 'face')"
add(
    "shot_type", DET, lambda d: grown(d).withColumn("r", poses.box_ratio(box(), F.col("width"), F.col("height"))).select("video_id", "frame_id", "idx", closeups.shot_type(F.col("r")).alias("shot_type")),
    f"with {GROWN} select video_id, frame_id, cast(idx as bigint) as idx, {SHOT.format(r=RATIO)} as shot_type from g",
)
add(
    "interocular_distance", DET, lambda d: landmarks(grown(d)).withColumn("iod", closeups.interocular(F.col("landmarks"))).select("video_id", "frame_id", "idx", "iod", closeups.distance_label(F.col("iod")).alias("distance")),
    f"with {GROWN}, i as (select *, (x2 - x1) * 4e-1 as iod from g) select video_id, frame_id, cast(idx as bigint) as idx, round(iod, 6) as iod, case when iod >= 80 then 'very_close' when iod >= 50 then 'close' when iod >= 25 then 'medium' else 'far' end as distance from i",
)


def _closeups(d, k):
    """Faces with landmarks for even frames; the body with the same index has the keypoints of a vector."""
    faces = landmarks(grown(d)).withColumn("landmarks", F.when(F.col("frame_id") % 2 == 0, F.col("landmarks")))
    bodies = d.where("kind = 'body'").withColumn("vec_id", (F.col("frame_id") + F.col("idx")) % max(1, k.select("vec_id").distinct().count())).join(as_map(k.withColumn("x", F.col("x") + F.when((F.col("vec_id") % 5 == 0) & F.col("kp").isin("left_shoulder"), 600).otherwise(0))).select("vec_id", "keypoints"), "vec_id")
    return closeups.detect(faces, bodies, ["video_id", "frame_id", "idx"])


add(
    "closeup_detect", f"{DET} {K}", _closeups,
    f"""with {GROWN}, s as (select vec_id, abs(max(case when kp = 'right_shoulder' and conf >= 5e-1 then x end) - max(case when kp = 'left_shoulder' and conf >= 5e-1 then x + case when vec_id % 5 = 0 then 600 else 0 end end)) / 1920 as sr from v_keypoints group by 1),
    b as (select video_id, frame_id, idx, sr from v_detections d cross join (select count(distinct vec_id) as n from v_keypoints) c join s on s.vec_id = (d.frame_id + d.idx) % c.n where kind = 'body'),
    f as (select g.*, {RATIO} as r, case when frame_id % 2 = 0 then (x2 - x1) * 4e-1 end as iod, sr from g left join b using (video_id, frame_id, idx)),
    t as (select *, {SHOT.format(r="r")} as base, greatest(3e-1, list_avg([x for x in [conf, least(1e0, r / 8e-2), least(1e0, iod / 5e1)] if x is not null and (iod is not null or true)])) as c from f),
    c as (select *, coalesce(sr >= 35e-2, false) and base in ('medium_shot', 'wide_shot') as up from t)
    select video_id, frame_id, cast(idx as bigint) as idx, case when up then 'medium_closeup' else base end as shot_type, up or base in ('extreme_closeup', 'closeup', 'medium_closeup') as is_closeup, round(case when up then least(1e0, c + 1e-1) else c end, 6) as confidence, round(r, 6) as face_ratio, round(iod, 6) as iod,
    case when iod >= 80 then 'very_close' when iod >= 50 then 'close' when iod >= 25 then 'medium' when iod is not null then 'far' end as distance, round(sr, 6) as shoulder_ratio from c""".replace("least(1e0, iod / 5e1)", "case when iod is not null then least(1e0, iod / 5e1) end").replace(" and (iod is not null or true)", ""),
)
