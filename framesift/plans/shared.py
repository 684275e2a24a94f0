"""What several groups of queries derive from the views, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions.angles import DIRECTIONS

NAMES = ("nose", "left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")

#: Keypoints of sitting, squatting and ankle-less figures beside the standing ones, by vec_id modulo 4.
POSED = """select vec_id, kp, x + case when vec_id % 4 = 1 and kp like '%knee' then 180 when vec_id % 4 = 2 and kp like '%knee' then 150 else 0 end as x,
 y - case when vec_id % 4 = 1 and kp like '%knee' then 170 when vec_id % 4 = 2 and kp like '%knee' then 100 when vec_id % 4 = 2 and kp like '%ankle' then 250 else 0 end as y,
 case when vec_id % 4 = 3 and kp like '%ankle' then 1e-1 else conf end as conf from v_keypoints"""


def posed(keypoints: DataFrame) -> DataFrame:
    return keypoints.sparkSession.sql(POSED.replace("v_keypoints", "{k}"), k=keypoints)


def as_map(keypoints: DataFrame) -> DataFrame:
    """vec_id, keypoints as a map, their box, and the best confidence."""
    point = F.struct("kp", F.struct("x", "y", "conf").alias("p"))
    box = [f("x" if c[0] == "x" else "y").cast("int").alias(c) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))]
    return keypoints.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(point)).alias("keypoints"), *box, F.max("conf").alias("conf"))


#: The same as columns: k(vec_id, <name>_x, <name>_y, <name>_c, x1, y1, x2, y2), with unseen points as null in <name>_sx and <name>_sy.
WIDE = (
    f"posed as ({POSED}), k0 as (select vec_id, "
    + ", ".join(f"max(case when kp = '{n}' then {a} end) as {n}_{b}" for n in NAMES for a, b in (("x", "x"), ("y", "y"), ("conf", "c")))
    + ", trunc(min(x)) as x1, trunc(min(y)) as y1, trunc(max(x)) as x2, trunc(max(y)) as y2 from posed group by 1), k as (select *, "
    + ", ".join(f"case when {n}_c >= 5e-1 then {n}_{a} end as {n}_s{a}" for n in NAMES for a in "xy")
    + " from k0)"
)


def angle_sql(ax: str, ay: str, bx: str, by: str) -> str:
    size = f"sqrt(({ax})*({ax}) + ({ay})*({ay})) * sqrt(({bx})*({bx}) + ({by})*({by}))"
    return f"case when {size} = 0 then 0 else degrees(acos(greatest(-1e0, least(1e0, (({ax})*({bx}) + ({ay})*({by})) / ({size}))))) end"


def knee_sql(side: str) -> str:
    h, n, a = f"{side}_hip_s", f"{side}_knee_s", f"{side}_ankle_s"
    return f"18e1 - ({angle_sql(f'{n}x - {h}x', f'{n}y - {h}y', f'{a}x - {n}x', f'{a}y - {n}y')})"


def lean_sql(side: str) -> str:
    h, n = f"{side}_hip_s", f"{side}_knee_s"
    return angle_sql(f"{n}x - {h}x", f"{n}y - {h}y", "0e0", "1e0")


def known(side: str, *parts: str) -> str:
    return " and ".join(f"{side}_{p}_sx is not null" for p in parts)


TORSO = angle_sql("(left_shoulder_sx + right_shoulder_sx) / 2 - (left_hip_sx + right_hip_sx) / 2", "(left_shoulder_sy + right_shoulder_sy) / 2 - (left_hip_sy + right_hip_sy) / 2", "0e0", "-1e0")
#: a(.., lk, rk strict and lf, rf flexible knee angles, torso, sw shoulder ratio, br box ratio, lower points seen)
ANGLES = (
    "a as (select *, "
    + ", ".join(f"case when {known(s, 'hip', 'knee', 'ankle')} then {knee_sql(s)} end as {s[0]}k, case when {known(s, 'hip', 'knee', 'ankle')} then {knee_sql(s)} when {known(s, 'hip', 'knee')} then case when {lean_sql(s)} <= 20 then 17e1 when {lean_sql(s)} <= 45 then 15e1 else 12e1 end end as {s[0]}f" for s in ("left", "right"))
    + f", case when {known('left', 'shoulder', 'hip')} and {known('right', 'shoulder', 'hip')} then {TORSO} end as torso"
    + ", abs(right_shoulder_sx - left_shoulder_sx) / 1920 as sw, (x2 - x1) * (y2 - y1) / (1920e0 * 1080) as br, "
    + " + ".join(f"case when {n}_sx is null then 0 else 1 end" for n in NAMES[3:])
    + " as lower from k)"
)
ABOVE = "(coalesce(least(case when left_hip_sy < left_knee_sy then 1 when left_hip_sy >= left_knee_sy then 0 end, case when right_hip_sy < right_knee_sy then 1 when right_hip_sy >= right_knee_sy then 0 end), 0) = 1)"
STANDING = f"((coalesce(lf >= 160, false) or coalesce(rf >= 160, false) or (lf is null and rf is null and {ABOVE})) and coalesce(torso <= 30, false))"
SITTING = "(coalesce(lk between 80 and 120, false) or coalesce(rk between 80 and 120, false))"
SQUATTING = "((coalesce(lk <= 90, false) or coalesce(rk <= 90, false)) and coalesce(torso <= 30, false))"
CLOSEUP = "(coalesce(sw >= 35e-2, false) or (br >= 15e-2 and nose_sx is not null) or lower < 3)"


def mean_sql(floor: str, *factors: str) -> str:
    return f"greatest({floor}, coalesce(list_avg([x for x in [{', '.join(factors)}] if x is not null]), {floor}))"


TORSO_CONF = "case when torso is not null then greatest(3e-1, 1 - torso / 45e0) end"
CONFS = {
    "closeup": mean_sql("3e-1", "case when sw is not null then least(1e0, sw / 35e-2) end", "least(1e0, br / 15e-2)", "(6 - lower) / 6e0"),
    "standing": mean_sql("3e-1", *[f"case when {k} >= 160 then least(1e0, ({k} - 160) / 20e0 + 7e-1) end" for k in ("lk", "rk")], TORSO_CONF),
    "sitting": mean_sql("4e-1", *[f"case when {k} between 80 and 120 then greatest(5e-1, 1 - abs({k} - 90) / 30e0) end" for k in ("lk", "rk")]),
    "squatting": mean_sql("4e-1", *[f"case when {k} <= 90 then greatest(5e-1, 1 - {k} / 90e0) end" for k in ("lk", "rk")], TORSO_CONF),
}


def landmarks(faces: DataFrame) -> DataFrame:
    """Five landmarks at fixed places of the face box: eyes, nose, mouth corners."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    at = lambda a, b: F.struct((F.col("x1") + w * F.lit(a)).alias("x"), (F.col("y1") + h * F.lit(b)).alias("y"))
    return faces.withColumn("landmarks", F.array(at(0.3, 0.375), at(0.7, 0.375), at(0.5, 0.5), at(0.375, 0.75), at(0.625, 0.75)))


def landmarks_sql() -> str:
    return "x1 + (x2 - x1) * 3e-1 as lx, x1 + (x2 - x1) * 7e-1 as rx, y1 + (y2 - y1) * 375e-3 as ey, y1 + (y2 - y1) * 75e-2 as my"


DIRECTION_SQL = """case when abs(yaw) <= 225e-1 then case when pitch > 225e-1 then 'looking_up' when pitch < -225e-1 then 'looking_down' else 'front' end
 when abs(yaw) >= 675e-1 then case when yaw > 0 then 'profile_left' else 'profile_right' end
 else 'looking_' || case when pitch > 225e-1 then 'up_' when pitch < -225e-1 then 'down_' else '' end || case when yaw > 0 then 'left' else 'right' end end"""
CENTERS = "(values " + ", ".join(f"('{n}', {w}e0, {y}e0, {p}e0)" for n, (w, y, p) in DIRECTIONS.items()) + ") as c(direction, weight, cy, cp)"
