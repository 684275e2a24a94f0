"""Body poses from keypoints: column expressions over map<string, struct<x, y, conf>>.

Every function takes the map; a point that is missing or below `least` confidence counts as unseen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 0.5
LOWER_BODY = ("left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")
SIDES = ("left", "right")


def point(keypoints: Column, name: str) -> Column:
    return F.try_element_at(keypoints, F.lit(name))


def seen(keypoints: Column, *names: str, least: float = LEAST) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(point(keypoints, n)["conf"] >= least, F.lit(False))
    return out


def present(keypoints: Column, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & point(keypoints, n).isNotNull()
    return out


def between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors; 0 if one has no length."""
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.degrees(F.acos(cosine)))


def _step(keypoints: Column, a: str, b: str) -> tuple[Column, Column]:
    p, q = point(keypoints, a), point(keypoints, b)
    return q["x"] - p["x"], q["y"] - p["y"]


def knee_angle(keypoints: Column, side: str) -> Column:
    """Angle of the knee, 180 when straight; null unless hip, knee and ankle are seen."""
    hip, knee, ankle = (f"{side}_{x}" for x in ("hip", "knee", "ankle"))
    bend = between(*_step(keypoints, hip, knee), *_step(keypoints, knee, ankle))
    return F.when(seen(keypoints, hip, knee, ankle), 180.0 - bend)


def knee_angle_flexible(keypoints: Column, side: str) -> Column:
    """As knee_angle; without the ankle a guess from how upright the thigh is."""
    hip, knee = f"{side}_hip", f"{side}_knee"
    lean = between(*_step(keypoints, hip, knee), F.lit(0.0), F.lit(1.0))
    guess = F.when(lean <= 20, 170.0).when(lean <= 45, 150.0).otherwise(120.0)
    return F.coalesce(knee_angle(keypoints, side), F.when(seen(keypoints, hip, knee), guess))


def torso_angle(keypoints: Column) -> Column:
    """Degrees between hips-to-shoulders and straight up; null unless all four are seen."""
    names = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")
    ls, rs, lh, rh = (point(keypoints, n) for n in names)
    dx = (ls["x"] + rs["x"]) / 2 - (lh["x"] + rh["x"]) / 2
    dy = (ls["y"] + rs["y"]) / 2 - (lh["y"] + rh["y"]) / 2
    return F.when(seen(keypoints, *names), between(dx, dy, F.lit(0.0), F.lit(-1.0)))


def hips_above_knees(keypoints: Column) -> Column:
    """Every side whose hip and knee are seen has the hip above the knee, and there is one."""
    sides = [F.when(seen(keypoints, f"{s}_hip", f"{s}_knee"), point(keypoints, f"{s}_hip")["y"] < point(keypoints, f"{s}_knee")["y"]) for s in SIDES]
    return F.coalesce(F.least(*[x.cast("int") for x in sides]) == 1, F.lit(False))


def _upright(keypoints: Column, most: float = 30.0) -> Column:
    return F.coalesce(torso_angle(keypoints) <= most, F.lit(False))


def is_standing(keypoints: Column) -> Column:
    angles = [knee_angle_flexible(keypoints, s) for s in SIDES]
    straight = F.coalesce(angles[0] >= 160, F.lit(False)) | F.coalesce(angles[1] >= 160, F.lit(False))
    unseen = angles[0].isNull() & angles[1].isNull() & F.coalesce(hips_above_knees(keypoints), F.lit(False))
    return present(keypoints, *LOWER_BODY[:4]) & (straight | unseen) & _upright(keypoints)


def is_sitting(keypoints: Column) -> Column:
    out = F.lit(False)
    for s in SIDES:
        out = out | F.coalesce(knee_angle(keypoints, s).between(80, 120), F.lit(False))
    return present(keypoints, *LOWER_BODY[:4]) & out


def is_squatting(keypoints: Column) -> Column:
    out = F.lit(False)
    for s in SIDES:
        out = out | F.coalesce(knee_angle(keypoints, s) <= 90, F.lit(False))
    return present(keypoints, *LOWER_BODY) & out & _upright(keypoints)


def shoulder_ratio(keypoints: Column, width: Column, least: float = LEAST) -> Column:
    """Distance of the shoulders along x over the image width; null unless both are seen."""
    dx, _ = _step(keypoints, "left_shoulder", "right_shoulder")
    return F.when(seen(keypoints, "left_shoulder", "right_shoulder", least=least), F.abs(dx) / width)


def box_ratio(box: list[Column], width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = box
    return ((x2 - x1) * (y2 - y1)).cast("double") / (width * height)


def lower_body_seen(keypoints: Column) -> Column:
    return sum((seen(keypoints, n).cast("int") for n in LOWER_BODY), F.lit(0))


def is_closeup(keypoints: Column, box: list[Column], width: Column, height: Column) -> Column:
    near = F.coalesce(shoulder_ratio(keypoints, width) >= 0.35, F.lit(False)) | (box_ratio(box, width, height) >= 0.15) & seen(keypoints, "nose")
    return near | (lower_body_seen(keypoints) < 3)


def mean_of(*factors: Column) -> Column:
    """Mean of those that are not null; null if all are."""
    known = F.array_compact(F.array(*factors))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def label_confidences(keypoints: Column, box: list[Column], width: Column, height: Column) -> dict[str, Column]:
    """Confidence of each label, were it given."""
    floor = lambda least, *factors: F.greatest(F.lit(least), F.coalesce(mean_of(*factors), F.lit(least)))
    one = lambda x: F.least(F.lit(1.0), x)
    knees = [knee_angle(keypoints, s) for s in SIDES]
    torso = F.greatest(F.lit(0.3), 1 - torso_angle(keypoints) / 45.0)
    torso = F.when(torso_angle(keypoints).isNotNull(), torso)
    return {
        "closeup": floor(0.3, F.when(shoulder_ratio(keypoints, width).isNotNull(), one(shoulder_ratio(keypoints, width) / 0.35)), one(box_ratio(box, width, height) / 0.15), (6 - lower_body_seen(keypoints)) / 6.0),
        "standing": floor(0.3, *[F.when(k >= 160, one((k - 160) / 20.0 + 0.7)) for k in knees], torso),
        "sitting": floor(0.4, *[F.when(k.between(80, 120), F.greatest(F.lit(0.5), 1 - F.abs(k - 90) / 30.0)) for k in knees]),
        "squatting": floor(0.4, *[F.when(k <= 90, F.greatest(F.lit(0.5), 1 - k / 90.0)) for k in knees], torso),
    }


def classify(keypoints: Column, box: list[Column], width: Column, height: Column) -> Column:
    """array<struct<label, conf>> in the order closeup, standing, sitting, squatting."""
    conf = label_confidences(keypoints, box, width, height)
    holds = {"closeup": is_closeup(keypoints, box, width, height), "standing": is_standing(keypoints), "sitting": is_sitting(keypoints), "squatting": is_squatting(keypoints)}
    return F.array_compact(F.array(*[F.when(holds[n], F.struct(F.lit(n).alias("label"), conf[n].alias("conf"))) for n in holds]))


def keypoint_confidence(keypoints: Column) -> Column:
    """Mean of the best 70 % of the confidences above 0.1, weighted by 1 / rank; 0 without any."""
    known = F.sort_array(F.filter(F.transform(F.map_values(keypoints), lambda p: p["conf"]), lambda c: c > 0.1), asc=False)
    n = F.greatest(F.lit(1), F.floor(F.size(known) * F.lit(0.7)).cast("int"))
    best = F.slice(known, 1, n)
    top = F.aggregate(F.transform(best, lambda c, i: c / (i + 1)), F.lit(0.0), lambda s, x: s + x)
    weight = F.aggregate(F.transform(best, lambda c, i: F.lit(1.0) / (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(known) > 0, top / weight).otherwise(F.lit(0.0))


def normalize(keypoints: Column, width: Column, height: Column) -> Column:
    """Confidences in [0, 1]; points outside the image are moved to its edge and their confidence halved."""

    def fix(_, p):
        conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["conf"]))
        x, y = F.greatest(F.lit(0.0), F.least(width.cast("double"), p["x"])), F.greatest(F.lit(0.0), F.least(height.cast("double"), p["y"]))
        out = (p["x"] < 0) | (p["x"] > width) | (p["y"] < 0) | (p["y"] > height)
        return F.struct(F.when(out, x).otherwise(p["x"]).alias("x"), F.when(out, y).otherwise(p["y"]).alias("y"), F.when(out, conf * 0.5).otherwise(conf).alias("conf"))

    return F.transform_values(keypoints, fix)
