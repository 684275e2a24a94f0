"""Head angles: pure column expressions in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Direction -> (weight, yaw of its centre, pitch of its centre).
DIRECTIONS = {
    "front": (1.0, 0.0, 0.0),
    "looking_left": (0.9, 45.0, 0.0),
    "looking_right": (0.9, -45.0, 0.0),
    "profile_left": (0.8, 90.0, 0.0),
    "profile_right": (0.8, -90.0, 0.0),
    "looking_up": (0.85, 0.0, 30.0),
    "looking_down": (0.85, 0.0, -30.0),
    "looking_up_left": (0.75, 45.0, 30.0),
    "looking_up_right": (0.75, -45.0, 30.0),
}


def clamp(x: Column, low: float, high: float) -> Column:
    """x inside the bounds; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def normalize_angle(a: Column) -> Column:
    """The same angle in [-180, 180]; both ends stay as they are."""
    turn = F.lit(360.0)
    return F.when(a > 180, a - turn * F.ceil((a - 180) / turn)).when(a < -180, a + turn * F.ceil((-180 - a) / turn)).otherwise(a)


def euler_from_6d(v: list[Column]) -> Column:
    """struct<yaw, pitch, roll> of the rotation whose first two columns are spanned by two 3-vectors."""

    def unit(x):
        length = F.greatest(F.sqrt(sum((c * c for c in x[1:]), x[0] * x[0])), F.lit(1e-12))
        return [c / length for c in x]

    a = unit(v[:3])
    dot = a[0] * v[3] + a[1] * v[4] + a[2] * v[5]
    b = unit([v[3 + i] - dot * a[i] for i in range(3)])
    third_z = a[0] * b[1] - a[1] * b[0]
    sy = F.sqrt(a[0] * a[0] + a[1] * a[1])
    locked = sy < 1e-6
    yaw = F.when(locked, F.atan2(-b[0], b[1])).otherwise(F.atan2(a[1], a[0]))
    roll = F.when(locked, F.lit(0.0)).otherwise(F.atan2(b[2], third_z))
    return F.struct(F.degrees(yaw).alias("yaw"), F.degrees(F.atan2(-a[2], sy)).alias("pitch"), F.degrees(roll).alias("roll"))


def binned_angle(logits: Column) -> Column:
    """Expected angle of a softmax over bins of 3 degrees from -99."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(F.transform(weights, lambda w, i: w * (3 * i - 99)), F.lit(0.0), lambda s, x: s + x)
    return mean / total


def angle_confidence(yaw: Column, pitch: Column, roll: Column) -> Column:
    near = lambda a, wide: F.greatest(F.lit(0.0), 1 - F.abs(a) / F.lit(float(wide)))
    return near(yaw, 90) * 0.4 + near(pitch, 90) * 0.4 + near(roll, 45) * 0.2


def head_direction(yaw: Column, pitch: Column, straight: float = 22.5, profile: float = 67.5) -> Column:
    """One of eleven labels; positive yaw is left. Not-a-number and null angles are front."""
    side = F.when(yaw > 0, F.lit("left")).otherwise(F.lit("right"))
    height = F.when(pitch > straight, F.lit("up")).when(pitch < -straight, F.lit("down"))
    odd = F.isnan(yaw) | F.isnan(pitch) | yaw.isNull() | pitch.isNull()
    return (
        F.when(odd, F.lit("front"))
        .when(F.abs(yaw) <= straight, F.coalesce(F.concat(F.lit("looking_"), height), F.lit("front")))
        .when(F.abs(yaw) >= profile, F.concat(F.lit("profile_"), side))
        .otherwise(F.concat_ws("_", F.lit("looking"), height, side))
    )


def _lookup(direction: Column, place: int, otherwise) -> Column:
    table = F.create_map(*[x for name, values in DIRECTIONS.items() for x in (F.lit(name), F.lit(values[place]))])
    return F.coalesce(F.try_element_at(table, direction), F.lit(otherwise).cast("double"))


def direction_confidence(direction: Column, yaw: Column, pitch: Column, roll: Column, base: Column, max_roll: float = 30.0) -> Column:
    """Mean of the weighted confidence and of how near the angles are to the direction's centre, in [0.1, 1]."""
    tilt = F.when(F.abs(roll) > max_roll, F.greatest(F.lit(0.1), 1 - (F.abs(roll) - max_roll) / 60.0)).otherwise(F.lit(1.0))
    near = lambda a, place, wide: F.greatest(F.lit(0.0), 1 - F.abs(a - _lookup(direction, place, None)) / wide)
    known = direction.isin(*DIRECTIONS)
    centered = F.when(known, (near(yaw, 1, 90.0) + near(pitch, 2, 45.0)) / 2).otherwise(F.lit(0.5))
    return clamp((base * _lookup(direction, 0, 0.5) * tilt + centered) / 2, 0.1, 1.0)


def valid_orientation(roll: Column, max_roll: float = 30.0) -> Column:
    return F.abs(roll) <= max_roll


def forward_facing(yaw: Column, pitch: Column, roll: Column) -> Column:
    return (F.abs(yaw) <= 45) & (F.abs(pitch) <= 30) & (F.abs(roll) <= 30)
