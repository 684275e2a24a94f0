"""Plans of what is cut out and written, and the cutting of raw rasters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions import geometry, naming
from framesift.operators.ranks import rank_within
from framesift.operators.rasters import binary, views
from framesift.operators.store import materialize

#: Bytes of crops in one Arrow batch.
OUTPUT = 32 << 20
#: A stem that another stem's number may have made.
NUMBERED = r"_(?:00[1-9]|0[1-9][0-9]|[1-9][0-9]{2,})$"


def crop_plan(boxes: DataFrame, padding: float, aspect: tuple[int, int] | None = None, resize: int | None = None, default_size: int = 640) -> DataFrame:
    """Adds the crop box cx1..cy2, overhang left/top/right/bottom, out_width, out_height and restore (the crop is enlarged)."""
    w, h = F.col("width"), F.col("height")
    b = geometry.padded(geometry.box(), padding, w, h)
    if aspect:
        b = geometry.fitted(b, *aspect)
    out = boxes.withColumns(dict(zip(("cx1", "cy1", "cx2", "cy2"), b)))
    cut = [F.col(c) for c in ("cx1", "cy1", "cx2", "cy2")]
    over = geometry.overhang(cut, w, h)
    least = resize if resize is not None else default_size
    wide, high = cut[2] - cut[0], cut[3] - cut[1]
    size = geometry.upscaled(wide, high, least)
    return out.withColumns(dict(zip(("left", "top", "right", "bottom"), over)) | {"out_width": size[0], "out_height": size[1], "restore": (wide < least) & (high < least)})


def resize_plan(frames: DataFrame, most: int | None) -> DataFrame:
    return frames.withColumns(dict(zip(("out_width", "out_height"), geometry.shrunk(F.col("width"), F.col("height"), most))))


def crop_pixels(rasters: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Cuts planned boxes (cx1..cy2) out of gray rasters: (key, box_id, px, alpha, width, height), px and alpha as bytes. Beyond the raster both are 0.

    A box without width or height is empty; a null raster, or one of another size than it says, gives no rows.
    """
    each = plan.groupBy(key).agg(F.collect_list(F.struct("box_id", "cx1", "cy1", "cx2", "cy2")).alias("boxes"))
    rows = binary(rasters).join(each, key).select(key, "px", "width", "height", "boxes")
    kind = rasters.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            types = [b.schema.field(key).type, pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
            out, size = [], 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) if out else [[]] * 6, types)], [key, "box_id", "px", "alpha", "width", "height"])  # noqa: B023

            for k, image, found in zip(b.column(key).to_pylist(), views(b), b.column("boxes").to_pylist()):
                for x in found if image is not None else ():
                    h, w = image.shape
                    x1, y1, x2, y2 = x["cx1"], x["cy1"], max(x["cx1"], x["cx2"]), max(x["cy1"], x["cy2"])
                    cut, alpha = np.zeros((y2 - y1, x2 - x1), np.uint8), np.zeros((y2 - y1, x2 - x1), np.uint8)
                    a, c, d, e = max(0, x1), max(0, y1), min(w, x2), min(h, y2)
                    if d > a and e > c:
                        cut[c - y1 : e - y1, a - x1 : d - x1] = image[c:e, a:d]
                        alpha[c - y1 : e - y1, a - x1 : d - x1] = 255
                    out.append((k, x["box_id"], cut.tobytes(), alpha.tobytes(), x2 - x1, y2 - y1))
                    size += 2 * cut.size
                    if size > OUTPUT:
                        yield flush()
                        out, size = [], 0
            yield flush()

    return rows.mapInArrow(run, f"`{key}` {kind}, box_id long, px binary, alpha binary, width int, height int")


def unique_names(rows: DataFrame, name: str = "name", key: str = "video_id", order: str = "seq", whole: int = 1_000_000) -> DataFrame:
    """Adds unique_name, which no two rows of a video share, by falling precedence of `order` (unique in a video).

    The first use of a name keeps it. Later ones get _001, _002 and so on before the extension, counted by stem, whatever the extension; a number
    whose name is taken already, by a name of its own or a numbered one, is passed over. A null name stays null. A null key is a key.

    Where no name reads like another's numbered one, the number is the row's place among its stem's later uses, which ranks of any group size
    give. Only names of the same root (the stem without its trailing numbers) can meet. Roots in which a stem with later uses has its numbered name
    in the table are streamed in order, root by root, by tasks that hold a root's names.
    """
    stem = naming.stem(F.col(name))
    parent = F.when(stem.rlike(NUMBERED), F.regexp_replace(stem, NUMBERED, ""))
    root = F.struct(F.col(key).alias("key"), F.regexp_replace(stem, f"(?:{NUMBERED[:-1]})+$", "").alias("stem"))
    out = [*[c for c in rows.columns if c != "unique_name"], "unique_name"]
    marked = rows.withColumns({"_root": root, "_stem": F.struct(F.col(key).alias("key"), stem.alias("stem")), "_name": F.struct(F.col(key).alias("key"), F.col(name).alias("name"))})
    again = marked.groupBy("_name").agg(F.first("_stem").alias("_stem"), F.count("*").alias("n")).where("n > 1").select("_stem").distinct()
    children = marked.where(parent.isNotNull()).select(F.struct(F.col(key).alias("key"), parent.alias("stem")).alias("_stem"), "_root")
    meeting = children.join(again, "_stem", "left_semi").select("_root").distinct()
    if meeting.isEmpty():
        return _numbered(marked, name, key, order, whole).select(*out)
    meeting = materialize(meeting, "meeting-names")
    plain = _numbered(marked.join(meeting, "_root", "left_anti"), name, key, order, whole).select(*out)
    return plain.unionByName(_streamed(marked.join(meeting, "_root", "left_semi"), rows.columns, name, order).select(*out))


def _numbered(marked: DataFrame, name: str, key: str, order: str, whole: int = 1_000_000) -> DataFrame:
    """The k-th later use of a stem gets the number k. Videos of up to `whole` rows are numbered by a task each, after one shuffle; the result does not depend on it."""
    if marked.groupBy(key).count().where(F.col("count") > whole).isEmpty():
        used = marked.repartition(key).withColumn("_use", F.row_number().over(Window.partitionBy(key, "_name").orderBy(order)))
        is_later = (F.col("_use") > 1) & F.col(name).isNotNull()
        place = F.sum(is_later.cast("int")).over(Window.partitionBy(key, "_stem").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        numbered = naming.with_suffix(F.col(name), F.concat(F.lit("_"), naming.rank_text(place)))
        return used.withColumn("unique_name", F.when(is_later, numbered).otherwise(F.col(name))).drop("_use")
    used = rank_within(marked, ["_name"], [F.col(order)], "_use")
    later = rank_within(used.where(f"_use > 1 and `{name}` is not null"), ["_stem"], [F.col(order)], "_k")
    numbered = naming.with_suffix(F.col(name), F.concat(F.lit("_"), naming.rank_text(F.col("_k"))))
    first = used.where(f"_use = 1 or `{name}` is null").withColumn("unique_name", F.col(name))
    return first.drop("_use").unionByName(later.withColumn("unique_name", numbered).drop("_use", "_k"))


def _streamed(marked: DataFrame, columns: list[str], name: str, order: str) -> DataFrame:
    kept = [c for c in columns if c != "unique_name"]
    stems = marked.withColumns({"_head": naming.stem(F.col(name)), "_tail": naming.extension(F.col(name))})
    placed = stems.repartition("_root").sortWithinPartitions("_root", order).select(*kept, "_root", F.col(name).alias("_own"), "_head", "_tail")
    schema = T.StructType([marked.schema[c] for c in kept] + [T.StructField("unique_name", T.StringType())])

    def run(batches):
        at, used, counts = None, set(), {}
        for b in batches:
            out = []
            for where, own, head, tail in zip(*(b.column(c).to_pylist() for c in ("_root", "_own", "_head", "_tail"))):
                where = tuple(where.values())
                if where != at:
                    at, used, counts = where, set(), {}
                found = own
                if own in used:
                    n = counts.get(head, 0) + 1
                    while (found := f"{head}_{n:03d}{tail}") in used:
                        n += 1
                    counts[head] = n
                if own is not None:
                    used.add(found)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string())], names=schema.names)

    return placed.mapInArrow(run, schema)


def _kinds(*items: tuple[str, Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(kind).alias("kind"), name.alias("name"))) for kind, holds, name in items]))


def frame_outputs(selected: DataFrame, full_frames: bool = True, pose_crops: bool = True, face_crops: bool = True) -> DataFrame:
    """A row for each file of a selected frame.

    selected: video_id, frame_id, poses, head_angles, primary_category, selection_rank, direction, shot_type, has_face, has_pose.
    """
    video, rank, nobody = F.concat(F.lit("video_"), F.col("video_id").cast("string")), F.coalesce("selection_rank", F.lit(1)), F.lit(None).cast("int")
    head, shot = naming.plain(F.col("direction")), naming.plain(F.col("shot_type"))
    named = lambda pose: naming.full_frame(video, pose, head, shot, rank, nobody)
    pose = F.coalesce(F.try_element_at(F.filter("poses", lambda p: F.concat(F.lit("pose_"), p) == F.col("primary_category")), F.lit(1)), F.try_element_at("poses", F.lit(1)))
    angle = F.coalesce(F.try_element_at(F.filter("head_angles", lambda a: F.concat(F.lit("head_angle_"), a) == F.col("primary_category")), F.lit(1)), F.try_element_at("head_angles", F.lit(1)))
    whole = F.transform("poses", lambda p: F.struct(F.lit("full_frame").alias("kind"), named(p).alias("name"))) if full_frames or not pose_crops else F.array().cast("array<struct<kind:string,name:string>>")
    some = _kinds(
        ("pose_crop", F.lit(pose_crops) & F.col("has_pose") & (F.size("poses") > 0), naming.crop_suffixed(named(pose))),
        ("face_crop", F.lit(face_crops) & F.col("has_face") & (F.size("head_angles") > 0), naming.face_crop(video, angle, rank, nobody)),
    )
    return selected.select("video_id", "frame_id", F.posexplode(F.concat(whole, some)).alias("seq", "o")).select("video_id", "frame_id", "seq", "o.kind", "o.name")


def person_outputs(picked: DataFrame, full_frames: bool = True, pose_crops: bool = True, face_crops: bool = True) -> DataFrame:
    """A row for each file of a selected person. picked: video_id, frame_id, person_id, has_face, has_body, pose, direction, yaw, shot_type."""
    video, rank = F.concat(F.lit("video_"), F.col("video_id").cast("string")), F.lit(1)
    guess = F.when(F.abs("yaw") <= 30, "front").when(F.col("yaw") > 30, "profile-right").when(F.col("yaw") < -30, "profile-left").otherwise("unknown")
    head = F.when(F.col("direction").isNotNull(), naming.plain(F.col("direction"))).otherwise(guess)
    pose = F.when(F.col("has_body"), F.coalesce("pose", F.lit("unknown"))).otherwise("unknown")
    named = naming.full_frame(video, pose, head, naming.plain(F.col("shot_type")), rank, F.col("person_id"))
    files = _kinds(
        ("face_crop", F.lit(face_crops) & F.col("has_face"), naming.face_crop(video, head, rank, F.col("person_id"))),
        ("body_crop", F.lit(pose_crops) & F.col("has_body"), naming.crop_suffixed(named)),
        ("full_frame", F.lit(full_frames or not pose_crops), named),
    )
    return picked.select("video_id", "frame_id", "person_id", F.posexplode(files).alias("seq", "o")).select("video_id", "frame_id", "person_id", "seq", "o.kind", "o.name")


def expected_count(picked: DataFrame, full_frames: bool = True, pose_crops: bool = True, face_crops: bool = True) -> DataFrame:
    each = int(face_crops) + int(pose_crops) + int(full_frames or not pose_crops)
    return picked.groupBy("video_id").agg((F.count("*") * each).alias("expected_files"))
