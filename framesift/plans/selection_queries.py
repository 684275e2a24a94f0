"""Queries of person selection, crops, names and output plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framesift.functions import geometry, naming
from framesift.operators import crops, jobs, rasters, select_persons
from framesift.plans.frame_queries import GAP, greedy_sql
from framesift.plans.registry import add

V = "v_candidates"
PERSON = "video_id, person_id"


def rows(v):
    return v.select("video_id", F.col("position_id").alias("person_id"), "frame_id", "frame_seq", "t_sec", "quality", F.col("pose_label").alias("pose"), F.when(F.col("k") % 4 != 0, F.col("direction")).alias("direction"))


def good(v):
    return select_persons.candidates(rows(v))


ROWS = "ro as (select video_id, position_id as person_id, frame_id, frame_seq, t_sec, quality, pose_label as pose, case when k % 4 <> 0 then direction end as direction from v_candidates where quality >= 3e-1)"
BEST = f"""{ROWS}, be as (select {PERSON}, 'pose_' || pose as category, frame_id, frame_seq, t_sec, quality from ro where pose is not null qualify row_number() over (partition by {PERSON}, pose order by quality desc, frame_seq) = 1
 union all select {PERSON}, 'head_angle_' || direction, frame_id, frame_seq, t_sec, quality from ro where direction is not null qualify row_number() over (partition by {PERSON}, direction order by quality desc, frame_seq) = 1)"""
COMBINED = f"{BEST}, co as (select {PERSON}, frame_id, string_agg(category, ' + ' order by category) as category, max(quality) as score, min(frame_seq) as frame_seq, min(t_sec) as t_sec from be group by {PERSON}, frame_id)"
LIMITED = f"{COMBINED}, li as (select * from co qualify row_number() over (partition by {PERSON} order by score desc, frame_seq) <= 4)"
#: With a limit of 4 nothing needs filling up; `few` keeps one pick for every second person.
FEW = f"{LIMITED}, fw as (select * from li qualify row_number() over (partition by {PERSON} order by score desc, frame_seq) <= 1 + (video_id + person_id) % 2 * 3), nf as (select {PERSON}, count(*) as n from fw group by all), fr as (select ro.*, 3 - coalesce(n, 0) as need from ro anti join fw using ({PERSON}, frame_id) left join nf using ({PERSON}) where 3 - coalesce(n, 0) > 0)"
FILLED = f"{FEW}, {greedy_sql('fr', PERSON, 'quality', k='need')}, fi as (select {PERSON}, frame_id, 'minimum' as category, quality as score, frame_seq, t_sec from g where outcome = 'selected')"
OUT = "video_id, cast(person_id as bigint) as person_id, frame_id, category, round(score, 6) as score"
cols = ["video_id", "person_id", "frame_id", "category", "score"]


def combined(v):
    return select_persons.combine(select_persons.best_per_category(good(v)))


def few(v):
    limited = select_persons.limit_per_person(combined(v), 4)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("video_id", "person_id").orderBy(F.desc("score"), "frame_seq"))
    return limited.withColumn("_n", rank).where(F.col("_n") <= 1 + (F.col("video_id") + F.col("person_id")) % 2 * 3).drop("_n")


add("person_candidates", V, lambda v: good(v).select("video_id", "person_id", "frame_id", "quality"), f"with {ROWS} select video_id, cast(person_id as bigint) as person_id, frame_id, round(quality, 6) as quality from ro")


def _labels(v):
    one = lambda label, conf: F.struct(F.lit(label).alias("label"), conf.alias("conf"))
    many = F.array(one("standing", F.col("k") % 7 / 10.0), one("sitting", F.col("k") % 5 / 10.0), one("closeup", F.col("k") % 3 / 10.0))
    return v.select("frame_id", select_persons.primary_label(F.when(F.col("k") % 9 == 0, F.array().cast("array<struct<label:string,conf:double>>")).otherwise(many)).alias("pose"))


add("primary_pose", V, _labels, "select frame_id, case when k % 9 = 0 then null when k % 7 >= k % 5 and k % 7 >= k % 3 then 'standing' when k % 5 >= k % 3 then 'sitting' else 'closeup' end as pose from v_candidates")
add("select_best_per_category", V, lambda v: select_persons.best_per_category(good(v)).select("video_id", "person_id", "category", "frame_id", "quality"), f"with {BEST} select video_id, cast(person_id as bigint) as person_id, category, frame_id, round(quality, 6) as quality from be")
add("combine_duplicate_picks", V, lambda v: combined(v).select(*cols), f"with {COMBINED} select {OUT} from co")
add("limit_per_person", V, lambda v: select_persons.limit_per_person(combined(v), 4).select(*cols), f"with {LIMITED} select {OUT} from li")
add("fill_to_minimum", V, lambda v: select_persons.fill(good(v), few(v), 3, GAP).select(*cols), f"with {FILLED} select {OUT} from fi")
add(
    "select_quality_priority", V, lambda v: select_persons.quality_priority(good(v), 3, 6, GAP).select(*cols),
    f"with {ROWS}, {greedy_sql('ro', PERSON, 'quality', k='6')} select video_id, cast(person_id as bigint) as person_id, frame_id, case when pick <= 3 then 'minimum' else 'additional' end as category, round(quality, 6) as score from g where outcome = 'selected'",
)
add("global_cap", V, lambda v: select_persons.cap_per_video(combined(v), 12).select(*cols), f"with {COMBINED}, r as (select * from co qualify row_number() over (partition by video_id order by score desc, person_id, frame_seq) <= 12) select {OUT} from r")
WHOLE = f"""{COMBINED}, li as (select * from co qualify row_number() over (partition by {PERSON} order by score desc, frame_seq) <= 10), nf as (select {PERSON}, count(*) as n from li group by all), fr as (select ro.*, 3 - coalesce(n, 0) as need from ro anti join li using ({PERSON}, frame_id) left join nf using ({PERSON}) where 3 - coalesce(n, 0) > 0),
 {greedy_sql('fr', PERSON, 'quality', k='need')}, al as (select * from li union all by name select {PERSON}, frame_id, 'minimum' as category, quality as score, frame_seq, t_sec from g where outcome = 'selected'), pi as (select * from al qualify row_number() over (partition by video_id order by score desc, person_id, frame_seq) <= 20)"""
chosen = lambda v: select_persons.select_persons(rows(v), 3, 10, GAP, 20)
add("select_persons", V, lambda v: chosen(v).select(*cols), f"with {WHOLE} select {OUT} from pi")
add(
    "person_selection_summary", V, lambda v: select_persons.summary(chosen(v)).withColumn("sum_score", F.col("avg_score") * F.col("n")).drop("avg_score"),
    f"with {WHOLE} select video_id, cast(person_id as bigint) as person_id, count(*) as n, round(min(score), 6) as min_score, round(max(score), 6) as max_score, round(sum(score), 6) as sum_score, array_to_string(list_sort(list_distinct(list(category))), ',') as categories from pi group by all",
)

DET = "v_detections"
IDS = "video_id, frame_id, kind, cast(idx as bigint) as idx"
ids = ["video_id", "frame_id", "kind", "idx"]
B = lambda names: ", ".join(f"cast({n} as bigint) as {n}" for n in names.split())
RATIO = "case when k % 6 = 0 then '16:9' when k % 6 = 1 then ' 4 : 3 ' when k % 6 = 2 then '1:0' when k % 6 = 3 then '1000:1' when k % 6 = 4 then 'any' else k || ':7' end"
add(
    "parse_aspect_ratio", V, lambda v: v.select("frame_id", geometry.aspect_ratio(F.expr(RATIO)).alias("r")).select("frame_id", "r.w", "r.h"),
    f"""with t as (select frame_id, {RATIO} as t from v_candidates), p as (select frame_id, try_cast(regexp_extract(t, '^\\s*([0-9]+)\\s*:\\s*([0-9]+)\\s*$', 1) as bigint) as w, try_cast(regexp_extract(t, '^\\s*([0-9]+)\\s*:\\s*([0-9]+)\\s*$', 2) as bigint) as h from t),
    o as (select *, w > 0 and h > 0 and w * 1e0 / nullif(h, 0) between 1e-1 and 100 as ok from p) select frame_id, case when ok then w end as w, case when ok then h end as h from o""",
)
four = ("px1", "py1", "px2", "py2")
PAD = "greatest(0, x1 - cast(trunc((x2 - x1) * {p}) as bigint)) as px1, greatest(0, y1 - cast(trunc((y2 - y1) * {p}) as bigint)) as py1, least(width, x2 + cast(trunc((x2 - x1) * {p}) as bigint)) as px2, least(height, y2 + cast(trunc((y2 - y1) * {p}) as bigint)) as py2"
pad = lambda share: lambda d: d.select(*ids, *[c.alias(n) for n, c in zip(four, geometry.padded(geometry.box(), share, F.col("width"), F.col("height")))])
add("pad_bbox", DET, pad(0.2), f"with p as (select *, {PAD.format(p='2e-1')} from v_detections) select {IDS}, {B('px1 py1 px2 py2')} from p")
add("pad_bbox_head_pose", DET, pad(0.15), f"with p as (select *, {PAD.format(p='15e-2')} from v_detections) select {IDS}, {B('px1 py1 px2 py2')} from p")
FIT = "{i} as (select *, floor((a1 + a2) / 2e0) - floor(w / 2e0) as cx1, floor((b1 + b2) / 2e0) - floor(h / 2e0) as cy1, floor((a1 + a2) / 2e0) - floor(w / 2e0) + w as cx2, floor((b1 + b2) / 2e0) - floor(h / 2e0) + h as cy2 from (select *, greatest(a2 - a1, cast(trunc((b2 - b1) * ({r})) as bigint)) as w, greatest(b2 - b1, cast(trunc((a2 - a1) / ({r})) as bigint)) as h from {s}))"
add(
    "fit_aspect_ratio", DET, lambda d: d.select(*ids, *[c.alias(n) for n, c in zip(("cx1", "cy1", "cx2", "cy2"), geometry.fitted(geometry.box(), 16, 9))]),
    "with s as (select *, x1 as a1, y1 as b1, x2 as a2, y2 as b2 from v_detections), " + FIT.format(i="f", r="16e0 / 9", s="s") + f" select {IDS}, {B('cx1 cy1 cx2 cy2')} from f",
)
plan = lambda d: crops.crop_plan(d, 0.2, (1, 1))
SCALE = "case when cx2 - cx1 < 640 and cy2 - cy1 < 640 then trunc(({v}) * (64e1 / greatest(cx2 - cx1, cy2 - cy1))) else {v} end"
add(
    "crop_plan", DET, lambda d: plan(d).select(*ids, "cx1", "cy1", "cx2", "cy2", "left", "top", "right", "bottom", "out_width", "out_height", "restore"),
    f"with p as (select *, {PAD.format(p='2e-1')} from v_detections), s as (select *, px1 as a1, py1 as b1, px2 as a2, py2 as b2 from p), " + FIT.format(i="f", r="1e0", s="s") + f""", z as (select {IDS}, {B('cx1 cy1 cx2 cy2')}, width, height from f)
    select video_id, frame_id, kind, idx, cx1, cy1, cx2, cy2, greatest(0, -cx1) as "left", greatest(0, -cy1) as top, greatest(0, cx2 - width) as "right", greatest(0, cy2 - height) as bottom,
    cast({SCALE.format(v='cx2 - cx1')} as bigint) as out_width, cast({SCALE.format(v='cy2 - cy1')} as bigint) as out_height, cx2 - cx1 < 640 and cy2 - cy1 < 640 as restore from z""",
)
add(
    "resize_plan", "v_videos", lambda v: crops.resize_plan(v.withColumn("width", (F.col("duration") * 25).cast("int")), 1280).select("video_id", "out_width", "out_height"),
    "with s as (select video_id, cast(trunc(duration * 25) as bigint) as w, 1080 as h from v_videos) select video_id, cast(case when greatest(w, h) > 1280 then trunc(w * (128e1 / greatest(w, h))) else w end as bigint) as out_width, cast(case when greatest(w, h) > 1280 then trunc(h * (128e1 / greatest(w, h))) else h end as bigint) as out_height from s",
)


def _cut(r):
    plan = r.select("vec_id", F.lit(0).cast("long").alias("box_id"), (F.col("vec_id") % 5 - 2).cast("int").alias("cx1"), F.lit(2).alias("cy1"), (F.col("vec_id") % 5 + 4).cast("int").alias("cx2"), F.lit(10).alias("cy2"))
    return crops.crop_pixels(r, plan, "vec_id").select("vec_id", "width", "height", F.aggregate(rasters.as_values(F.col("px")), F.lit(0), lambda a, x: a + x).alias("sum_px"), F.size(F.filter(rasters.as_values(F.col("alpha")), lambda a: a > 0)).alias("inside"))


add(
    "crop_pixels", "v_raster", _cut,
    "with c as (select vec_id, unnest(px) as p, unnest(range(0, 64)) as i from v_raster) select vec_id, 6 as width, 8 as height, cast(coalesce(sum(p) filter (i % 8 >= vec_id % 5 - 2 and i % 8 < vec_id % 5 + 4 and i // 8 >= 2), 0) as bigint) as sum_px, count(*) filter (i % 8 >= vec_id % 5 - 2 and i % 8 < vec_id % 5 + 4 and i // 8 >= 2) as inside from c group by 1".replace("6 as width, 8 as height", "cast(6 as bigint) as width, cast(8 as bigint) as height"),
)


def named(v):
    """Rows with names; many repeat, as the rank is the position."""
    video = F.concat(F.lit("v"), F.col("video_id").cast("string"))
    return v.withColumn("video", video).withColumn("full_name", naming.full_frame(F.col("video"), F.col("pose_label"), F.col("direction"), F.when(F.col("k") % 3 == 0, "closeup"), F.col("position_id") + 1, F.when(F.col("k") % 2 == 0, F.col("position_id")))).withColumn("face_name", naming.face_crop(F.col("video"), F.col("direction"), F.col("position_id") + 1, F.when(F.col("k") % 2 == 0, F.col("position_id"))))


NAMED = """nm as (select *, 'v' || video_id || case when k % 2 = 0 then '_person_' || position_id else '' end as stem, '_' || lpad(cast(position_id + 1 as varchar), 3, '0') || '.png' as tail from v_candidates),
 nn as (select *, stem || coalesce('_' || pose_label, '') || '_' || direction || case when k % 3 = 0 then '_closeup' else '' end || tail as full_name, stem || '_face_' || direction || tail as face_name from nm)"""
add("output_filename", V, lambda v: named(v).select("frame_id", "full_name", "face_name", naming.crop_suffixed(F.col("full_name")).alias("crop_name")), f"with {NAMED} select frame_id, full_name, face_name, replace(full_name, '.png', '_crop.png') as crop_name from nn")
add(
    "unique_filename", V, lambda v: crops.unique_names(named(v).select("video_id", "frame_id", "frame_seq", F.col("full_name").alias("name")), order="frame_seq").select("frame_id", "unique_name"),
    f"with {NAMED}, u as (select frame_id, full_name, row_number() over (partition by video_id, full_name order by frame_seq) - 1 as n from nn) select frame_id, case when n = 0 then full_name else replace(full_name, '.png', '_' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end || '.png') end as unique_name from u",
)


def numbered(v):
    """Short names, a third of which are numbered already and come first."""
    own = F.col("k") % 3 == 0
    name = F.concat(F.lit("n"), (F.col("frame_id") % 4).cast("string"), F.when(own, F.concat(F.lit("_00"), (1 + F.col("k") % 7).cast("string"))).otherwise(""), F.lit(".png"))
    return v.select("video_id", "frame_id", name.alias("name"), F.when(own, F.col("frame_seq")).otherwise(F.col("frame_seq") + 1000000).alias("seq"))


add(
    "unique_filename_taken", V, lambda v: crops.unique_names(numbered(v)).select("frame_id", "unique_name"),
    """with n as (select video_id, frame_id, 'n' || (frame_id % 4) || case when k % 3 = 0 then '_00' || (1 + k % 7) else '' end as stem, case when k % 3 = 0 then frame_seq else frame_seq + 1000000 end as seq,
        'n' || (frame_id % 4) as base, case when k % 3 = 0 then 1 + k % 7 end as number from v_candidates),
    u as (select *, row_number() over (partition by video_id, stem order by seq) - 1 as use from n),
    t as (select video_id, base as stem, list_distinct(list(number)) as taken from n where number is not null group by 1, 2),
    f as (select u.*, list_filter(range(1, u.use + 8), lambda i: not list_contains(coalesce(taken, []), i))[u.use] as free from u left join t using (video_id, stem))
    select frame_id, stem || case when use = 0 then '' when free < 1000 then '_' || lpad(cast(free as varchar), 3, '0') else '_' || free end || '.png' as unique_name from f""",
)
ODD = "case k % 5 when 0 then 'a/b' when 1 then '. v x ' when 2 then '...' when 3 then 'v' || video_id || '_person_x_1.png' else 'v' || video_id || '_person_3_1.png' end"
add(
    "validate_filename", V, lambda v: v.withColumn("name", F.expr(ODD)).select("frame_id", naming.is_valid(F.col("name"), F.concat(F.lit("v"), F.col("video_id").cast("string"))).alias("valid"), naming.sanitized(F.col("name")).alias("clean")),
    "select frame_id, k % 5 = 4 as valid, case k % 5 when 0 then 'a_b' when 1 then 'v x' when 2 then 'unnamed' when 3 then 'v' || video_id || '_person_x_1.png' else 'v' || video_id || '_person_3_1.png' end as clean from v_candidates",
)


def picked_frames(v):
    return v.where("pose_label is not null").select("video_id", "frame_id", F.array("pose_label", F.lit("closeup")).alias("poses"), F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("direction")).alias("head_angles"), F.concat(F.lit("pose_"), F.when(F.col("k") % 2 == 0, "closeup").otherwise(F.col("pose_label"))).alias("primary_category"), (F.col("position_id") + 1).alias("selection_rank"), "direction", F.lit("Medium Shot").alias("shot_type"), (F.col("k") % 5 != 0).alias("has_face"), (F.col("k") % 7 != 0).alias("has_pose"))


HEAD = "'video_' || video_id || '_'"
TAIL = "'_' || direction || '_medium-shot_' || lpad(cast(position_id + 1 as varchar), 3, '0')"
add(
    "output_plan_frames", V, lambda v: crops.frame_outputs(picked_frames(v)),
    f"""with s as (select * from v_candidates where pose_label is not null), f as (select video_id, frame_id, 0 as o, 'full_frame' as kind, {HEAD} || pose_label || {TAIL} || '.png' as name from s union all select video_id, frame_id, 1, 'full_frame', {HEAD} || 'closeup' || {TAIL} || '.png' from s
    union all select video_id, frame_id, 2, 'pose_crop', {HEAD} || case when k % 2 = 0 then 'closeup' else pose_label end || {TAIL} || '_crop.png' from s where k % 7 <> 0 union all select video_id, frame_id, 3, 'face_crop', {HEAD} || 'face_' || direction || '_' || lpad(cast(position_id + 1 as varchar), 3, '0') || '.png' from s where k % 5 <> 0 and k % 3 <> 0)
    select video_id, frame_id, row_number() over (partition by frame_id order by o) - 1 as seq, kind, name from f""",
)


def picked_persons(v):
    return v.select("video_id", "frame_id", F.col("position_id").alias("person_id"), (F.col("k") % 5 != 0).alias("has_face"), (F.col("k") % 7 != 0).alias("has_body"), F.col("pose_label").alias("pose"), F.when(F.col("k") % 3 != 0, F.col("direction")).alias("direction"), F.when(F.col("k") % 6 != 0, (F.col("k") % 100 - 50).cast("double")).alias("yaw"), F.lit("wide_shot").alias("shot_type"))


P = "'video_' || video_id || '_person_' || position_id || '_'"
PD = "pp as (select *, case when k % 3 <> 0 then direction when k % 6 = 0 then 'unknown' when abs(k % 100 - 50) <= 30 then 'front' when k % 100 - 50 > 30 then 'profile-right' else 'profile-left' end as head, case when k % 7 <> 0 then coalesce(pose_label, 'unknown') else 'unknown' end as pose from v_candidates)"
add(
    "output_plan_persons", V, lambda v: crops.person_outputs(picked_persons(v)),
    f"""with {PD}, f as (select video_id, frame_id, position_id, 0 as o, 'face_crop' as kind, {P} || 'face_' || head || '_001.png' as name from pp where k % 5 <> 0 union all select video_id, frame_id, position_id, 1, 'body_crop', {P} || pose || '_' || head || '_wide_shot_001_crop.png' from pp where k % 7 <> 0
    union all select video_id, frame_id, position_id, 2, 'full_frame', {P} || pose || '_' || head || '_wide_shot_001.png' from pp) select video_id, frame_id, cast(position_id as bigint) as person_id, row_number() over (partition by frame_id order by o) - 1 as seq, kind, name from f""",
)
add("expected_output_count", V, lambda v: crops.expected_count(picked_persons(v)), "select video_id, count(*) * 3 as expected_files from v_candidates group by 1")
add(
    "blend_restore", "v_raster", lambda r: r.select("vec_id", jobs.blend(F.col("px"), F.transform("px", lambda p: 255 - p), 0.25).alias("px")),
    "select vec_id, array_to_string(list_transform(px, lambda p: cast(floor((255 - p) * 25e-2 + p * 75e-2) as bigint)), ',') as px from v_raster",
)


def _stub():
    """A detector for tests: the brightest pixel; it fails on a batch that holds a raster starting with 130 or more."""

    def run(rasters):
        if any(px[0] >= 170 for px in rasters):
            raise ValueError("too bright")
        return [[{"at": int(np.argmax(px)), "conf": int(px.max()) / 255}] for px in rasters]

    return run


def _detected(r):
    found = jobs.apply_detector(r, _stub, "at int, conf double", "vec_id", "px", 1)
    return found.select("vec_id", F.size("found").alias("n"), F.try_element_at("found", F.lit(1))["at"].alias("at"), "error")


add(
    "apply_detector", "v_raster", _detected,
    "select vec_id, case when px[1] >= 170 then 0 else 1 end as n, case when px[1] < 170 then list_position(px, list_max(px)) - 1 end as at, case when px[1] >= 170 then 'ValueError: too bright' end as error from v_raster".replace("then 0 else 1 end as n", "then cast(0 as bigint) else cast(1 as bigint) end as n").replace("- 1 end as at", "- cast(1 as bigint) end as at"),
)
