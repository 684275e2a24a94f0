"""Queries of sampling and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import geometry, poses
from framesift.operators import rasters, sampling, validate
from framesift.plans.registry import add
from framesift.plans.shared import as_map, landmarks, landmarks_sql

KEY = "select p.video_id, cast(trunc(pts * fps) as bigint) as frame_number, pts as t_sec, 'i_frame' as method, 1e0 as confidence from v_probe p join v_videos v using (video_id) where pict_type = 'I' and pts <= duration"
TEMP = "select video_id, cast(trunc(i * 25e-2 * fps) as bigint) as frame_number, i * 25e-2 as t_sec, 'temporal_sampling' as method, 8e-1 as confidence from (select *, unnest(range(0, cast(ceil(duration / 25e-2) as bigint))) as i from v_videos) where i * 25e-2 < duration and trunc(i * 25e-2 * fps) < total_frames"
MERGED = f"k as ({KEY}), t as ({TEMP}), u as (select *, 0 as p from k union all select *, 1 as p from t), m as (select video_id, frame_number, t_sec, method, confidence from u qualify row_number() over (partition by video_id, frame_number order by p, t_sec) = 1)"


def merged(probe, videos, existing=None, most=None):
    return sampling.listed(sampling.candidate_lists(probe, videos, existing), most=most)


add("sample_keyframes", "v_probe v_videos", sampling.keyframes, KEY)
add("sample_temporal", "v_videos", sampling.temporal, TEMP)
add("candidate_union_dedup", "v_probe v_videos", lambda p, v: merged(p, v, most=200), f"with {MERGED} select * from m qualify row_number() over (partition by video_id order by t_sec, frame_number) <= 200")
add(
    "candidate_anti_existing", "v_probe v_videos",
    lambda p, v: merged(p, v, existing=p.where("pict_type = 'B'").join(v, "video_id").select("video_id", (F.col("pts") * F.col("fps")).cast("int").alias("frame_number"))),
    f"with {MERGED}, e as (select video_id, cast(trunc(pts * fps) as bigint) as frame_number from v_probe join v_videos using (video_id) where pict_type = 'B') select * from m where not exists (select 1 from e where e.video_id = m.video_id and e.frame_number = m.frame_number)",
)


def _frames(r):
    """Frames of different sizes: each raster, a later copy of it, and one stretched to twice its width."""
    px = rasters.as_bytes(F.col("px"))
    wide = rasters.as_bytes(F.flatten(F.transform("px", lambda p: F.array(p, p))))
    each = r.select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_seq"), px.alias("px"), "width", "height")
    stretched = r.select(F.col("label").alias("video_id"), (F.col("vec_id") + 200000).alias("frame_seq"), wide.alias("px"), (F.col("width") * 2).alias("width"), "height")
    return each.unionByName(each.withColumn("frame_seq", F.col("frame_seq") + 100000)).unionByName(stretched)


#: Rows and columns of the 8x8 raster that a pixel of the 16x16 frame lies between, and its share of the second, in quarters.
_LOW, _HIGH, _SHARE = "greatest(0, ({0} + 1) // 2 - 1)", "least(7, ({0} + 1) // 2)", "case when {0} % 2 = 0 then 3 else 1 end"
_ROWS = [x.format("(i // 16)") for x in (_LOW, _HIGH, _SHARE)]
_COLS = [f"case when w = 16 then {stretched} else {x.format('(i % 16)')} end" for x, stretched in ((_LOW, "(i % 16) // 2"), (_HIGH, "(i % 16) // 2"), (_SHARE, "0"))]
_ROW = lambda y: f"((4 - ({_COLS[2]})) * px[8 * ({y}) + ({_COLS[0]}) + 1] + ({_COLS[2]}) * px[8 * ({y}) + ({_COLS[1]}) + 1])"
add(
    "fingerprint_dedup", "v_raster", lambda r: rasters.distinct_frames(_frames(r), "video_id", "frame_seq"),
    f"""with f as (select label, vec_id as s, px, 8 as w from v_raster union all select label, vec_id + 100000, px, 8 from v_raster union all select label, vec_id + 200000, px, 16 from v_raster),
    h as (select label, s, list_transform(range(0, 256), lambda i: ((4 - ({_ROWS[2]})) * {_ROW(_ROWS[0])} + ({_ROWS[2]}) * {_ROW(_ROWS[1])} + 8) // 16) as small from f)
    select cast(label as bigint) as video_id, md5(unhex(array_to_string(list_transform(small, lambda v: printf('%02x', v)), ''))) as fingerprint, cast(min(s) as bigint) as frame_seq, count(*) as copies from h group by 1, 2""",
)
add("fingerprint_dedup_text", "documents", lambda d: sampling.first_per_fingerprint(d, "lang", "doc_id", F.md5("text")), "select lang, md5(text) as fingerprint, min(doc_id) as doc_id, count(*) as copies from documents group by all")
add(
    "fingerprint_dedup_raster", "v_raster", lambda r: sampling.first_per_fingerprint(r, "label", "vec_id", sampling.raster_fingerprint(F.transform("px", lambda p: F.floor(p / 32)))),
    "select cast(label as bigint) as label, md5(array_to_string(list_transform(px[1:4], lambda p: cast(floor(p / 32) as bigint)), ',')) as fingerprint, min(vec_id) as vec_id, count(*) as copies from v_raster group by all",
)
add(
    "extraction_stats", "v_probe v_videos", lambda p, v: sampling.extraction_stats(sampling.candidate_lists(p, v), v),
    f"""with {MERGED}, f as (select video_id, count(*) as n from u group by 1), g as (select video_id, count(*) as n from m group by 1)
    select v.video_id, coalesce(f.n, 0) as considered, coalesce(f.n, 0) - coalesce(g.n, 0) as duplicates_removed, coalesce(g.n, 0) as extracted,
    round(coalesce(g.n, 0) * 25e-2 / duration * 100, 6) as coverage_pct, round(coalesce(duration / g.n, 0), 6) as mean_interval from v_videos v left join f using (video_id) left join g using (video_id)""",
)
add(
    "processing_estimate", "v_videos", sampling.processing_estimate,
    """with e as (select video_id, total_frames / 1e2 as frame_extraction_s, total_frames / 1e1 as face_detection_s, total_frames / 5e0 as pose_analysis_s, total_frames / 2e1 as quality_assessment_s from v_videos)
    select video_id, round(frame_extraction_s, 6) as frame_extraction_s, round(face_detection_s, 6) as face_detection_s, round(pose_analysis_s, 6) as pose_analysis_s, round(quality_assessment_s, 6) as quality_assessment_s, round(frame_extraction_s + face_detection_s + pose_analysis_s + quality_assessment_s, 6) as total_s from e""",
)


def _odd_videos(v):
    """Videos with a few faults, by id."""
    i = F.col("video_id")
    return v.select(
        "video_id", F.when(i % 7 == 0, 0.05).otherwise(F.col("duration")).alias("duration"), F.when(i % 11 == 0, 300.0).otherwise(F.col("fps")).alias("fps"), F.when(i % 13 == 0, 90).otherwise(F.col("width")).alias("width"), "height",
        (i * 100).alias("file_size_bytes"), F.when(i % 5 == 0, "ogv").otherwise("mp4").alias("format"), F.when(i % 3 == 0, "prores").otherwise("h264").alias("codec"),
    )


add(
    "validate_video", "v_videos", lambda v: validate.video_problems(_odd_videos(v)).select("video_id", "rejects", "warnings", "valid"),
    """with o as (select video_id as i, array_to_string([x for x in [case when video_id % 7 = 0 then 'too_short' end, case when video_id % 11 = 0 then 'bad_frame_rate' end, case when video_id % 13 = 0 then 'too_small' end, case when video_id * 100 < 1024 then 'file_too_small' end] if x is not null], ',') as rejects,
    array_to_string([x for x in [case when video_id % 5 = 0 then 'unknown_format' end, case when video_id % 3 = 0 then 'unknown_codec' end] if x is not null], ',') as warnings from v_videos) select i as video_id, rejects, warnings, rejects = '' as valid from o""",
)
IDS = "video_id, frame_id, kind, cast(idx as bigint) as idx"
BOX = "cast(x1 as bigint) as x1, cast(y1 as bigint) as y1, cast(x2 as bigint) as x2, cast(y2 as bigint) as y2"
SHIFT = lambda d: d.withColumns({"x1": F.col("x1") - 100.5, "x2": F.col("x2") + 0.25, "y1": F.col("y1") - 60.5})
add(
    "clamp_detection_bbox", "v_detections", lambda d: validate.clamp_boxes(SHIFT(d), 0.4).select("video_id", "frame_id", "kind", "idx", *geometry.BOX, "conf"),
    f"""with s as (select video_id, frame_id, kind, idx, greatest(0, least(1920, cast(trunc(x1 - 1005e-1) as bigint))) as x1, greatest(0, least(1080, cast(trunc(y1 - 605e-1) as bigint))) as y1, greatest(0, least(1920, cast(trunc(x2 + 25e-2) as bigint))) as x2, greatest(0, least(1080, cast(y2 as bigint))) as y2, round(conf, 6) as conf from v_detections where conf >= 4e-1)
    select {IDS}, {BOX}, conf from s where x2 > x1 and y2 > y1""",
)
FACES = "f as (select *, " + landmarks_sql() + " from v_detections where kind = 'face')"
CLEAR = "y2 < height - 10 and x1 > 10 and x2 < width - 10 and y1 > 10"
SEEN = "(my <= ey or (my + (my - ey) * 14e-1 + 15 < height and (lx + rx) / 2 - abs(rx - lx) * 14e-1 / 2 > 10 and (lx + rx) / 2 + abs(rx - lx) * 14e-1 / 2 < width - 10))"
add(
    "filter_face_complete", "v_detections", lambda d: landmarks(d.where("kind = 'face'")).where(validate.face_complete(geometry.box(), F.col("landmarks"), F.col("width"), F.col("height"))).select("video_id", "frame_id", "idx"),
    f"with {FACES} select video_id, frame_id, cast(idx as bigint) as idx from f where {CLEAR} and {SEEN}",
)
add(
    "filter_face_valid", "v_detections", lambda d: landmarks(d.where("kind = 'face'")).where(validate.face_valid(geometry.box(), F.col("conf"), F.col("landmarks"), F.col("width"), F.col("height"))).select("video_id", "frame_id", "idx", "conf"),
    f"with {FACES} select video_id, frame_id, cast(idx as bigint) as idx, round(conf, 6) as conf from f where {CLEAR} and {SEEN} and x2 - x1 >= 30 and y2 - y1 >= 30 and conf >= 3e-1",
)


def _with_heads(d, h):
    """Each face takes the head pose of vector (frame + index) modulo the number of vectors; every ninth has none."""
    faces = d.where("kind = 'face'").withColumn("vec_id", (F.col("frame_id") + F.col("idx")) % max(1, h.count()))
    heads = faces.join(h.select("vec_id", "yaw", "pitch", "roll"), "vec_id").where(F.col("frame_id") % 9 != 0).select("video_id", "frame_id", "idx", "yaw", "pitch", "roll")
    return faces, heads


add(
    "filter_forward_facing", "v_detections v_headpose", lambda d, h: validate.forward_facing_faces(*_with_heads(d, h)).select("video_id", "frame_id", "idx"),
    """select d.video_id, d.frame_id, cast(d.idx as bigint) as idx from v_detections d cross join (select count(*) as n from v_headpose) c left join v_headpose h on h.vec_id = (d.frame_id + d.idx) % c.n and d.frame_id % 9 <> 0
    where kind = 'face' and least(width, x2 + 10) - greatest(0, x1 - 10) >= 30 and least(height, y2 + 10) - greatest(0, y1 - 10) >= 30 and coalesce(abs(yaw) <= 45 and abs(pitch) <= 30 and abs(roll) <= 30, true)""",
)
add(
    "normalize_keypoints", "v_keypoints",
    lambda k: as_map(k.withColumn("x", F.col("x") * 2 - 900).withColumn("conf", F.col("conf") * 1.2 - 0.1)).select("vec_id", F.explode(poses.normalize(F.col("keypoints"), F.lit(1000), F.lit(900))).alias("kp", "p")).select("vec_id", "kp", "p.*"),
    """with s as (select vec_id, kp, x * 2 - 900 as x, y, greatest(0, least(1, conf * 12e-1 - 1e-1)) as conf from v_keypoints), o as (select *, x < 0 or x > 1000 or y < 0 or y > 900 as o from s)
    select vec_id, kp, round(greatest(0, least(1000, x)), 6) as x, round(greatest(0, least(900, y)), 6) as y, round(case when o then conf * 5e-1 else conf end, 6) as conf from o""",
)
add(
    "filter_pose_valid", "v_keypoints",
    lambda k: as_map(k.withColumn("conf", F.when(F.col("vec_id") % 3 == 0, F.col("conf") - 0.6).otherwise(F.col("conf")))).where(validate.pose_valid([F.col(c) for c in geometry.BOX], F.col("conf"), F.col("keypoints"), F.lit(1920), F.lit(1080))).select("vec_id"),
    """with k as (select vec_id, x, y, case when vec_id % 3 = 0 then conf - 6e-1 else conf end as conf from v_keypoints), b as (select vec_id, trunc(min(x)) as x1, trunc(min(y)) as y1, trunc(max(x)) as x2, trunc(max(y)) as y2, max(conf) as conf, count(*) filter (conf > 5e-1) as n from k group by 1)
    select vec_id from b where x1 >= 0 and y1 >= 0 and x2 <= 1920 and y2 <= 1080 and x2 - x1 >= 50 and y2 - y1 >= 50 and conf >= 3e-1 and n >= 3""",
)
add(
    "pose_keypoint_confidence", "v_keypoints", lambda k: as_map(k).select("vec_id", poses.keypoint_confidence(F.col("keypoints")).alias("confidence")),
    """with r as (select vec_id, conf, row_number() over (partition by vec_id order by conf desc) as r, count(*) over (partition by vec_id) as n from v_keypoints where conf > 1e-1)
    select vec_id, round(sum(conf / r) / sum(1e0 / r), 6) as confidence from r where r <= greatest(1, floor(n * 7e-1)) group by 1""",
)
add(
    "clean_bbox", "v_detections",
    lambda d: d.withColumn("x1", F.col("x1") - 300).withColumn("y2", F.col("y2") - 400).withColumn("ok", geometry.is_valid(geometry.box(), F.col("width"), F.col("height"))).withColumns(dict(zip(("cx1", "cy1", "cx2", "cy2"), geometry.cleaned(geometry.box(), F.col("width"), F.col("height"))))).select("video_id", "frame_id", "kind", "idx", "ok", "cx1", "cy1", "cx2", "cy2"),
    """with s as (select * replace (x1 - 300 as x1, y2 - 400 as y2) from v_detections), o as (select *, x2 > x1 and y2 > y1 and x1 >= 0 and y1 >= 0 and x2 <= width and y2 <= height as ok, greatest(0, least(least(x1, x2), width - 1)) as l, greatest(0, least(least(y1, y2), height - 1)) as t from s)
    select video_id, frame_id, kind, cast(idx as bigint) as idx, ok, cast(l as bigint) as cx1, cast(t as bigint) as cy1, cast(greatest(l + 1, least(greatest(x1, x2), width)) as bigint) as cx2, cast(greatest(t + 1, least(greatest(y1, y2), height)) as bigint) as cy2 from o""",
)
