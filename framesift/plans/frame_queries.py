"""Queries of frame selection, on moments with a gap of six hours and five picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions.angles import DIRECTIONS
from framesift.operators import select_core, select_frames
from framesift.plans.registry import add

GAP, K = 21600.0, 5
V = "v_candidates"
SCORE = "greatest(0e0, least(1e0, quality * 7e-1 + conf * 3e-1))"


def greedy_sql(source: str, keys: str, score: str, k: str = "5", gap: str = "21600", seq: str = "frame_seq", ts: str = "t_sec", tag: str = "", extra: str = "frame_id, quality") -> str:
    """CTEs ending in g<tag>: rows of `source` with outcome and pick, by a walk over each group in order."""
    return f"""n{tag} as (select *, row_number() over (partition by {keys} order by {score} desc, {seq}) as rn from {source}),
 l{tag} as (select {keys}, list({{'i': rn, 't': {ts}, 'k': {k}}} order by rn) as rs from n{tag} group by all),
 d{tag} as (select {keys}, list_reduce(list_concat([[{{'i': cast(0 as bigint), 't': cast(0 as double), 'k': cast(0 as int)}}]], list_transform(rs, lambda x: [{{'i': x.i, 't': cast(x.t as double), 'k': cast(x.k as int)}}])), lambda a, x: case when len(a) - 1 < x[1].k and len([p for p in a if p.i > 0 and abs(p.t - x[1].t) < {gap}]) = 0 then list_concat(a, x) else a end) as ps from l{tag}),
 e{tag} as (select n{tag}.*, [p for p in ps if p.i > 0 and p.i < rn] as bf, [p.i for p in ps if p.i = rn] as me, {k} as kk from n{tag} join d{tag} using ({keys})),
 g{tag} as (select * exclude (bf, me, kk), case when len(me) > 0 then 'selected' when len(bf) < kk and len([p for p in bf if abs(p.t - {ts}) < {gap}]) > 0 then 'rejected_insufficient_diversity' else 'not_top_ranked' end as outcome, case when len(me) > 0 then len(bf) + 1 end as pick from e{tag})"""


def frames(v):
    """Usable unless k is a multiple of 17; a face unless a multiple of 19; a face ratio from k."""
    return v.select(
        "video_id", "frame_id", "frame_seq", "t_sec", F.when(F.col("k") % 23 != 0, F.col("quality")).alias("quality"), (F.col("k") % 17 != 0).alias("usable"), (F.col("k") % 19 != 0).alias("has_face"),
        F.col("conf").alias("pose_conf"), "direction", (F.col("k") % 10 / 20.0).alias("face_ratio"), F.col("conf").alias("head_conf"), "pose_label", "k",
    )


def labels(v):
    return v.where("pose_label is not null").select("video_id", "frame_id", F.col("pose_label").alias("label"))


def closeup_frames(v):
    return v.where("k % 5 = 0").select("video_id", "frame_id")


FRAMES = "fr as (select video_id, frame_id, frame_seq, t_sec, case when k % 23 <> 0 then quality end as quality, k % 17 <> 0 as usable, k % 19 <> 0 as has_face, conf, direction, k % 10 / 2e1 as face_ratio, pose_label, k from v_candidates)"
REASON = "case when not has_face then 'no_faces' when quality is null then 'no_quality' when quality < 2e-1 then 'low_quality' when not usable then 'not_usable' end"
GOOD = f"{FRAMES}, ok as (select * from fr where {REASON} is null)"
GROUPS = "gr as (select video_id, frame_id, pose_label as category from v_candidates where pose_label is not null union select video_id, frame_id, 'closeup' from v_candidates where k % 5 = 0)"
POSED = f"{GOOD}, {GROUPS}, po as (select ok.*, category, greatest(0e0, least(1e0, quality * 7e-1 + conf * (1 - 7e-1))) as score from gr join ok using (video_id, frame_id))"
HEAD_SCORE = "greatest(0e0, least(1e0, quality * 7e-1 + greatest(0e0, least(1e0, (face_ratio - 5e-2) / 45e-2)) * 3e-1 + conf * (1e0 - 7e-1 - 3e-1)))"
PLACE = "case category " + " ".join(f"when '{d}' then {i}" for i, d in enumerate(DIRECTIONS, 1)) + " end"
HEADED = f"he as (select *, direction as category, {HEAD_SCORE} as score from ok where direction in ({', '.join(repr(d) for d in DIRECTIONS)}))"
usable = lambda v: frames(v).where(select_frames.rejection(F.col("has_face"), F.col("quality"), F.col("usable")).isNull())


def posed(v):
    return select_frames.pose_groups(labels(v), closeup_frames(v)).join(usable(v), ["video_id", "frame_id"]).withColumn("score", select_frames.pose_score(F.col("quality"), F.col("pose_conf")))


def headed(v):
    return usable(v).where(F.col("direction").isin(*DIRECTIONS)).withColumn("category", F.col("direction")).withColumn("score", select_frames.head_score(F.col("quality"), F.col("face_ratio"), F.col("head_conf")))


add(
    "select_usable_filter", V, lambda v: frames(v).select("video_id", "frame_id", select_frames.rejection(F.col("has_face"), F.col("quality"), F.col("usable")).alias("rejection_reason")),
    f"with {FRAMES} select video_id, frame_id, {REASON} as rejection_reason from fr",
)
add("group_by_pose", V, lambda v: select_frames.pose_groups(labels(v), closeup_frames(v)), f"with {GROUPS} select * from gr")
add("group_by_head_angle", V, select_frames.head_groups, f"select distinct video_id, frame_id, direction as category from v_candidates where direction in ({', '.join(repr(d) for d in DIRECTIONS)})")
add("score_pose", V, lambda v: frames(v).select("video_id", "frame_id", select_frames.pose_score(F.col("quality"), F.col("pose_conf")).alias("score")), f"with {FRAMES} select video_id, frame_id, round(case when quality is null then 0 else greatest(0e0, least(1e0, quality * 7e-1 + conf * 3e-1)) end, 6) as score from fr")
add(
    "score_head_angle", V, lambda v: frames(v).select("video_id", "frame_id", select_frames.head_score(F.col("quality"), F.col("face_ratio"), F.col("head_conf")).alias("score"), select_frames.face_size_score(F.col("face_ratio")).alias("face_size")),
    f"with {FRAMES} select video_id, frame_id, round(case when quality is null then 0 else {HEAD_SCORE} end, 6) as score, round(greatest(0e0, least(1e0, (face_ratio - 5e-2) / 45e-2)), 6) as face_size from fr",
)
add(
    "rank_in_category", V, lambda v: select_frames.in_category(posed(v)).select("video_id", "category", "frame_id", "score", "rank"),
    f"with {POSED} select video_id, category, frame_id, round(score, 6) as score, row_number() over (partition by video_id, category order by score desc, frame_seq) as rank from po",
)
plain = lambda v: v.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality") * 0.7 + F.col("conf") * 0.3)))
GREEDY = f"with s as (select *, {SCORE} as score from v_candidates), {greedy_sql('s', 'video_id', 'score')} select video_id, frame_id, round(score, 6) as score, outcome, cast(pick as bigint) as pick from g"


def _topk(how):
    return lambda v: how(plain(v)).select("video_id", "frame_id", "score", "outcome", "pick")


add("select_diverse_topk", V, _topk(lambda v: select_core.diverse_topk(v, ["video_id"], "score", "t_sec", "frame_seq", K, GAP)), GREEDY)
add("select_diverse_topk_rounds", V, _topk(lambda v: select_core.rounds(v, ["video_id"], "score", "t_sec", "frame_seq", F.lit(K), GAP)), GREEDY)


def claimed(v):
    return select_frames.claim(posed(v), K, GAP)


def _claim_sql() -> str:
    """Four passes, each without what the ones before selected."""
    out = [POSED, """fs as (select video_id, category, min({'s': frame_seq, 'p': case category when 'standing' then 0 when 'sitting' then 1 when 'squatting' then 2 else 3 end}) as f from po group by all),
 pl as (select video_id, category, row_number() over (partition by video_id order by f) as place from fs), pp as (select po.*, place from po join pl using (video_id, category))"""]
    for i in range(1, 5):
        before = " union ".join(f"select video_id, frame_id from g{j} where outcome = 'selected'" for j in range(1, i)) or "select video_id, frame_id from pp where false"
        out.append(f"t{i} as ({before}), s{i} as (select pp.* from pp anti join t{i} using (video_id, frame_id) where place = {i}), " + greedy_sql(f"s{i}", "video_id, category", "score", tag=str(i)))
        out.append(f"c{i} as (select * exclude (rn) from g{i} union all by name select pp.*, 'lost_to_higher_priority' as outcome, null as pick from pp semi join t{i} using (video_id, frame_id) where place = {i})")
    out.append("cl as (" + " union all by name ".join(f"select * from c{i}" for i in range(1, 5)) + ")")
    return ", ".join(out)


CLAIM = _claim_sql()
add(
    "claim_by_priority", V, lambda v: claimed(v).select("video_id", "category", "frame_id", "place", "score", "outcome", "pick"),
    f"with {CLAIM} select video_id, category, frame_id, place, round(score, 6) as score, outcome, cast(pick as bigint) as pick from cl",
)
add(
    "competition_audit", V, lambda v: select_frames.first_reason(claimed(v)),
    f"""with {CLAIM}, w as (select *, case outcome when 'rejected_insufficient_diversity' then 'insufficient_diversity' when 'not_top_ranked' then 'not_top_ranked' end as reason from cl)
    select video_id, frame_id, (list(reason order by place) filter (reason is not null))[1] as rejection_reason from w group by all""",
)


def heads(v):
    places = F.create_map(*[x for i, c in enumerate(DIRECTIONS, 1) for x in (F.lit(c), F.lit(i))])
    return select_core.diverse_topk(headed(v).withColumn("place", F.try_element_at(places, "category")), ["video_id", "category"], "score", "t_sec", "frame_seq", K, GAP)


HEADS = f"{CLAIM}, {HEADED}, " + greedy_sql("he", "video_id, category", "score", tag="h") + f", hs as (select *, {PLACE} as place from gh)"
BOTH = f"{HEADS}, se as (select video_id, frame_id, 'pose' as kind, category, place, score, pick from cl where outcome = 'selected' union all select video_id, frame_id, 'head_angle', category, place + 100, score, pick from hs where outcome = 'selected')"
add(
    "selection_metadata", V, lambda v: select_frames.metadata(claimed(v), heads(v)),
    f"""with {BOTH} select video_id, frame_id, coalesce(string_agg(category, ',' order by place) filter (kind = 'pose'), '') as poses, coalesce(string_agg(category, ',' order by place) filter (kind = 'head_angle'), '') as head_angles,
    max_by(kind || '_' || category, place) as primary_category, round(max_by(score, place), 6) as final_score, cast(coalesce(min_by(pick, place) filter (kind = 'pose'), max_by(pick, place)) as bigint) as selection_rank from se group by all""",
)
add(
    "category_summary", V, lambda v: select_frames.category_summary(claimed(v), "pose").withColumn("sum_quality", F.col("avg_quality") * F.col("candidates")).drop("avg_quality"),
    f"""with {CLAIM}, s as (select video_id, category, count(*) as candidates, count(*) filter (outcome = 'selected') as selected, min(quality) as lo, max(quality) as hi, avg(quality) as mean from cl group by all)
    select video_id, category, candidates, selected, round(lo, 6) as min_quality, round(hi, 6) as max_quality, round(mean * candidates, 6) as sum_quality,
    'Selected ' || selected || ' of ' || candidates || ' candidate frames for pose category ''' || category || '''.' || case when selected > 0 then ' Quality range: ' || format('{{:.2f}}', lo) || ' - ' || format('{{:.2f}}', hi) || ' (average: ' || format('{{:.2f}}', mean) || '). Selection prioritized overall frame and pose quality.' || case when selected < candidates then ' Diversity filtering applied to avoid similar frames.' else '' end else '' end as rationale from s""".replace("{{", "{").replace("}}", "}"),
)
add(
    "selection_summary", V, lambda v: select_frames.selection_summary(usable(v), claimed(v).select("video_id", "frame_id", "outcome").unionByName(heads(v).select("video_id", "frame_id", "outcome"))),
    f"with {BOTH}, n as (select video_id, count(*) as usable_frames from ok group by 1), d as (select video_id, count(distinct frame_id) as n from se group by 1) select video_id, usable_frames, coalesce(n, 0) as selected_frames from n left join d using (video_id)",
)
add("dynamic_quota", "v_videos", lambda v: v.select("video_id", select_frames.quota(F.col("duration"), 3, 10).alias("quota")), "select video_id, cast(least(3 + greatest(0, floor((duration - 30) / 10)), 10) as bigint) as quota from v_videos")
add(
    "rank_by_quality", V, lambda v: select_frames.by_quality(frames(v)).select("video_id", "frame_id", "rank"),
    f"with {FRAMES} select video_id, frame_id, row_number() over (partition by video_id order by coalesce(quality, 0) desc, frame_seq) as rank from fr",
)


def _whole(v):
    poses, head = select_frames.select_frames(frames(v), labels(v), closeup_frames(v), K, GAP)
    cols = ["video_id", "frame_id", "category", "score", "outcome", "pick"]
    return poses.select(F.lit("pose").alias("kind"), *cols).unionByName(head.select(F.lit("head_angle").alias("kind"), *cols))


add(
    "select_frames", V, _whole,
    f"with {HEADS} select 'pose' as kind, video_id, frame_id, category, round(score, 6) as score, outcome, cast(pick as bigint) as pick from cl union all select 'head_angle', video_id, frame_id, category, round(score, 6), outcome, cast(pick as bigint) from hs",
)
