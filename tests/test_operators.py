"""Exact expectations on small tables, and invariants of the greedy selection."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framesift.functions import angles, geometry, naming
from framesift.operators import associate, crops, quality, ranks, sampling, select_core, select_persons
from framesift.operators.jobs import apply_detector


def picks(spark, items, gap, k, how=select_core.fold):
    rows = spark.createDataFrame([(1, i, float(q), float(t)) for i, (q, t) in enumerate(items)], "g long, i long, q double, t double")
    args = (rows, ["g"], "q", "t", "i", F.lit(k), gap) + ((k,) if how is select_core.rounds else ())
    return {r["i"]: r["outcome"] for r in how(*args).collect()}


@pytest.mark.parametrize("how", [select_core.fold, select_core.rounds])
def test_greedy_keeps_the_gap(spark, how):
    items = [(0.9, 0), (0.8, 2), (0.7, 3), (0.6, 6), (0.5, 12), (0.4, 15), (0.3, 18)]
    out = picks(spark, items, 5.0, 10, how)
    assert [i for i in sorted(out) if out[i] == "selected"] == [0, 3, 4, 6]
    out = picks(spark, [(0.9, 0), (0.8, 2), (0.7, 6), (0.6, 8), (0.5, 12)], 5.0, 5, how)
    assert [i for i in sorted(out) if out[i] == "selected"] == [0, 2, 4]


@pytest.mark.parametrize("how", [select_core.fold, select_core.rounds])
def test_after_the_last_pick_rows_are_not_examined(spark, how):
    out = picks(spark, [(0.9, 0), (0.8, 1), (0.7, 10), (0.6, 11)], 5.0, 2, how)
    assert out == {0: "selected", 1: "rejected_insufficient_diversity", 2: "selected", 3: "not_top_ranked"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 40)), min_size=1, max_size=25), st.integers(1, 5))
def test_greedy_invariants(spark, items, k):
    out = picks(spark, items, 6.0, k)
    chosen = [i for i in out if out[i] == "selected"]
    assert 1 <= len(chosen) <= k
    assert all(abs(items[a][1] - items[b][1]) >= 6 for a in chosen for b in chosen if a < b)
    for i, o in out.items():
        if o == "rejected_insufficient_diversity":
            assert any((-items[c][0], c) < (-items[i][0], i) and abs(items[c][1] - items[i][1]) < 6 for c in chosen)
    assert picks(spark, items, 6.0, k, select_core.rounds) == out


def test_persons_of_a_frame(spark):
    det = [(1, 1, "face", 0, 100, 100, 140, 140, 0.9), (1, 1, "face", 1, 600, 100, 640, 140, 0.8), (1, 1, "body", 0, 550, 50, 700, 400, 0.7), (1, 1, "body", 1, 60, 50, 200, 400, 0.6), (1, 1, "body", 2, 900, 50, 990, 400, 0.5)]
    rows = spark.createDataFrame(det, "video_id long, frame_id long, kind string, idx int, x1 int, y1 int, x2 int, y2 int, conf double")
    found = {r["person_id"]: (r["face_idx"], r["body_idx"], r["method"]) for r in associate.with_person_ids(associate.persons(rows)).collect()}
    assert found == {0: (0, 1, "spatial"), 1: (1, 0, "spatial"), 2: (None, 2, "body_only")}


def test_candidates_prefer_keyframes(spark):
    schema = "video_id long, frame_number int, t_sec double, method string, confidence double"
    key = spark.createDataFrame([(1, 30, 1.0, "i_frame", 1.0), (1, 150, 5.0, "i_frame", 1.0)], schema)
    other = spark.createDataFrame([(1, 7, 0.25, "t", 0.8), (1, 30, 1.0, "t", 0.8), (1, 90, 3.0, "t", 0.8)], schema)
    got = {r["frame_number"]: r["method"] for r in sampling.merge_candidates(key, other).collect()}
    assert got == {7: "t", 30: "i_frame", 90: "t", 150: "i_frame"}
    assert [r["frame_number"] for r in sampling.merge_candidates(key, other, 2).orderBy("t_sec").collect()] == [7, 30]


@pytest.mark.parametrize("yaw,pitch,want", [(22.5, 0, "front"), (22.6, 0, "looking_left"), (-67.5, 0, "profile_right"), (0, 22.6, "looking_up"), (45, -30, "looking_down_left"), (float("nan"), 0, "front"), (67.4, 30, "looking_up_left")])
def test_directions(spark, yaw, pitch, want):
    assert spark.range(1).select(angles.head_direction(F.lit(float(yaw)), F.lit(float(pitch)))).first()[0] == want


def test_boxes(spark):
    one = spark.range(1)
    get = lambda cols: tuple(one.select(*cols).first())
    lit = lambda *v: [F.lit(x) for x in v]
    assert get(geometry.cleaned(lit(50, 30, 10, 10), F.lit(100), F.lit(100))) == (10, 10, 50, 30)
    assert get(geometry.cleaned(lit(-10, -5, 110, 130), F.lit(100), F.lit(100))) == (0, 0, 100, 100)
    x1, y1, x2, y2 = get(geometry.fitted(lit(0, 0, 10, 40), 1, 1))
    assert (x2 - x1, y2 - y1) == (40, 40) and x1 == -15
    assert one.select(geometry.aspect_ratio(F.lit(" 16:9 "))).first()[0] == (16, 9)
    assert one.select(geometry.aspect_ratio(F.lit("0:9"))).first()[0] is None
    assert one.select(naming.sanitized(F.lit(". a/b? "))).first()[0] == "a_b_"


def test_names_repeat(spark):
    rows = spark.createDataFrame([(1, "a.png", 1), (1, "a.png", 2), (1, "b.png", 3), (2, "a.png", 4)], "video_id long, name string, seq long")
    assert [r["unique_name"] for r in crops.unique_names(rows).orderBy("seq").collect()] == ["a.png", "a_001.png", "b.png", "a.png"]


def test_sharp_is_sharper_than_flat():
    sharp = np.indices((16, 16)).sum(0) % 2 * 255
    assert quality.figures(sharp)[0] > quality.figures(np.full((16, 16), 90))[0] == 0


def test_missing_scores_are_zero(spark):
    from framesift.operators.select_frames import head_score, pose_score

    n = F.lit(None).cast("double")
    assert spark.range(1).select(pose_score(n, F.lit(0.9)), head_score(F.lit(1.0), n, n)).first() == (0.0, 0.7)


def test_global_cap(spark):
    rows = spark.createDataFrame([(1, p, f, f, float(f), 0.9) for f in range(20) for p in range(3)], "video_id long, person_id int, frame_id long, frame_seq long, t_sec double, score double")
    assert select_persons.cap_per_video(rows, 15).count() == 15


def test_a_failing_batch_is_reported(spark):
    images = spark.createDataFrame([(1, b"ok"), (2, b"bad"), (3, None)], "id long, image binary")

    def load():
        def run(parts):
            if b"bad" in parts:
                raise ValueError("broken")
            return [[{"n": len(p)}] for p in parts]

        return run

    got = {r["id"]: (r["found"], r["error"]) for r in apply_detector(images, load, "n int", "id", "image", 1).collect()}
    assert got[1][0][0]["n"] == 2 and got[2] == ([], "ValueError: broken") and 3 not in got


def test_streamed_selection_keeps_the_gap(spark):
    from framesift.plans.all_queries import QUERIES

    got = QUERIES["stream_diverse_select"](spark, "/root/testdata/sf0.001").toPandas()
    for _, part in got.groupby("video_id"):
        t = sorted(part["t_sec"])
        assert len(t) <= 5 and all(b - a >= 21600 for a, b in zip(t, t[1:]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.integers(0, 400))), min_size=1, max_size=60))
def test_fold_and_rounds_agree_with_nulls_and_many_picks(spark, items):
    rows = spark.createDataFrame([(1, i, None if q is None else float(q), None if t is None else float(t)) for i, (q, t) in enumerate(items)], "g long, i long, q double, t double")
    args = (rows, ["g"], "q", "t", "i", F.lit(20), 6.0)
    folded, passed = ({r["i"]: (r["outcome"], r["pick"]) for r in how(*args).collect()} for how in (select_core.fold, select_core.rounds))
    assert folded == passed
    taken = []
    for i in sorted(range(len(items)), key=lambda i: (items[i][0] is None, -(items[i][0] or 0), i)):
        t = items[i][1]
        if len(taken) < 20 and all(t is None or x is None or abs(t - x) >= 6 for x in taken):
            taken.append(t)
            assert folded[i] == ("selected", len(taken))
        else:
            assert folded[i][0] != "selected"


def test_large_groups_of_many_picks(spark):
    rows = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.rand(1).alias("q"), (F.col("id") * 3.0).alias("t"))
    got = select_core.diverse_topk(rows, ["g"], "q", "t", "i", 20, 10.0, fold_rows=10)
    want = select_core.diverse_topk(rows, ["g"], "q", "t", "i", 20, 10.0)
    cols = ("i", "outcome", "pick")
    assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}


def test_reselection_drops_what_is_empty_now(spark, tmp_path):
    from framesift.streaming import streams

    schema = "video_id long, frame_id long"
    state = {"rows": [(1, 1), (2, 1)]}
    everything = lambda: spark.createDataFrame(state["rows"], schema)
    for n, rows in enumerate(([(1, 1), (2, 1)], [(2, 3)])):
        state["rows"] = [(1, 1), (2, 1)] if n == 0 else [(1, 1), (2, 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        updates = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streams.reselect(spark, updates, everything, lambda r: r.where("frame_id < 3"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        got = {tuple(r) for r in spark.read.schema("frame_id long, video_id long").parquet(f"{tmp_path}/out").select("video_id", "frame_id").collect()}
        assert got == ({(1, 1), (2, 1)} if n == 0 else {(1, 1)})


@pytest.mark.parametrize("whole", [0, 40, 10**6])
def test_ranks_within_groups_of_any_size(spark, whole):
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"v{i % 20}", i * 7919 % 13, i) for i in range(600)]
    rows = spark.createDataFrame(data, "video_id string, score int, seq int").repartition(8)
    got = {r["seq"]: r["rank"] for r in ranks.rank_within(rows, ["video_id"], [F.desc("score"), F.col("seq")], "rank", whole).collect()}
    want, n = {}, {}
    for video, _, seq in sorted(data, key=lambda r: (-r[1], r[2])):
        n[video] = want[seq] = n.get(video, 0) + 1
    assert got == want
    assert ranks.rank_within(rows.limit(0), ["video_id"], [F.col("seq")], "rank", whole).count() == 0
