"""What plans must not do: parse a text more than once, make persons twice, shuffle what a figure is taken from or rows that lie together."""

import json

from pyspark.sql import functions as F

from framesift.operators import associate, closeups, quality, ranks
from framesift.plans import person_queries
from framesift.plans.table_queries import FRAME as FRAME_COLUMN
from framesift.plans.table_queries import lines
from framesift.sources import tables
from framesift.streaming import streams
from framesift.views import load
from tests.test_frame_json import FRAME

BOX = "x1 int, y1 int, x2 int, y2 int"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_parsed_once(spark):
    lines = [json.dumps(FRAME), "{broken", json.dumps({"frame_id": "x"}), None]
    frames = tables.parse_frames(spark.createDataFrame([(x,) for x in lines], "value string"))
    found = tables.boxes(frames, face="face_detections", body="pose_detections")
    assert plan(found).count("from_json(") == 1
    want = []
    for kind, column in (("face", "face_detections"), ("body", "pose_detections")):
        want += [(kind, r["idx"], r["x1"], r["y1"], r["x2"], r["y2"], r["confidence"]) for r in tables.child(frames, column).collect()]
    got = [tuple(r) for r in found.drop("video_id", "frame_id").collect()]
    assert len(got) > 1 and sorted(map(str, got)) == sorted(map(str, want))


def test_references_meet_persons_once(spark):
    found = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 1, None), (2, 1, 0, 0.7)], "video_id long, frame_id long, person_id int, quality double")
    refs = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 1, 2), (None, 1, 0)], "video_id long, frame_id long, person_id int")
    got = associate.marked_refs(refs, found)
    assert plan(got).count("Join ") == 1
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 1, 0, 0.5, True), (1, 1, 1, None, True), (1, 1, 2, None, False), (None, 1, 0, None, False)]))


def test_landmarks_and_keypoints_are_not_shuffled(spark):
    point = "struct<x:double,y:double>"
    faces = spark.createDataFrame([(1, 10, 10, 110, 110, 0.8, [(0.0, 0.0), (60.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)], 1000, 1000), (2, 0, 0, 10, 10, 0.5, None, 1000, 1000)], f"k int, {BOX}, conf double, landmarks array<{point}>, width int, height int")
    bodies = spark.createDataFrame([(1, {"left_shoulder": (500.0, 1.0, 0.9), "right_shoulder": (100.0, 1.0, 0.9)})], "k int, keypoints map<string,struct<x:double,y:double,conf:double>>")
    got = closeups.detect(faces.repartition(2), bodies.repartition(2), ["k"])
    join = got._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    assert not {"landmarks", "keypoints"} & {join.output().apply(i).name() for i in range(join.output().size())}
    rows = {r["k"]: r for r in got.collect()}
    assert (rows[1]["iod"], rows[1]["shoulder_ratio"], rows[1]["shot_type"], rows[1]["face_ratio"]) == (60.0, 0.4, "medium_closeup", 0.01)
    assert (rows[2]["iod"], rows[2]["shoulder_ratio"], rows[2]["shot_type"]) == (None, None, "wide_shot")


def test_frames_are_nested_after_one_shuffle(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double"
    rows = [(o, n, 7 * o + n, 3 * o + n, float(n), 10.0 * n, 0.01 * n) for o in range(30) for n in range(1, 6)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = load(spark, str(tmp_path), "v_detections", FRAME_COLUMN)
    made = lines(found)
    physical = made._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(") == 1 and "Join" not in physical and plan(made).lower().count("structstojson") == 1
    assert sorted(map(str, found.collect())) == sorted(map(str, load(spark, str(tmp_path), "v_detections").collect()))
    keys = found.select("video_id", "frame_id").distinct()
    assert sorted(map(str, tables.nest(None, found).collect())) == sorted(map(str, tables.nest(keys, found).collect()))


def test_ingest_keeps_the_text_of_wrong_lines_only(spark, tmp_path, monkeypatch):
    kept = []
    write = streams.materialize

    def materialize(df, name):
        kept.append((plan(df).count("from_json("), out := write(df, name), [r.asDict() for r in out.collect()]))
        return out

    monkeypatch.setattr(streams, "materialize", materialize)
    (tmp_path / "in").mkdir()
    bare = json.dumps({"frame_id": "bare", "selections": {}, "face_detections": [{}, None, {"bbox": [1, 2, 3, 4]}], "pose_detections": [{"confidence": 0.5}]})
    (tmp_path / "in" / "a.txt").write_text("\n".join([json.dumps(FRAME), bare, "{broken", " ", "\t", json.dumps({"frame_id": "x"})]))
    streams.ingest_frames(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    [(parsed, table, rows)] = kept
    assert parsed == 1 and {"frame_id", "face_detections"} < set(table.columns) and "value" not in table.columns
    read = lambda t: spark.read.parquet(f"{tmp_path}/out/{t}").drop("batch")
    wrong = {("{broken", "not a frame document"), ("\t", "not a frame document"), (json.dumps({"frame_id": "x"}), "no selections")}
    assert {(r["framesift_text"], r["framesift_error"]) for r in rows} == wrong | {(None, None)} and {tuple(r) for r in read("quarantine").collect()} == wrong
    frames = tables.parse_frames(spark.createDataFrame([(json.dumps(FRAME),), (bare,)], "value string"))
    for name, column in (("faces", "face_detections"), ("poses", "pose_detections")):
        want = tables.child(frames, column)
        assert read(name).columns == want.columns and sorted(map(str, read(name).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, read("frames").collect())) == sorted(map(str, frames.drop("face_detections", "pose_detections", "persons").collect()))


def test_frames_of_many_detections_are_nested_in_order(spark):
    det = [(1, 5, kind, i * 37 % n, i * 37 % n, 0, 9, 9, 0.5) for kind, n in (("face", 1000), ("body", 300)) for i in range(n)]
    det += [(1, 6, "face", None, 7, 0, 9, 9, 0.5), (None, 6, "body", 0, 3, 0, 9, 9, 0.5)]
    det += [(1, 7, "face", i // 600, i // 600, 0, 9, 9, 0.5) for i in range(1200)]  # ties
    det = spark.createDataFrame(det, f"video_id long, frame_id long, kind string, idx int, {BOX}, conf double").repartition(3)
    got = {(r["video_id"], r["frame_id"]): [[e["bbox"][0] for e in r[c]] for c in ("face_detections", "pose_detections")] for r in tables.nest(None, det).collect()}
    assert got == {(1, 5): [list(range(1000)), list(range(300))], (1, 6): [[], []], (None, 6): [[], [3]], (1, 7): [[0] * 600 + [1] * 600, []]}


def test_frame_quality_takes_one_shuffle_and_no_join(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double"
    rows = [(o, n, 7 * o + n, 3 * o + n, float(n), 10.0 * n, 0.01 * n) for o in range(30) for n in range(1, 6)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = load(spark, str(tmp_path), "v_detections", FRAME_COLUMN)
    made = person_queries.rounded(found)
    physical = made._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(") == 1 and "Join" not in physical
    # the same persons as with boxes that are joined
    boxes = found.where("frame_id % 7 <> 0").select("video_id", "frame_id", "kind", "idx", F.least(F.lit(1.0), F.col("conf") * 1.1).alias("overall"))
    want = quality.person_quality(associate.persons(found), boxes)
    assert sorted(map(str, person_queries.scored(found).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_ranks_of_large_groups_shuffle_rows_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ranks, "materialize", lambda df, name: plans.append(df) or df.localCheckpoint())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        rows = spark.createDataFrame([(g, i) for g, n in ((1, 50), (2, 3)) for i in range(n)], "g long, i long").localCheckpoint()
        found = ranks.rank_within(rows, ["g"], [F.desc("i")], "rank", 10)
        for made in (plans[0], found):
            assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
        assert {(r["g"], r["i"], r["rank"]) for r in found.collect()} == {(g, i, n - i) for g, n in ((1, 50), (2, 3)) for i in range(n)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
