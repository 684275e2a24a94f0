"""Frame documents with the keys their programs write: every field is read, missing ones get defaults, and a written document reads back."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from framesift.operators import quality
from framesift.sources import tables

FRAME = {
    "video_id": 7, "frame_id": "f1", "file_path": "/x/f1.jpg",
    "source_info": {"video_timestamp": 1.5, "extraction_method": "i_frame", "original_frame_number": 45, "video_fps": 25.0},
    "image_properties": {"width": 640, "height": 480, "channels": 3, "file_size_bytes": 99, "format": "PNG", "color_space": "RGB"},
    "face_detections": [{"bbox": [1, 2, 30, 40], "confidence": 0.9, "landmarks": [[3.5, 4.5], [5.0, 6.0]], "area": 1102}, {"bbox": [5, 5, 9, 9], "confidence": 0.5, "landmarks": None, "area": 16}],
    "pose_detections": [{"bbox": [0, 0, 100, 200], "confidence": 0.8, "keypoints": {"nose": [1.0, 2.0, 0.9]}, "pose_classifications": [["standing", 0.75]]}],
    "head_poses": [{"yaw": 1.0, "pitch": 2.0, "roll": 3.0, "confidence": 0.7, "direction": "front", "face_id": 0}],
    "quality_metrics": {"laplacian_variance": 1.0, "sobel_variance": 2.0, "brightness_score": 3.0, "contrast_score": 4.0, "overall_quality": 0.5, "quality_issues": ["dark"], "usable": False},
    "closeup_detections": [{"is_closeup": True, "shot_type": "closeup", "confidence": 0.6, "face_area_ratio": 0.2, "inter_ocular_distance": 12.0, "estimated_distance": "close", "shoulder_width_ratio": None}],
    "persons": [{"person_id": 0, "face": {"type": "FaceDetection", "bbox": [1, 2, 30, 40], "confidence": 0.9, "landmarks": None}, "body": {"type": "BodyUnknown"}, "head_pose": None, "quality": {"face_quality": 0.4, "body_quality": 0.0, "overall_quality": 0.28}}],
    "selections": {"selected_for_poses": ["standing"], "selected_for_head_angles": [], "final_output": True, "output_files": ["a.png"], "crop_regions": {"face": [1, 2, 3, 4]}, "selection_rank": 1, "quality_rank": 2, "category_scores": {"standing": 0.5}, "category_score_breakdowns": {"standing": {"quality": 0.5}}, "category_ranks": {"standing": 1}, "primary_selection_category": "pose_standing", "selection_competition": {"standing": "won"}, "final_selection_score": 0.5, "rejection_reason": None},
    "processing_timings": {"face_detection_ms": 1.0, "pose_estimation_ms": None, "head_pose_estimation_ms": None, "quality_assessment_ms": None, "closeup_detection_ms": None, "total_processing_ms": 1.0},
    "debug_info": {"a": "b"},
}


def same(got, want):
    """Every key of `want` is in `got` with its value; what is null may be missing."""
    if isinstance(want, dict):
        return all(same((got or {}).get(k), v) for k, v in want.items())
    if isinstance(want, list):
        return len(got) == len(want) and all(map(same, got, want))
    return got == want


def test_a_document_is_read_whole_and_written_back(spark, tmp_path):
    text = spark.createDataFrame([(json.dumps(FRAME),), ("{broken",), (json.dumps({"frame_id": "no selections"}),)], "value string")
    frames = tables.parse_frames(text)
    r = frames.collect()
    assert len(r) == 1 and r[0]["pose_detections"][0]["keypoints"] == {"nose": [1.0, 2.0, 0.9]} and r[0]["closeup_detections"][0]["estimated_distance"] == "close"
    assert same(json.loads(tables.as_json(frames).first()["value"]), FRAME)
    tables.write_frames(frames, f"{tmp_path}/out")
    again = tables.read_frames(spark, f"{tmp_path}/out")
    assert again.collect() == r
    (tmp_path / "one.json").write_text(json.dumps([FRAME, FRAME], indent=1))
    assert tables.read_frames(spark, f"{tmp_path}/one.json", whole=True).collect() == r * 2
    assert [(x["x1"], x["y2"], x["idx"]) for x in tables.child(frames, "face_detections").collect()] == [(1, 40, 0), (5, 9, 1)]
    person = tables.persons(frames).first()
    assert person["body"] is None and person["face"]["bbox"] == [1, 2, 30, 40]


def test_missing_fields_get_defaults(spark):
    text = spark.createDataFrame([(json.dumps({"frame_id": "f", "selections": {}, "face_detections": [{}], "quality_metrics": {"overall_quality": 0.3}}),)], "value string")
    r = tables.parse_frames(text).first()
    assert r["source_info"].asDict() == {"video_timestamp": 0.0, "extraction_method": "unknown", "original_frame_number": 0, "video_fps": 30.0}
    assert r["image_properties"]["format"] == "JPG" and r["image_properties"]["channels"] == 3
    assert r["face_detections"][0]["bbox"] == [0, 0, 0, 0] and r["persons"] == [] and r["selections"]["final_output"] is False
    assert r["quality_metrics"]["usable"] is True and r["quality_metrics"]["quality_issues"] == []


def test_child_tables_are_nested(spark):
    key = "video_id long, frame_id long"
    frames = spark.createDataFrame([(1, 5), (1, 6)], key)
    det = spark.createDataFrame([(1, 5, "face", 1, 5, 5, 9, 9, 0.5), (1, 5, "face", 0, 1, 2, 30, 40, 0.9), (1, 5, "body", 0, 0, 0, 100, 200, 0.8)], key + ", kind string, idx int, x1 int, y1 int, x2 int, y2 int, conf double")
    heads = spark.createDataFrame([(1, 5, 0, 1.0, 2.0, 3.0, 0.7, "front", 1)], key + ", idx int, yaw double, pitch double, roll double, confidence double, direction string, face_id int")
    close = spark.createDataFrame([(1, 5, 0, True, "closeup")], key + ", idx int, is_closeup boolean, shot_type string")
    people = spark.createDataFrame([(1, 5, 0, 1, None, 0.4, 0.0, 0.28)], key + ", person_id int, face_idx int, body_idx int, face_quality double, body_quality double, overall double")
    nested = tables.nest(frames, det, heads, close, people).withColumn("selections", F.struct(F.lit(True).alias("final_output")))
    got = {r["frame_id"]: r for r in tables.parse_frames(tables.as_json(nested)).collect()}
    five = got["5"]
    assert [f["bbox"] for f in five["face_detections"]] == [[1, 2, 30, 40], [5, 5, 9, 9]] and five["face_detections"][0]["area"] == 29 * 38
    person = five["persons"][0]
    assert person["face"]["bbox"] == [5, 5, 9, 9] and person["body"]["type"] == "BodyUnknown" and person["head_pose"]["direction"] == "front"
    assert five["closeup_detections"][0]["shot_type"] == "closeup" and got["6"]["face_detections"] == []


def test_files_are_hashed_in_rows_and_in_pieces(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.BIN").write_bytes(bytes([i]) * (10 ** (i + 4)))
    got = {r["path"].rsplit("/", 1)[1]: r for r in tables.file_manifest(spark, str(tmp_path), in_row=50_000).collect()}
    assert {n: r["sha256"] for n, r in got.items()} == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*.BIN")}
    assert {r["extension"] for r in got.values()} == {".bin"}


def test_quality_of_boxes_as_pixel_by_pixel(spark):
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (8, 8))
    boxes = [(0, -1, 1, 4, 7), (1, 2, 1, 10, 7), (2, 5, 5, 5, 7), (3, 0, 0, 1, 1)]
    rasters = spark.createDataFrame([(1, image.ravel().tolist(), 8, 8)], "vec_id long, px array<int>, width int, height int")
    table = spark.createDataFrame([(1, *b) for b in boxes], "vec_id long, box_id long, x1 int, y1 int, x2 int, y2 int")
    got = {x["box_id"]: x for x in quality.raster_bbox_quality(rasters, table, "vec_id").collect()}
    for i, x1, y1, x2, y2 in boxes:
        part = image[max(0, y1) : min(8, y2), max(0, x1) : min(8, x2)]
        if not part.size:
            assert got[i]["laplacian"] is None
            continue
        h, w = part.shape
        fold = lambda k, n: 0 if n == 1 else -k if k < 0 else 2 * n - 2 - k if k >= n else k
        at = lambda y, x: float(part[fold(y, h), fold(x, w)]) if min(h, w) > 1 else float(part[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
        lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
        assert abs(got[i]["laplacian"] - np.var(lap)) < 1e-6 and abs(got[i]["brightness"] - part.mean()) < 1e-9 and abs(got[i]["contrast"] - part.std()) < 1e-9
