"""State documents of whole videos: cut at any place of the stream, read with a quarantine, written and read again."""

import json
import random

from pyspark.sql import functions as F

from framesift.sources import states
from tests.test_frame_json import FRAME, same

HEAD = {
    "video_file": "/v/a.mp4", "video_hash": "h1", "video_metadata": {"duration": 9.5, "fps": 25.0, "width": 640, "height": 480, "codec": "h264", "total_frames": 237, "file_size_bytes": 99, "format": "mp4"},
    "model_versions": {"face": "1"}, "created_at": "2024-01-01T00:00:00", "last_updated": "2024-01-02T00:00:00", "current_step": "done", "completed_steps": ["a"], "failed_steps": [],
    "step_progress": {"frames": {"total_items": 3, "processed_count": 2, "completed": False, "started_at": "2024-01-01T00:00:00", "completed_at": None, "step_data": {"frames": [1, {"x": "]}"}]}}},
    "processing_stats": {"n": 1}, "config_snapshot": {"frames": ["not these"]}, "frame_selections": {},
}


def frame(i, **more):
    return FRAME | {"frame_id": f"f{i}", "debug_info": {"text": 'a "quoted" ]}[{, \\ é\u2028'}} | more


def cut(text, size):
    scanner, out = states.Scanner(), []
    data = text.encode()
    for at in range(0, len(data), size):
        out += scanner.feed(data[at : at + size])
    return out + list(scanner.end())


def test_scanner_cuts_at_any_place():
    rng = random.Random(1)
    values = [{"a": [1, {"b": "}]\\\""}]}, {}, 5, "te,xt]", None, [1, [2]], "", -1.5e3, True]
    for k in range(60):
        frames = [rng.choice(values) for _ in range(rng.randrange(6))]
        document = {"x": {"frames": [1]}, "s": "frames", "frames": frames, "after": ["frames", {"frames": []}]}
        text = json.dumps(document, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        out = cut(text, rng.choice([1, 2, 3, 7, 1000]))
        assert [json.loads(v) for kind, _, v in out if kind == "frame"] == frames, text
        assert json.loads(out[-1][2]) == document | {"frames": []}
    assert cut('{"frames": [{"a": 1}, {"b": ', 5)[-1][0] == "broken" and cut("", 5) == [("head", -1, b"")]


def test_round_trip_and_quarantine(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    frames = [frame(0), {"frame_id": "no selections"}, frame(1), {"frame_id": "f9", "selections": {}, "face_detections": 7}, frame(2)]
    (folder / "a.json").write_text(json.dumps(HEAD | {"frames": frames}, indent=2, ensure_ascii=False))
    (folder / "b.json").write_text(json.dumps(HEAD | {"video_hash": "h2", "frames": [frame(i) for i in range(50)]}))
    (folder / "c.json").write_text(json.dumps({"video_file": "x", "frames": [frame(0)]}))
    (folder / "d.json").write_text(json.dumps(HEAD | {"video_hash": "h4", "frames": [frame(0), frame(1)]})[:-40])
    (folder / "e.json").write_text("")
    (folder / "g.json").write_text("  7")
    (folder / "f.json").write_text(json.dumps({k: v for k, v in HEAD.items() if k not in ("step_progress", "current_step")} | {"video_hash": "h6"}))
    found = {}
    for in_row in (1 << 24, 100):  # through Spark's reader, and as a stream
        heads, got, bad = states.read_states(spark, f"file://{folder}", in_row=in_row)
        names = lambda r: (r["path"][-6:], r["idx"])
        assert {r["path"][-6:]: r["video_hash"] for r in heads.collect()} == {"a.json": "h1", "b.json": "h2", "f.json": "h6"}
        assert sorted(map(names, got.collect())) == [("a.json", 0), ("a.json", 2), ("a.json", 4), *[("b.json", i) for i in range(50)], ("c.json", 0), ("d.json", 0)]
        assert {names(r): r["error"] for r in bad.collect()} == {
            ("a.json", 1): "no selections", ("a.json", 3): "not a frame document", ("c.json", None): "no video_hash", ("d.json", 1): "document ends early", ("g.json", None): "not a state document",
        }
        found[in_row] = sorted(got.drop("path").collect(), key=str)
    assert found[100] == found[1 << 24]
    keyed = got.join(heads.select("path", "video_hash"), "path")
    states.write_states(heads, keyed, f"{tmp_path}/out")
    written = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").glob("state=*/part-*")}
    assert set(written) == {"state=h1", "state=h2", "state=h6"}
    assert same(written["state=h1"], HEAD | {"frames": [frame(0), frame(1), frame(2)]})
    assert [f["frame_id"] for f in written["state=h2"]["frames"]] == [f"f{i}" for i in range(50)] and written["state=h6"]["frames"] == []
    heads2, frames2, bad2 = states.read_states(spark, f"file://{tmp_path}/out")
    plain = lambda df: sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.drop("path", "idx").collect()))
    assert plain(heads2) == plain(heads) and bad2.isEmpty()
    assert plain(frames2) == plain(got.join(heads.select("path"), "path"))
    assert frames2.where(F.col("frame_id") == "f1").count() == 2
