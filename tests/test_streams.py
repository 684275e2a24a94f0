"""Streams over several micro-batches, restarts and replays, against plain simulations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from framesift.streaming import streams
from tests.test_frame_json import FRAME

EVENTS = "video_id long, frame_id long, t_sec double, ts timestamp"


def feed(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, build, source, target, checkpoint, schema=EVENTS):
    rows = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(rows.schema).parquet(target).collect()]


def moment(hours):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def test_late_frames_are_written_and_late_copies_are_not(spark, tmp_path):
    r = random.Random(3)
    source, seen, want = f"{tmp_path}/in", set(), []
    for batch in range(4):  # times go back by days, and frames come again
        rows = []
        for _ in range(12):
            video, frame = r.choice([1, 2, None]), r.choice([None, r.randrange(15)])
            hours = r.choice([batch * 100, batch * 100 - 500]) + r.random()
            rows.append((video, frame, hours, moment(hours)))
        feed(spark, source, rows)
        got = run(spark, streams.dedup_frames, source, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        for row in sorted(rows, key=lambda x: x[3]):
            if row[:2] not in seen:
                seen.add(row[:2])
                want.append(row)
        assert sorted(map(str, got)) == sorted(map(str, want)), batch


def plain_diverse(batches, k, gap, taken=None):
    taken, out = taken or {}, []
    for rows in batches:
        for video, frame, t, _ in sorted(rows, key=lambda x: (x[2], x[1])):
            mine = taken.setdefault(video, [])
            if len(mine) < k and all(abs(t - x) >= gap for x in mine):
                mine.append(t)
                out.append((video, frame, t))
    return out


def test_selection_over_micro_batches_and_a_restart(spark, tmp_path):
    r = random.Random(4)
    batches = [[(r.randrange(3), 100 * b + i, float(t := 50 * b + r.randrange(90)), moment(t / 3600)) for i in range(10)] for b in range(5)]
    build = lambda chosen=None: lambda rows: streams.diverse_select(rows, 4, 20.0, chosen=chosen)
    source = f"{tmp_path}/in"
    for b in batches[:3]:
        feed(spark, source, b)
        got = run(spark, build(), source, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    for b in batches[3:]:  # the same checkpoint goes on
        feed(spark, source, b)
        got = run(spark, build(), source, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(got) == sorted(plain_diverse(batches, 4, 20.0))
    for b in batches[3:]:  # a new checkpoint, which starts from what the first three batches chose
        feed(spark, f"{tmp_path}/again", b)
    early = plain_diverse(batches[:3], 4, 20.0)
    chosen = spark.createDataFrame([(v, t) for v, _, t in early], "video_id long, t_sec double")
    rest = run(spark, build(chosen), f"{tmp_path}/again", f"{tmp_path}/out2", f"{tmp_path}/checkpoint2")
    assert sorted(early + rest) == sorted(got)


HISTORY = "video_id long, frame_id long"


def test_reselection_is_published_in_versions(spark, tmp_path, monkeypatch):
    target, history, source = f"file://{tmp_path}/out", f"{tmp_path}/history", f"{tmp_path}/updates"
    rows = [(v, f) for v in [*range(20), None] for f in range(3)]
    spark.createDataFrame(rows, HISTORY).withColumn("bucket", streams.bucket_of("video_id", 8)).write.partitionBy("bucket").parquet(history)
    read = lambda: spark.read.schema(HISTORY + ", bucket int").parquet(history)
    best = lambda least: lambda rows: rows.where(F.col("frame_id") >= least)
    selections = streams.Selections(spark, target, HISTORY)
    assert selections.read().isEmpty()

    def step(videos, select):
        spark.createDataFrame([(v,) for v in videos], "video_id long").coalesce(1).write.mode("append").parquet(source)
        updates = spark.readStream.schema("video_id long").parquet(source)
        streams.reselect_buckets(spark, updates, read(), select, target, f"{tmp_path}/checkpoint", HISTORY, 8).awaitTermination()
        return {tuple(r) for r in selections.read().select("video_id", "frame_id").collect()}

    assert step([*range(20), None], best(2)) == {(v, 2) for v in [*range(20), None]}
    near = {r[0] for r in spark.range(20).where(streams.bucket_of("id", 8) == spark.range(3, 4).select(streams.bucket_of("id", 8)).first()[0]).collect()}
    want = {(v, 2) for v in [*range(20), None] if v not in near} | {(v, f) for v in near for f in (1, 2)}
    got = step([3], best(1))
    assert {x for x in got if x[0] is not None} == {x for x in want if x[0] is not None}
    def crash(*_):
        raise OSError("crash")

    # a crash between the rows and the manifest leaves the version before, and the batch runs again
    with monkeypatch.context() as m:
        m.setattr(streams.Selections, "_announce", crash)
        with pytest.raises(Exception, match="crash"):
            step([5], best(3))
    assert {tuple(r) for r in selections.read().select("video_id", "frame_id").collect()} == got
    assert (5, 2) not in step([5], best(3))
    # a replayed batch changes nothing
    before, version = {tuple(r) for r in selections.read().collect()}, selections.manifest()
    selections.publish(spark.createDataFrame([(5, 9, 0)], HISTORY + ", bucket int"), [0], version["batch"])
    assert {tuple(r) for r in selections.read().collect()} == before and selections.manifest() == version
    plan = read().where(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "IN (1,2)" in plan


def test_frame_documents_fan_out_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda i: json.dumps(FRAME | {"frame_id": f"f{i}"})
    (source / "a.txt").write_text("\n".join([line(0), "{broken", "", json.dumps({"frame_id": "x"}), line(1)]))
    tables = ("frames", "faces", "poses", "persons", "quarantine")
    state = lambda: {t: sorted(map(str, spark.read.parquet(f"{tmp_path}/out/{t}").drop("batch").collect())) for t in tables}
    go = lambda checkpoint: streams.ingest_frames(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}").awaitTermination()
    go("checkpoint")
    first = state()
    assert [len(first[t]) for t in tables] == [2, 4, 2, 2, 2]
    go("checkpoint")  # nothing new
    assert state() == first
    go("other")  # the same batch once more, as after a crash before its commit
    assert state() == first
    (source / "b.txt").write_text(line(2))
    go("checkpoint")
    assert [len(state()[t]) for t in tables] == [3, 6, 3, 3, 2]


def test_state_of_many_videos_is_kept_in_few_parts(spark, tmp_path):
    """State does not have an entry a video, and ids that read alike when put together stay apart."""
    odd = [("a", "=b=c"), ("a=b", "=c"), ("a=b=c", None), (None, "a"), ("null", "a"), ("a", None), ("a", "null"), ("", "")]
    rows = [(v, f, 1.0, moment(0)) for v, f in [(str(i), "0") for i in range(300)] + odd]
    schema = EVENTS.replace("long", "string")
    feed(spark, f"{tmp_path}/in", rows + rows[150:], schema)
    found = streams.dedup_frames(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), parts=4)
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4 * 4
