"""Queries of the streaming forms: each runs over the events table as a stream until all is read, and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framesift.operators.select_core import diverse_topk
from framesift.operators.store import shared_dir
from framesift.plans import registry
from framesift.plans.frame_queries import GAP, SCORE, greedy_sql
from framesift.streaming import streams
from framesift.views import duck, load


def _new(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def events(spark, sf_dir):
    """The table as a stream; the pattern matches a file as well as a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _written(spark, rows, name):
    target = _new(spark, name)
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", _new(spark, "checkpoint")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


def add(name, build, sql=None, *views):
    registry.QUERIES[name] = lambda spark, sf_dir: registry.tidy(build(spark, sf_dir))
    if sql:
        registry.ORACLES[name] = duck(sql, *views) if views else sql.strip()


def _ingest(spark, sf_dir):
    source, target, checkpoint = f"{sf_dir}/events.parque[t]", _new(spark, "ingested"), _new(spark, "checkpoint")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for _ in range(2):  # the second run finds nothing new
        streams.ingest(spark, source, schema, target, checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(target).select("event_id", "user_id", "event_type", "value")


add("stream_ingest_detections", _ingest, "select event_id, user_id, event_type, round(value, 6) as value from events")


def _documents(spark, sf_dir):
    """Faces and poses of frame documents that came as a stream of lines, some of them broken."""
    from framesift.plans.table_queries import FRAME, lines
    from framesift.sources import tables

    source, target, checkpoint = _new(spark, "documents"), _new(spark, "frames"), _new(spark, "checkpoint")
    lines(load(spark, sf_dir, "v_detections", FRAME)).write.text(source)
    for _ in range(2):  # the second run finds nothing new
        streams.ingest_frames(spark, source, target, checkpoint).awaitTermination()
    kind = lambda name, of: spark.read.parquet(f"{target}/{name}").select("video_id", F.col("frame_id").cast("long").alias("frame_id"), F.lit(of).alias("kind"), "idx", "x1", "y2", F.col("confidence").alias("conf"))
    return kind("faces", "face").unionByName(kind("poses", "body"))


add("stream_ingest_frames", _documents, "select video_id, frame_id, kind, cast(idx as bigint) as idx, cast(x1 as bigint) as x1, cast(y2 as bigint) as y2, round(conf, 6) as conf from v_detections where frame_id % 11 <> 0 and frame_id % 13 <> 0", "v_detections")


def _dedup(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").alias("video_id"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("frame_id"), "ts")
    return _written(spark, streams.dedup_frames(rows), "dedup").select("video_id", "frame_id")


add("stream_dedup_frames", _dedup, "select distinct user_id as video_id, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as frame_id from events")


def _counts(**how):
    def run(spark, sf_dir):
        out = _written(spark, streams.windowed_counts(events(spark, sf_dir), "event_type", **how), "counts")
        return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event_type", "n")

    return run


MARK = "m as (select epoch_us(max(ts)) - 3600000000 as mark from events)"
SIX, TWO = 6 * 3600 * 10**6, 2 * 3600 * 10**6
add(
    "stream_counts_window", _counts(size="6 hours"),
    f"with {MARK}, w as (select epoch_us(ts) // {SIX} * {SIX} as start_us, event_type from events) select start_us, start_us + {SIX} as end_us, event_type, count(*) as n from w, m where start_us + {SIX} <= mark group by all",
)
add(
    "stream_counts_sliding", _counts(size="6 hours", slide="2 hours"),
    f"with {MARK}, w as (select epoch_us(ts) // {TWO} * {TWO} - i * {TWO} as start_us, event_type from events, range(0, 3) as r(i)) select start_us, start_us + {SIX} as end_us, event_type, count(*) as n from w, m where start_us + {SIX} <= mark group by all",
)
TEN = 10 * 60 * 10**6
add(
    "stream_counts_session", _counts(gap="10 minutes"),
    f"""with {MARK}, l as (select event_type, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by event_type order by ts) as p from events), s as (select event_type, t, sum(case when p is null or t > p + {TEN} then 1 else 0 end) over (partition by event_type order by t rows unbounded preceding) as g from l),
    o as (select event_type, min(t) as start_us, max(t) + {TEN} as end_us, count(*) as n from s group by event_type, g) select start_us, end_us, event_type, n from o, m where end_us <= mark""",
)


def _diverse(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), (F.unix_micros("ts") / F.lit(1e6)).alias("t_sec"), "ts")
    return _written(spark, streams.diverse_select(rows, 5, GAP, delay="1 hour"), "diverse")


add(
    "stream_diverse_select", _diverse,
    f"with s as (select *, cast(0 as double) as score from v_candidates), {greedy_sql('s', 'video_id', 'score', seq='t_sec, frame_id')} select video_id, frame_id, round(t_sec, 6) as t_sec from g where outcome = 'selected'", "v_candidates",
)


def _reselect(spark, sf_dir):
    target, history, chosen_schema = _new(spark, "reselected"), _new(spark, "history"), "video_id long, frame_id long, pick int"
    rows = load(spark, sf_dir, "v_candidates").withColumn("bucket", streams.bucket_of("video_id", 16))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(history)
    everything = spark.read.schema(rows.schema).parquet(history)
    scored = lambda v: v.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality") * 0.7 + F.col("conf") * 0.3)))
    chosen = lambda v: diverse_topk(scored(v), ["video_id"], "score", "t_sec", "frame_seq", 5, GAP).where("outcome = 'selected'").select("video_id", "frame_id", "pick")
    updates = events(spark, sf_dir).select(F.col("user_id").alias("video_id"))
    streams.reselect_buckets(spark, updates, everything, chosen, target, _new(spark, "checkpoint"), chosen_schema, 16).awaitTermination()
    return streams.Selections(spark, target, chosen_schema).read()


add("incremental_reselect", _reselect, f"with s as (select *, {SCORE} as score from v_candidates), {greedy_sql('s', 'video_id', 'score')} select video_id, frame_id, cast(pick as bigint) as pick from g where outcome = 'selected'", "v_candidates")
