"""Lists of candidates by video hold what merging all rows gives, and samples are not shuffled."""

import random

from pyspark.sql import functions as F

from framesift.operators import sampling


def made(spark):
    rng = random.Random(5)
    videos = [(i, rng.choice([0.1, 3.0, 7.3, 20.0]), rng.choice([0.0, 0.7, 1.0, 3.9, 23.976, 30.0]), rng.choice([0, 5, 600])) for i in range(60)]
    probe = [(rng.randrange(70), rng.choice([None, rng.random() * 8, rng.randrange(40) / 4]), rng.choice("IIB")) for _ in range(900)]
    return spark.createDataFrame(probe, "video_id long, pts double, pict_type string"), spark.createDataFrame(videos, "video_id long, duration double, fps double, total_frames int")


def test_lists_agree_with_the_merge_of_rows(spark):
    probe, videos = made(spark)
    key, other = sampling.keyframes(probe, videos), sampling.temporal(videos)
    gone = probe.where("pict_type = 'B'").select("video_id", F.coalesce(F.col("pts") * 2, F.lit(1.0)).cast("int").alias("frame_number"))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)
    lists = sampling.candidate_lists(probe, videos)
    assert same(sampling.listed(lists), sampling.merge_candidates(key, other))
    assert same(sampling.listed(lists, most=9), sampling.merge_candidates(key, other, 9))
    assert same(sampling.listed(sampling.candidate_lists(probe, videos, gone)), sampling.without_existing(sampling.merge_candidates(key, other), gone))
    want = {r["video_id"]: r["count"] for r in key.unionByName(other).groupBy("video_id").count().collect()}
    assert {r["video_id"]: r["considered"] for r in lists.collect() if r["considered"]} == want


def test_a_small_file_of_videos_is_many_tasks(spark):
    _, videos = made(spark)
    assert sampling.temporal(videos.coalesce(1)).rdd.getNumPartitions() >= 4
