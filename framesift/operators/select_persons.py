"""Selection of person instances: best per category, filled up by quality, capped per video.

Candidates: video_id, person_id, frame_id, frame_seq, t_sec, quality, pose (primary label), direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.select_core import diverse_topk
from framesift.operators.store import materialize

PERSON = ["video_id", "person_id"]


def candidates(persons: DataFrame, least: float = 0.3) -> DataFrame:
    return persons.where(F.col("quality") >= least)


def primary_label(labels: Column) -> Column:
    """Label with the highest confidence of array<struct<label, conf>>; of equals the first; null of none."""
    best = F.aggregate(labels, F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("conf")), lambda acc, x: F.when(acc["conf"].isNull() | (x["conf"] > acc["conf"]), F.struct(x["label"].alias("label"), x["conf"].cast("double").alias("conf"))).otherwise(acc))
    return best["label"]


def best_per_category(rows: DataFrame) -> DataFrame:
    """The best row of each (person, pose) and of each (person, direction), each on its own; ties by frame_seq."""

    def best(column, prefix):
        order = F.struct((-F.col("quality")).alias("q"), "frame_seq")
        found = rows.where(F.col(column).isNotNull()).groupBy(*PERSON, column).agg(F.min_by(F.struct("frame_id", "frame_seq", "t_sec", "quality"), order).alias("b"))
        return found.select(*PERSON, F.concat(F.lit(prefix), F.col(column)).alias("category"), "b.*")

    return best("pose", "pose_").unionByName(best("direction", "head_angle_"))


def combine(picks: DataFrame) -> DataFrame:
    """One row a frame: its categories in order, joined by " + ", and the best score."""
    text = F.array_join(F.array_sort(F.collect_list("category")), " + ")
    return picks.groupBy(*PERSON, "frame_id").agg(text.alias("category"), F.max("quality").alias("score"), F.min("frame_seq").alias("frame_seq"), F.min("t_sec").alias("t_sec"))


def limit_per_person(rows: DataFrame, most: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.desc("score"), "frame_seq"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def fill(rows: DataFrame, picked: DataFrame, least: int = 3, gap: float = 2.0) -> DataFrame:
    """What is added to persons with fewer than `least` rows: unpicked frames by quality, apart in time among the added only."""
    n = picked.groupBy(*PERSON).agg(F.count("*").alias("n"))
    free = rows.join(picked.select(*PERSON, "frame_id"), [*PERSON, "frame_id"], "left_anti").join(n, PERSON, "left")
    free = free.withColumn("need", F.lit(least) - F.coalesce("n", F.lit(0)).cast("int")).where("need > 0")
    found = diverse_topk(free, PERSON, "quality", "t_sec", "frame_seq", F.col("need"), gap).where("outcome = 'selected'")
    return found.select(*PERSON, "frame_id", F.lit("minimum").alias("category"), F.col("quality").alias("score"), "frame_seq", "t_sec")


def quality_priority(rows: DataFrame, least: int = 3, most: int = 10, gap: float = 2.0) -> DataFrame:
    """Without categories: by quality, apart in time, at most `most`; the first `least` are the minimum."""
    found = diverse_topk(rows, PERSON, "quality", "t_sec", "frame_seq", most, gap).where("outcome = 'selected'")
    return found.select(*PERSON, "frame_id", F.when(F.col("pick") <= least, "minimum").otherwise("additional").alias("category"), F.col("quality").alias("score"), "frame_seq", "t_sec")


def cap_per_video(rows: DataFrame, most: int = 100) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "person_id", "frame_seq"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def select_persons(rows: DataFrame, least: int = 3, most: int = 10, gap: float = 2.0, cap: int = 100) -> DataFrame:
    """The whole selection in its category mode."""
    good = candidates(rows)
    picked = materialize(limit_per_person(combine(best_per_category(good)), most), "persons")
    return cap_per_video(picked.unionByName(fill(good, picked, least, gap)), cap)


def summary(picked: DataFrame) -> DataFrame:
    """A row a person: rows, score range and mean, distinct categories."""
    return picked.groupBy(*PERSON).agg(
        F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"), F.array_sort(F.collect_set("category")).alias("categories")
    )
