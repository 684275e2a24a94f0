"""Run tracking: progress, rates and integrity from event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def progress(steps: DataFrame) -> DataFrame:
    """steps: run_id, step, total, processed, done. Adds pct, remaining and the run's share of finished steps."""
    pct = F.coalesce(F.try_divide(F.col("processed") * F.lit(100.0), F.nullif("total", F.lit(0)).cast("double")), F.lit(0.0))
    overall = F.avg(F.col("done").cast("double")).over(Window.partitionBy("run_id")) * 100
    return steps.withColumn("pct", pct).withColumn("remaining", F.greatest(F.col("total") - F.col("processed"), F.lit(0))).withColumn("overall_pct", overall)


def rates(events: DataFrame) -> DataFrame:
    """events: run_id, step, seq, elapsed_s, processed, total. Adds rate, running peak and remaining seconds."""
    out = events.withColumn("rate", F.when(F.col("elapsed_s") > 0, F.col("processed") / F.col("elapsed_s")))
    peak = F.max("rate").over(Window.partitionBy("run_id", "step").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    eta = F.when(F.col("rate") > 0, (F.col("total") - F.col("processed")) / F.col("rate"))
    return out.withColumn("peak_rate", F.coalesce(peak, F.lit(0.0))).withColumn("eta_s", eta)


def integrity(recorded: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digest is not the recorded one, or that are gone."""
    now = current.select(key, F.col(digest).alias("current"))
    both = recorded.select(key, F.col(digest).alias("recorded")).join(now, key, "left")
    return both.where(~F.col("recorded").eqNullSafe(F.col("current"))).withColumn("state", F.when(F.col("current").isNull(), "missing").otherwise("changed"))
