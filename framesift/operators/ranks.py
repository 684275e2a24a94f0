"""Ranks within a group of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.store import materialize


def rank_within(rows: DataFrame, keys: list[str], order: list[Column], name: str, whole: int = 1_000_000) -> DataFrame:
    """Adds `name`, from 1, by `order` within the keys; `order` is unique in a group.

    Groups of up to `whole` rows are sorted by a task each. Larger ones are sorted over many tasks: by ranges of keys and order,
    which are written, so that a row's rank is its place in its range and the rows of its group in the ranges before. A
    group with a third of all rows is thus a third of the ranges. The result does not depend on `whole`. Null keys are a group, sorted by one task.
    """
    alone = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    over = lambda by: rows.groupBy(*by).count().where(F.col("count") > whole).select(*by).dropna()
    # no group is larger than all rows of its first key, which are cheaper to count
    if over(keys[:1]).isEmpty() or (large := over(keys)).isEmpty():
        return rows.withColumn(name, alone)
    large = F.broadcast(large)  # at most a row for every `whole` rows
    small = rows.join(large, keys, "left_anti").withColumn(name, alone)
    ranges = rows.join(large, keys, "left_semi").orderBy(*keys, *order).select(*rows.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    ranges = materialize(ranges, "ranks")
    # a row a group and range: as many as there are ranges and large groups
    parts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).alias("p")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}") == F.col(f"p.{c}") for c in [*keys, "_range"]])
    rank = (F.col("r._at") - F.col("p._first") + F.col("p._before") + 1).cast("int").alias(name)
    found = ranges.alias("r").join(F.broadcast(parts), same).select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], rank)
    return small.unionByName(found)
