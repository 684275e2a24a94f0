"""Means do not depend on the order of rows, and six digits are those of DuckDB."""

import random
from functools import reduce

from pyspark.sql import functions as F

from framesift.functions.quality import exact_mean
from framesift.operators import quality
from framesift.plans.registry import six


def test_a_mean_at_a_limit_is_exact(spark):
    values = [0.1, 0.2, 0.3, 0.4, 0.5]  # 0.3; sums of doubles differ by order
    for some in (values, values[::-1], [0.3, 0.1, 0.5, 0.2, 0.4], [0.7, 0.1, 0.1]):
        df = spark.createDataFrame([(1, 1, x) for x in some], "video_id long, frame_id long, overall double").coalesce(1)
        r = quality.infer_from_persons(df).first()
        assert r["overall"] == 0.3 and r["usable"], some


def test_odd_figures(spark):
    df = spark.createDataFrame([(1, None), (1, 0.5), (2, None), (3, float("inf")), (3, 1.0), (4, 1e12), (4, 3e12)], "g int, x double")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(exact_mean(F.col("x")).alias("m")).collect()}
    assert got == {1: 0.5, 2: None, 3: float("inf"), 4: 2e12}


def test_six_digits_as_duckdb(spark):
    import duckdb

    values = [i / 1e7 + 0.00000005 for i in range(1, 3000, 7)] + [-0.0000005, 0.3576375, 0.4563625, 1234567.8912345]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(six(F.col("x"))).collect()]
    assert got == [duckdb.sql(f"select round({x!r}::double, 6)").fetchall()[0][0] for x in values]


def test_persons_are_added_up_as_sql_does(spark):
    """Spatial pairs, to them the sum of other pairs and lone faces, then each lone body, whatever the order of rows."""
    rows = [(1, 1, 1, "spatial", 0.1), (1, 1, 2, "spatial", 0.2), (1, 1, 3, "index", 0.3), (1, 1, 4, "face_only", 0.7), (2, 1, 1, "index", 0.1), (2, 1, 2, "body_only", 0.2), (2, 1, 3, "body_only", 0.3), (3, 1, 1, "spatial", None)]
    want = {1: ((0.1 + 0.2) + (0.3 + 0.7)) / 4, 2: ((0.1 + 0.2) + 0.3) / 3, 3: None}
    assert want[2] != 0.2  # the exact mean
    for some in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(some, "video_id long, frame_id long, creation_seq int, method string, overall double").coalesce(1)
        assert {r["video_id"]: r["overall"] for r in quality.infer_from_persons(df).collect()} == want


def test_categories_are_added_up_as_sql_does(spark):
    """From the last rank to the first, and to that what was lost."""
    from framesift.operators.select_frames import LOST, category_summary

    add = lambda xs: reduce(lambda s, x: s + x, xs, 0.0)  # noqa: E731  (sum() corrects what additions lose)

    def mean(rows):
        some = [[x for *_, o, s, q, x in sorted(rows, key=lambda r: (-r[3], r[4]))[::-1] if (o == LOST) == lost] for lost in (False, True)]
        return (add(some[0]) + add(some[1])) / len(rows)

    plain = lambda xs: add(xs[::-1]) / len(xs)
    r = random.Random(3)
    found = []
    while len(found) < 4:  # groups with a mean at a limit of two digits, which this order puts on the other side
        xs = [r.randint(4000, 15800) for _ in range(40)]
        need = 4000 - sum(xs) % 8000
        xs[0], xs[1] = xs[0] + need // 2, xs[1] + need - need // 2
        if f"{plain([x / 20000 for x in xs]):.2f}" != f"{sum(xs) / 20000 / 40:.2f}":
            found.append([x / 20000 for x in xs])
    rows = [(v, "standing", "selected" if i < 5 else "not_top_ranked", 1 - i / 100, i, x) for v, xs in enumerate(found) for i, x in enumerate(xs)]
    rows += [(9, "standing", LOST if i % 3 == 0 else "not_top_ranked", i % 2 / 2, i, x) for i, x in enumerate(found[0])]
    schema = "video_id long, category string, outcome string, score double, frame_seq int, quality double"
    for some in (rows, rows[::-1]):
        got = {x["video_id"]: x for x in category_summary(spark.createDataFrame(some, schema).coalesce(1), "pose").collect()}
        for v in got:
            want = mean([x for x in rows if x[0] == v])
            assert got[v]["avg_quality"] == want and (v == 9 or f"(average: {want:.2f})" in got[v]["rationale"])
    large = category_summary(spark.createDataFrame(rows, schema), "pose", fold_rows=39).drop("avg_quality", "rationale").collect()
    assert sorted(map(str, large)) == sorted(map(str, category_summary(spark.createDataFrame(rows, schema), "pose").drop("avg_quality", "rationale").collect()))
