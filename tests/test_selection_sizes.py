"""The two forms of greedy selection and of claiming give the rows of a plain loop, for null keys and times, ties and large k."""

import random

from pyspark.sql import functions as F

from framesift.operators import select_core, select_frames

GAP = 2.0


def plain(rows, k):
    """rows: (seq, score, t). Outcome and pick of each seq."""
    picked, out = [], {}
    for seq, _, t in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])):
        near = t is not None and any(p is not None and abs(t - p) < GAP for p in picked)
        if len(picked) >= k:
            out[seq] = ("not_top_ranked", None)
        elif near:
            out[seq] = ("rejected_insufficient_diversity", None)
        else:
            picked.append(t)
            out[seq] = ("selected", len(picked))
    return out


def made(seed, n, videos):
    rng = random.Random(seed)
    score = lambda: rng.choice([None, 0.1, 0.5, 0.9, rng.random()])
    return [(rng.choice(videos), rng.choice(["a", None]), i, score(), rng.choice([None, float(rng.randrange(60)), rng.random() * 60])) for i in range(n)]


def test_forms_agree_with_a_loop(spark):
    for seed, k in ((1, 3), (2, 200)):
        rows = made(seed, 300, [1, 2, None])
        df = spark.createDataFrame(rows, "video_id long, category string, seq long, score double, t double")
        want = {}
        for key in {r[:2] for r in rows}:
            want |= plain([r[2:] for r in rows if r[:2] == key], k)
        for form in (select_core.fold, select_core.rounds):
            got = form(df, ["video_id", "category"], "score", "t", "seq", F.lit(k), GAP).collect()
            assert {r["seq"]: (r["outcome"], r["pick"]) for r in got} == want, (form, k)
        got = select_core.diverse_topk(df, ["video_id", "category"], "score", "t", "seq", k, GAP, fold_rows=60).collect()
        assert {r["seq"]: (r["outcome"], r["pick"]) for r in got} == want


def test_few_passes_over_a_large_group(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("v"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(99991)) / 1e5).alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000_000)) / 100.0).alias("t"))
    trace = []
    got = select_core.rounds(df, ["v"], "score", "t", "seq", F.lit(200), GAP, trace=trace).where("outcome = 'selected'").count()
    assert got == 200 and len(trace) <= 8, trace


def test_claims_agree_with_a_loop(spark):
    rng = random.Random(7)
    rows = []
    for video in (1, 2, None):
        for frame in range(40):
            for category in rng.sample(["standing", "sitting", "squatting", "closeup"], rng.randrange(1, 4)):
                rows.append((video, frame, frame, rng.choice([None, float(rng.randrange(40))]), category, rng.choice([None, 0.5, rng.random()])))
    df = spark.createDataFrame(rows, "video_id long, frame_id long, frame_seq long, t_sec double, category string, score double")
    want = {}
    for video in (1, 2, None):
        mine = [r for r in rows if r[0] == video]
        order = sorted({r[4] for r in mine}, key=lambda c: (min(r[2] for r in mine if r[4] == c), select_frames.POSES.index(c)))
        taken = set()
        for c in order:
            found = plain([(r[2], r[5], r[3]) for r in mine if r[4] == c and r[1] not in taken], 3)
            want |= {(video, r[1], c): ("lost_to_higher_priority", None) for r in mine if r[4] == c and r[1] in taken}
            want |= {(video, frame, c): x for frame, x in found.items()}
            taken |= {frame for frame, x in found.items() if x[0] == "selected"}
    for fold_rows in (1000, 0):
        got = select_frames.claim(df, 3, GAP, fold_rows=fold_rows).collect()
        assert {(r["video_id"], r["frame_id"], r["category"]): (r["outcome"], r["pick"]) for r in got} == want, fold_rows


def test_picks_meet_small_groups_once(spark, monkeypatch):
    held = spark.range(100).select(F.struct("id").alias("g"), F.struct("id").alias("o"), F.lit(1.0).alias("t"))
    hot = spark.range(1).select(F.struct("id").alias("g"), F.lit(True).alias("hot"))
    assert select_core._salted(held, hot).count() == 99 + select_core.SALTS
    df = spark.createDataFrame(made(3, 300, [1, 2, None]), "video_id long, category string, seq long, score double, t double")
    outcomes = []
    for rows in (1000, 20):
        monkeypatch.setattr(select_core, "HOT", rows)
        outcomes.append({r["seq"]: (r["outcome"], r["pick"]) for r in select_core.rounds(df, ["video_id", "category"], "score", "t", "seq", F.lit(3), GAP).collect()})
    assert outcomes[0] == outcomes[1]
