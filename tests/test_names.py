"""Numbered names pass over names that are taken, like a loop over the rows."""

import random
import re

from framesift.operators import crops


def plain(names):
    used, counts, out = set(), {}, []
    for name in names:
        found = name
        if name in used:
            stem, tail = re.match(r"(?s)(.+?)(\.[^.]*)?$", name).groups() if "." in name[1:] else (name, "")
            if "." in name[1:]:
                cut = name.rindex(".")
                stem, tail = name[:cut], name[cut:]
            n = counts.get(stem, 0) + 1
            while f"{stem}_{n:03d}{tail or ''}" in used:
                n += 1
            counts[stem] = n
            found = f"{stem}_{n:03d}{tail or ''}"
        used.add(found)
        out.append(found)
    return out


def check(spark, videos, whole=1_000_000):
    rows = [(v, i, n) for v, names in videos.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "video_id long, seq long, name string")
    got = {(r["video_id"], r["seq"]): r["unique_name"] for r in crops.unique_names(df, whole=whole).collect()}
    assert len(got) == len(rows)
    for v, names in videos.items():
        mine = [got[v, i] for i in range(len(names))]
        assert len(set(mine)) == len(mine)
        assert mine == plain(names), (v, names, mine)


def test_stated_cases(spark):
    check(spark, {
        1: ["a.png", "a.png", "a_001.png"], 2: ["a_001.png", "a.png", "a.png"], 3: ["a.png", "a.png", "a.jpg", "a.jpg"], 4: ["a", "a", "a_001", "a_001", "a_001_001"],
        None: ["a.png", "a.png", "a.png"], 5: ["b_002.png", "b.png", "b.png", "b.png"], 6: [], 7: ["x.y.png", "x.y.png"],
    })


def test_random_names(spark):
    rng = random.Random(3)
    pool = ["a.png", "a.jpg", "a_001.png", "a_002.png", "a_001.jpg", "a_001_001.png", "a_000.png", "a_01.png", "b.png", "b_001.png", "c"]
    check(spark, {v: [rng.choice(pool) for _ in range(rng.randrange(1, 25))] for v in range(60)})


def test_videos_larger_than_a_task(spark):
    check(spark, {1: ["a.png", "a.png", "b.png", "a.jpg", "b.png", "a.jpg"], None: ["c", "c", "c"]}, whole=0)


def test_null_names_stay(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, "a_001")], "video_id long, seq long, name string")
    assert {r["seq"]: r["unique_name"] for r in crops.unique_names(df).collect()} == {1: None, 2: None, 3: "a", 4: "a_001", 5: "a_001_001"}
