"""The pipeline's near-dedup stage against brute force over five-word sets."""

import os
import random

import pytest

import corpus_pipeline
from framesift.llm import near_dedup
from framesift.llm.simhash import set_fingerprints

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_pairs(rows):
    sets = sorted((i, shingles(t)) for i, t in rows)
    return [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= 0.8 * len(x | y)]


def planted(seed=3, n=60):
    """Texts, copies of them with one to four words changed, unlike texts with a common passage, odd rows."""
    r = random.Random(seed)
    text = lambda k: [f"w{r.randrange(5000)}" for _ in range(k)]
    rows, passage = [], text(120)
    for i in range(n):
        words = text(r.randint(60, 300))
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 5):
            copy = list(words)
            for at in r.sample(range(len(copy)), k):
                copy[at] = "Other"
            rows.append((10 * i + k, " ".join(copy)))
        rows.append((10 * i + 5, " ".join(passage + text(120))))
    return rows


@pytest.mark.parametrize("bucket", [128, 3])
def test_planted_near_copies_are_caught(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    rows = planted(n=60 if bucket == 128 else 12)
    pairs = brute_pairs(rows)
    want = {i for i, root in roots([i for i, _ in rows], pairs).items() if i == root}
    odd = [(9001, None, "x"), (9002, "", "x"), (9003, "three Words here", "x"), (9004, "Three words here", "x"), (None, rows[0][1], "x"), (None, None, "x")]
    docs = spark.createDataFrame([(*row, "x") for row in rows] + odd, DOC)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(pairs) > 50 and got.count(None) == 2
    kept = {i for i in got if i is not None}
    assert kept >= {9001, 9003} and not kept & {9002, 9004}
    assert kept - {9001, 9003} == want  # every planted near copy is caught, no other text is dropped


def test_no_documents_no_near_copies(spark):
    assert near_dedup.near_copies(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_near_copies_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"]]
    component = {r["doc_id"]: r["component_id"] for r in near_dedup.near_copies(docs).collect()}
    pairs = brute_pairs(rows)
    caught = sum(component[a] == component[b] for a, b in pairs)
    assert caught >= 0.99 * len(pairs), (caught, len(pairs))


@pytest.mark.parametrize("levels", [near_dedup.LEVELS, near_dedup.LEVELS[:1]])
def test_a_large_group_of_short_variants(spark, monkeypatch, levels):
    """Many texts that share most words but are no near copies of each other, with a few that are: rows must not grow with pairs."""
    monkeypatch.setattr(near_dedup, "BUCKET", 16)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)  # with one level all large buckets are compared in blocks
    r = random.Random(9)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in r.sample(range(40), 1 if i % 4 else 0):
            words[at] = f"v{r.randrange(3)}"
        rows.append((i, " ".join(words + [f"t{i % 90}"] * (i % 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = roots([i for i, _ in rows], brute_pairs(rows))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_copies(docs).collect()}
    pairs = brute_pairs(rows)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.999 * len(pairs)
    assert all(want[a] == want[got[a]] for a in got)  # nothing is joined that brute force does not join


@pytest.mark.parametrize("common", [30, 80])
def test_sets_of_large_buckets_meet_in_blocks(spark, monkeypatch, common):
    """Any two sets of a bucket with different roots meet in a group, no group is much larger than BUCKET, and a large component costs few copies."""
    monkeypatch.setattr(near_dedup, "BUCKET", 8)
    rows = [(s, 10, 0 if s < common else s, key) for key in (1, 2) for s in range(100)]
    got = near_dedup._blocks(spark.createDataFrame(rows, "s long, size long, root long, key long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["b"], []).append(r["s"])
    met = {(x, y) for members in groups.values() for x in members for y in members}
    assert all((x, y) in met for x in range(100) for y in range(max(common, x + 1), 100))
    assert max(map(len, groups.values())) <= 20
    copies = {s: sum(r["s"] == s for r in got) / 2 for s in (0, 99)}
    assert copies[0] == -(-(100 - common) // 4) and copies[99] == -(-common // 4) + copies[0] - 1


def test_every_pair_within_the_radius_meets_in_a_table():
    """The stage's SimHash step: sets whose fingerprints differ in up to RADIUS bits share a covering table's key, unlike ones share none."""
    r = random.Random(2)
    texts = []
    for _ in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(1500)]
        texts += [" ".join(words), " ".join(words[:700] + ["Other"] + words[701:])]
    sets = near_dedup.shingle_sets(texts, 5)
    fps, keys = set_fingerprints(sets).view("u8"), near_dedup.table_keys(sets)
    for fp, hashes in zip(fps[:4].tolist(), sets):
        assert fp == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes.tolist()) > len(hashes))
    near = 0
    for a in range(80):
        for b in range(a):
            differ = (int(fps[a]) ^ int(fps[b])).bit_count()
            meet = bool((keys[a] == keys[b]).any())
            near += differ <= near_dedup.RADIUS
            assert meet if differ <= near_dedup.RADIUS else differ < 30 or not meet
    assert near >= 20
    assert not near_dedup.table_keys(near_dedup.shingle_sets([None, ""], 5)).any()


def test_rows_have_keys_of_simhash_tables_and_of_bands(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "row long, text string")
    sets = near_dedup.shingle_sets(["one two three four five six", None], 5)
    got = {r["row"]: r["keys"] for r in near_dedup._marked(docs, 5).collect()}
    for row, tables, bands in zip((1, 2), near_dedup.table_keys(sets).tolist(), near_dedup.band_keys(sets).tolist()):
        assert got[row] == tables + bands
