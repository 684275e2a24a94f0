"""Substring dedup, SimHash groups, decontamination and packing against brute force, with odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from framesift.llm import decontaminate, packing, queries, simhash
from framesift.llm.substring_dedup import remove_repeats

DOC = "doc_id long, text string, n_removed string, fp string"
TOKENIZERS = "/opt/tokenizers"


def some_docs(seed=1, n=60):
    """Words of a small vocabulary, shared passages, copies, nulls, empty and long texts, repeated rows, clashing columns."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=60))
    docs = []
    for i in range(n):
        text = " ".join(r.choices(vocabulary, k=r.randint(1, 90)))
        if i % 5 == 0:
            text += "\n" + passage + "\t " + " ".join(r.choices(vocabulary, k=10))
        if i % 11 == 0 and docs:
            text = docs[-1][1]
        docs.append((i, text, "x", "y"))
    docs += [(100, None, "x", None), (101, "", None, "y"), (102, " \n\t ", "x", "y"), (103, "same " * 5000, "x", "y"), (103, "same " * 5000, "x", "y"), (None, passage, "x", "y"), (104, "é\x0bà\x1fb", "x", "y")]
    return docs


def brute_removal(docs, width):
    split = [t.encode().split() if t else [] for _, t, *_ in docs]
    count = Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
    out = []
    for (i, *_), w in zip(docs, split):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out



@pytest.mark.parametrize("block_bytes", [1 << 22, 2000])
def test_repeats_are_removed_as_by_brute_force(spark, block_bytes):
    docs = some_docs()
    got = remove_repeats(spark.createDataFrame(docs, DOC), width=7, block_bytes=block_bytes).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, str(r))) == sorted(brute_removal(docs, 7), key=lambda r: (r[0] is None, str(r)))


def test_no_documents_no_rows(spark):
    empty = spark.createDataFrame([], DOC)
    assert remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert packing.pack(empty, f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contaminated(empty, bench).count() == 0


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not lowered:
        return 0
    parts = [b" ".join(lowered[k : k + 3]) for k in range(max(1, len(lowered) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    docs = some_docs(2)
    r = random.Random(3)
    base = docs[0][1].split() * 4
    for i in range(200, 230):
        copy = list(base)
        copy[r.randrange(len(copy))] = "Other"
        docs.append((i, " ".join(copy), "x", "y"))
    got = simhash.near_duplicates(spark.createDataFrame(docs, DOC)).collect()
    want = {(i, brute_fingerprint(t)) for i, t, *_ in docs}
    assert {(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got} == want
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == brute_components([(i, f) for i, f in want if i is not None])


def brute_components(rows, radius=2):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, fa in rows:
        for b, fb in rows:
            if a < b and (fa ^ fb).bit_count() <= radius and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_within_the_radius_collides(radius):
    r = random.Random(radius)
    tables = simhash.masks(list(range(64)), radius)
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(range(64), radius))
        assert any(m & flips == 0 for m in tables)


def test_large_buckets_are_keyed_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(3)]
    fps = {s ^ sum(1 << b for b in r.sample(range(24), r.randint(0, 4))) for s in seeds for _ in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = [(e["u"], e["v"]) for e in simhash.links(rows, 2).collect()]
    ids = sorted(map(signed, fps))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 64
        x, y = find(u), find(v)
        parent[max(x, y)] = min(x, y)
    want = brute_components([(i, i & (1 << 64) - 1) for i in ids])
    assert {i: find(i) for i in ids} == want


def test_benchmark_passages_are_found_and_clean_documents_left(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = [f"c{i}" for i in range(20)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(15, 58)) + ". " + text(6)) for i in range(30)] + [(98, None), (99, "")]
    docs = [(i, text(r.randint(5, 400)), "x", "y") for i in range(120)]
    want = set()
    for i in range(0, 30):
        words = items[i][1].split()
        if i % 3 == 2:
            words = [w for k, w in enumerate(words) if k % 6 != 5]
        elif i % 3 == 1:
            words = [w.upper() for w in words]
        docs.append((1000 + i, f"{text(r.randint(0, 150))}\n{' '.join(words)} {text(r.randint(0, 150))}", "x", "y"))
        want.add((1000 + i, i))
    docs += [(2000, None, "x", "y"), (2001, "", "x", "y"), (None, items[0][1], "x", "y")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(None, 0)}


def test_lcs():
    length = lambda a, b: decontaminate.lcs(len(a), decontaminate.places(a), b)
    assert length(b"a b c d e".split(), b"x a c y d e e".split()) == 4
    assert length([b"a"] * 70, [b"a"] * 50) == 50


def test_pieces_cover_every_id_once(spark):
    from tokenizers import Tokenizer

    docs = some_docs(4, 150) + [(300, "a  b\n\n c　d <|endoftext|> it's", "x", "y"), (301, "word " * 3000, "x", "y")]
    docs = [(d if d is not None else -1, *rest) for d, *rest in {d[0]: d for d in docs}.values()]
    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t, *_ in docs}
    rows = packing.pack(spark.createDataFrame(docs, DOC), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", window=256, shard_rows=40, rows_per_task=50).toPandas()
    for d, part in rows.groupby("doc_id"):
        part = part.sort_values("start")
        assert part["start"].tolist() == np.concatenate([[0], np.cumsum(part["length"])[:-1]]).tolist() and part["length"].sum() == len(ids[d]) == part["doc_tokens"].iloc[0]
        for r in part.itertuples():
            assert zlib.crc32(ids[d][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(rows["doc_id"]) == set(ids)
    waste = 0
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == np.concatenate([[0], np.cumsum(part["length"])[:-1]]).tolist()
        n = int(part["length"].sum())
        assert n <= 256
        waste += 0 if n & (n - 1) == 0 else 256 - n
    assert waste == 0


def test_neighbours_rank_by_bm25():
    tails = [np.array(x, "<u2") for x in ([5, 5, 6, 7], [5, 9, 9, 9], [8, 8, 8, 8], [5, 5, 5, 6])]
    idf = np.ones(1 << 16)
    idf[[5, 6, 7]] = [1.0, 2.0, 3.0]
    shard = packing.Shard(tails, idf, 4.0)
    assert shard.neighbours(0, 3, np.array([False, True, True, True])).tolist() == [3, 1]




@pytest.mark.parametrize("text", [" " * 1_000_000, "\n \t" * 300_000 + "x", "x" + " " * 800_000 + "y", "a" * 1_000_000, "漢字" * 200_000], ids=["spaces", "mixed", "inside", "letters", "signs"])
def test_very_long_runs_are_packed(spark, text):
    from tokenizers import Tokenizer

    want = np.array(Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json").encode(text, add_special_tokens=False).ids + [0], "<u4")
    docs = spark.createDataFrame([(1, text), (2, "plain words")], "doc_id long, text string")
    rows = [r for r in packing.pack(docs, *queries.vocabulary()).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in rows) == len(want) == rows[0]["doc_tokens"]
    assert all(r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)
