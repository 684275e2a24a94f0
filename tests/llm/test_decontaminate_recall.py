"""Recall of benchmark decontamination against brute force over all windows: reworded, reordered and shortened items, and a whole table."""

import os
import random
from itertools import accumulate

import pytest

from framesift.llm import decontaminate, queries
from tests.llm.plain_matching import Plain, Words, common_length, split_words

LARGER = "/root/testdata/sf0.1"


def brute(docs, items, step=8, slack=64):
    """Pairs for which some window of a text has enough of the item in order. Windows with too few of its words are passed over, which is exact."""
    want = set()
    parsed = [Plain(i, t) for i, t in items]
    everywhere = {w for item in parsed for w in item.words}
    for d, text in docs:
        words = split_words(text)
        known = [w in everywhere for w in words]
        if not any(known):
            continue
        for item in parsed:
            n = len(item.words)
            hits = list(accumulate(map(item.known.bits.__contains__, words), initial=0))
            for at in range(0, max(1, len(words)), step):
                end = min(at + n + slack, len(words))
                if hits[end] - hits[at] < 0.5 * n:
                    continue
                if item.found_in(words[at:end]):
                    want.add((d, item.id))
                    break
    return want


def test_the_two_plain_lengths_agree():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randint(1, 20))] for _ in range(2))
        assert Words(a).share_in(b) == common_length(a, b) / len(a)


def paraphrases(r, items, other):
    """Items with words replaced, halves exchanged, and words left out, between other words."""
    docs = []
    for i, text in items:
        words = text.split()
        reworded = [w if r.random() < 0.75 else other() for w in words]
        half = len(words) // 2
        reordered = words[half:] + words[:half]
        shorter = [w for w in words if r.random() < 0.8]
        for k, version in enumerate((reworded, reordered, shorter)):
            docs.append((100_000 + 3 * i + k, " ".join([other() for _ in range(r.randint(0, 120))] + version + [other() for _ in range(r.randint(0, 120))])))
    return docs


def test_paraphrases_are_found_as_by_brute_force(spark):
    r = random.Random(5)
    vocabulary, common = [f"w{k}" for k in range(2000)], [f"c{k}" for k in range(25)]
    word = lambda: r.choice(common) if r.random() < 0.4 else r.choice(vocabulary)
    items = [(i, " ".join(word() for _ in range(r.randint(8, 150))) + ". " + " ".join(word() for _ in range(5))) for i in range(60)] + [(98, " "), (99, " ")]
    docs = [(i, " ".join(word() for _ in range(r.randint(1, 500)))) for i in range(2500)] + paraphrases(r, items[:60], word)
    want = brute(docs, items[:60])
    assert len(want) > 90
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), sample_rows=500).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got}
    assert found <= want and len(found) >= 0.97 * len(want), (len(found), len(want))


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the tables are not here")
def test_recall_of_the_query_on_a_table_ten_times_the_sample(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{LARGER}/documents.parquet").where("doc_id % 4 = 1").select("doc_id", "text").collect()]
    items = [tuple(x) for x in spark.read.parquet(f"{LARGER}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)  # of a quarter of the documents; the query searches them all
    got = {(x["doc_id"], x["item_id"]) for x in queries.op3_decontamination(spark, LARGER).collect()}
    assert {p for p in got if p[0] % 4 == 1} <= want
    assert len(want & got) >= 0.95 * len(want)


def test_rows_are_judged_one_by_one(spark):
    leak = "one two three four five six seven. eight nine"
    rows = [(1, f"a b {leak} c", "p", 1), (1, "other words", "q", 2), (None, leak, "r", 3), (None, "clean", "s", 4), (2, None, "t", 5), (3, "", "u", 6), (4, "clean", "v", 7), (4, "clean", "v", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string, found int")
    bench = spark.createDataFrame([(7, leak)], "item_id long, text string")
    got = sorted(decontaminate.without_contaminated(docs, bench).collect(), key=str)
    assert got == sorted([r for r in docs.collect() if r["found"] not in (1, 3)], key=str)
    assert decontaminate.without_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.without_contaminated(docs.limit(0), bench).count() == 0
