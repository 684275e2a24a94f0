"""Short and half-paraphrased items among rare words, against brute force over every window of every document."""

import random

from framesift.llm import decontaminate
from tests.llm.plain_matching import Plain, split_words


def brute(docs, items):
    want = set()
    for i, text in items:
        item = Plain(i, text)
        n = len(item.words)
        for d, t in docs:
            w = split_words(t)
            for at in range(0, max(1, len(w)), 8):
                if item.found_in(w[at : at + n + 64]):
                    want.add((d, i))
    return want


def test_short_and_half_paraphrased_items_in_rare_words(spark):
    r = random.Random(11)
    plain, rare = [f"c{k}" for k in range(300)], iter(range(10**6))
    unlike = lambda n: [f"rare{next(rare)}x" for _ in range(n)]
    items = [(i, " ".join(r.sample(plain, r.randint(6, 9))) + ". " + " ".join(r.sample(plain, 3))) for i in range(20)]
    docs = [(i, " ".join(unlike(60) + r.choices(plain, k=20) + unlike(60))) for i in range(200)]
    for i, text in items:
        words = text.split()
        if i % 2:  # half of the question in other words, the answer as it is
            words = [w if k >= len(words) - 3 or k % 2 else unlike(1)[0] for k, w in enumerate(words)]
        docs.append((1000 + i, " ".join(unlike(90) + words + unlike(90))))
    want = brute(docs, items)
    assert {(1000 + i, i) for i in range(20)} <= want
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
