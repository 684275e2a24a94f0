"""The latent basis comes from every document."""

import random

import numpy as np
from pyspark.sql import functions as F

from framesift.llm import decontaminate as d


def brute(texts, row, start):
    """C'C times a matrix, from a dense row of counts for each passage."""
    out = np.zeros_like(start, float)
    for t in texts:
        terms = row[d.term_list(d.tokens(t))]
        for at in range(0, len(terms), d.STRIDE):
            c = np.bincount(terms[at : at + d.PASSAGE], minlength=len(start)).astype(float)
            c[0] = 0
            out += np.outer(c, c @ start)
    return out


def made(seed, n, longest):
    r = random.Random(seed)
    return [" ".join(r.choice(["a", "b", "c"]) if r.random() < 0.3 else f"w{r.randint(0, 300)}" for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_products_of_every_document(spark):
    items = [d.Item(i, t) for i, t in enumerate(made(1, 20, 60)) if t]
    row = d.item_terms(items)
    texts = made(2, 2500, 90) + [None, "", " ".join(made(3, 1, 60_000))]
    scale = d.scales(items, row)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    have, product = d.counted(docs, row, scale, 8, F.lit(True))
    want = brute([t for t in texts if t], row, d.random_matrix(scale, 8))
    assert np.abs(product - want).max() < 1e-4 * np.abs(want).max()
    assert have[0] == len(texts)
    sets = [set(row[d.term_list(d.tokens(t))].tolist()) for t in texts if t]
    assert have[1:].tolist() == [sum(k in s for s in sets) for k in range(1, len(have))]


def test_products_do_not_depend_on_slices():
    items = [d.Item(i, t) for i, t in enumerate(made(4, 9, 60)) if t]
    row = d.item_terms(items)
    layout, start = d.Layout(*d.hashed_terms(made(5, 40, 400))), d.random_matrix(d.scales(items, row), 4)
    found = []
    for strides in (1, 2, 7, 1 << 14):
        found.append(np.zeros(start.shape))
        d.add_products(layout, row, start, found[-1], strides)
    assert all(np.allclose(x, found[0], rtol=1e-4, atol=1e-3) for x in found)


def test_queries_fit_on_all_documents(spark, monkeypatch):
    seen = []
    counted = d.counted
    monkeypatch.setattr(d, "counted", lambda docs, row, scale, rank, fit: seen.append((row, scale, rank, found := counted(docs, row, scale, rank, fit))) or found)
    texts = made(6, 2500, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300)))], "item_id long, text string")
    d.contaminated(docs, bench).count()
    d.without_contaminated(docs, bench).count()
    assert len(seen) == 2
    for row, scale, rank, (_, product) in seen:  # of 2,500 documents, where 1,000 were taken
        want = brute([t for t in texts if t], row, d.random_matrix(scale, rank))
        assert np.abs(product - want).max() < 1e-4 * np.abs(want).max()
