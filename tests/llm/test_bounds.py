"""Bounds that hold whatever the data: many languages, many benchmark items, long white space, ids repeated often, hot responses."""

import pickle
import random
import resource
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from framesift.llm import decontaminate, language_id, packing, quality, toxicity, warc


def test_many_values_of_lang(spark):
    r = random.Random(1)
    rows = [(i, f"{'abcdefghijklmnop'[i % 16] * 3} {i % 3000} " + " ".join(r.choice("xyz") * 2 for _ in range(5)), f"l{i % 3000}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, sample_rows=300, per_language=2, languages=50)
    assert len(model.languages) == 50 and model.languages == sorted(sorted(f"l{i}" for i in range(3000))[:50])  # all are as frequent: the first in order
    assert len(model.centroids) <= 100
    rare = docs.where("doc_id % 3000 < 1").withColumn("lang", F.lit("rare")).limit(1)
    common = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of all the others "), F.col("id").cast("string")).alias("text"), F.lit("common").alias("lang"))
    assert language_id.train(common.unionByName(rare), sample_rows=100).languages == ["common", "rare"]


def test_memory_of_many_items():
    """20,000 items of 200 words: products are cut by the number of targets, and items travel as their texts."""
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(words[k] for k in r.integers(0, len(words), 200)) for _ in range(5000)] * 4
    items = [decontaminate.Item(i, t) for i, t in enumerate(texts)]
    row = decontaminate.item_terms(items)
    basis = r.standard_normal((int(row.max()) + 1, 160)).astype(np.float32)
    targets = decontaminate.Targets(items, row, np.ones(1 << decontaminate.BITS, np.float32), basis)
    sent = pickle.dumps(targets)
    assert len(sent) < 80 << 20 and len(targets.directions) == 120_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    layout = decontaminate.Layout(*decontaminate.hashed_terms([" ".join(words[k] for k in r.integers(0, len(words), 20_000))]))
    assert sum(1 for _ in targets.candidates(layout, 0.9, 0.25)) >= 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kilobytes; all at once would take 600 MB
    again = pickle.loads(sent)
    assert np.array_equal(again.directions, targets.directions) and again.origin == targets.origin


def test_white_space_under_the_switch():
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    began = time.perf_counter()
    text = "a".join(["\n" * 49_000] * 10)
    assert encode(text).tolist() == [*encode.exact(text), 0]
    for n in (9_000, 9_999, 10_000, 20_000):
        text = "x" + " " * n + "y" + "\t" * n
        assert encode(text).tolist() == [*encode.exact(text), 0]
    assert time.perf_counter() - began < 5


def test_ids_repeated_often(spark):
    """A labelled id that documents repeat many times is one row of the sample, and the model does not depend on the order of rows."""
    r = random.Random(2)
    good, bad = "This is a sentence of ordinary prose, with commas. It goes on for a while. ", "$$ 11 22 @@ ## "
    docs = [(i, (good if i % 2 else bad) * r.randint(1, 5)) for i in range(60)] + [(7, f"{good} {k}") for k in range(300)]
    labels = [(i, i % 2, 1 - i % 2) for i in range(60)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = []
    for seed in (1, 2):
        r = random.Random(seed)
        r.shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        trees = quality.train(df, table)
        chain = toxicity.train(df, table, {"toxic": F.col("toxic") == 1})
        found.append((trees.leaf.tolist(), [w.tolist() for w in chain.weights]))
    assert found[0] == found[1]


def test_revisits_of_one_response(spark):
    rows = [(0, "response", "http://a.com/x", 0, '"t"', None, {"etag": '"t"', "x": "1"}, "body")]
    rows += [(i, "revisit", "http://a.com/x", i, '"t"', None, {"x": str(i)}, None) for i in range(1, 3001)]
    rows += [(i, "revisit", "http://a.com/y", i, '"t"', None, None, None) for i in range(4000, 4200)]
    rows += [(5000, "response", "http://b.com/", 1, '"u"', None, {}, None), (5001, "revisit", "http://b.com/", 2, 'W/"u"', None, {}, None), (5002, "revisit", "http://b.com/", 3, '"v"', None, {}, None)]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, payload string")
    got = {r["record_id"]: r for r in warc.resolve(df, span_rows=100).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["outcome"] == "resolved" and got[i]["payload"] == "body" and got[i]["refers_to"] == 0 and got[i]["headers"]["x"] == str(i) for i in range(1, 3001))
    assert {got[i]["outcome"] for i in range(4000, 4200)} == {"orphan"} and got[4000]["headers"] is None
    assert (got[5001]["outcome"], got[5001]["payload"], got[5002]["outcome"], got[5002]["refers_to"]) == ("resolved", None, "mismatch", None)
