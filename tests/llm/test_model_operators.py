"""Language, quality and toxicity models: held-out accuracy, ties and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import language_id, quality, queries, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = [(9001, None, None), (9002, "", "en"), (9003, "12 !!", "en"), (None, "the of and to", "en"), (9004, "x " * 60000, None), (9004, "x " * 60000, None)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("quality_score", F.lit("clash"))


def test_languages_of_held_out_documents(spark):
    got = queries.op2_language_id(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in language_id.identify(odd(spark), model).collect()}
    assert got == {(9001, True), (9002, True), (9003, True), (None, False), (9004, False)}
    assert language_id.identify(odd(spark).limit(0), model).count() == 0
    nothing = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), nothing).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    got = queries.op6_quality(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_quality_of_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(odd(spark), quality.train(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.score(odd(spark).limit(0), quality.fit(np.zeros((0, 3)), np.zeros(0))).count() == 0
    assert {r["quality_score"] for r in quality.score(odd(spark), quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_flat_trees_agree_with_walking_each_row():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.95
    for row, p in zip(x[:50], model.scores(x[:50])):
        total = model.start
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > c[k])
            total += leaf[k - len(f)]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_toxicity_of_held_out_and_odd_rows(spark):
    """About a tenth of the toxic labels are on texts whose abuse was written over, so recall cannot reach 1."""
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(docs, labels, queries.toxicity_categories(), keep=fold != 0)
    held = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(fold == 0).toPandas()
    assert (held[held["toxic"] == 0]["p_toxic"] >= 0.5).mean() < 0.003
    assert (held[held["toxic"] == 1]["p_toxic"] >= 0.5).mean() > 0.84
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["p_toxic"] <= 1 for r in rows)
    nothing = toxicity.train(docs, labels.limit(0), queries.toxicity_categories())
    assert {r["p_toxic"] for r in toxicity.score(odd(spark), nothing).collect()} == {0.0}


def test_later_models_learn_from_out_of_fold_probabilities():
    """The chain against a plain reference: each row's earlier probability comes from models that never saw its fold."""
    r = np.random.default_rng(2)
    x = (r.random((300, 6)) < 0.4).astype(float)
    first = (x[:, 0] + 0.3 * r.random(300) > 0.9).astype(float)
    second = ((first > 0) & (x[:, 1] > 0)).astype(float)
    fold = np.arange(300) % 4
    weights, earlier = toxicity.fit_chain(x, np.stack([first, second], 1), fold)
    for k in range(4):
        here = fold == k
        alone = toxicity.apply(toxicity.logistic(x[~here], first[~here]), x[here])
        assert np.allclose(earlier[here, 0], alone)
        with_first = np.hstack([x, earlier[:, :1]])
        assert np.allclose(earlier[here, 1], toxicity.apply(toxicity.logistic(with_first[~here], second[~here]), with_first[here]))
    assert np.allclose(weights[1], toxicity.logistic(np.hstack([x, earlier[:, :1]]), second))
    inside = toxicity.apply(weights[0], x)
    assert not np.allclose(inside, earlier[:, 0])  # not the probabilities of the model itself


def test_toxicity_query_on_its_held_out_fold(spark):
    got = queries.op4_toxicity(spark, LARGER).toPandas().merge(spark.read.parquet(f"{LARGER}/labels.parquet").toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 3 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    toxic, said = held["toxic"] == 1, held["predicted"] == 1
    print("held out", len(held), "toxic", toxic.sum(), "recall", said[toxic].mean(), "precision", toxic[said].mean(), "false", said[~toxic].mean())
    assert said[toxic].mean() > 0.85 and toxic[said].mean() > 0.9
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all() and got[["score", "p_unfit", "p_toxic_prose"]].stack().between(0, 1).all()


def test_languages_are_those_of_the_nearest_centroid(spark):
    """The query's predictions against a plain search of all centroids, text by text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op2_language_id(spark, SF).collect():
        counts = language_id.features(texts[r["doc_id"]])
        if counts is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = [np.log1p(float(c)) * float(w) for c, w in zip(counts, model.idf)]
        size = sum(c * c for c in v) ** 0.5
        near = [sum(a * float(b) for a, b in zip(v, c) if a) / size if size else 0.0 for c in model.centroids[:: 1]]
        best = max(near)
        assert r["score"] == pytest.approx(max(0.0, best), abs=1e-4)
        assert r["lang_pred"] in {model.languages[o] for o, s in zip(model.owner, near) if s > best - 1e-4}
