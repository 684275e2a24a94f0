"""Every stage of the pipeline on odd rows: null and repeated ids, repeated rows, null, empty and long texts, clashing columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)
CLASHES = ("n_words", "n_removed", "kept_text", "block", "kept", "row", "root", "s", "score", "quality_score", "item", "found", "component_id", "doc_tokens", "part")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def clean(spark, n=40):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id >= 0").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(n).collect()]


def table(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(c))
    return docs


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(100_000)}" for _ in range(n))


def ran(spark, name, rows):
    docs = table(spark, rows)
    out = STAGES[name](spark, docs, SF)
    if name != "packing":
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{c}` is null or `{c}` <> '{c}'" for c in CLASHES)).count() == 0
    return out.select("doc_id", "text").collect() if name != "packing" else out.collect()


LONG = prose(1, 120_000)
ODD = [(5, prose(2, 60)), (5, prose(3, 60)), (None, prose(4, 60)), (None, prose(4, 60)), (6, prose(5, 60)), (6, prose(5, 60)), (7, None), (8, ""), (9, LONG), (None, None)]
ROWS = [(i, t, None, "s", len(t or "")) for i, t in ODD]


def test_quality_judges_every_row(spark):
    got = ran(spark, "quality classifier", ROWS)
    kept = {(r["doc_id"], r["text"]) for r in got}
    for i, t in set(ODD):
        n = sum((r["doc_id"], r["text"]) == (i, t) for r in got)
        assert n in (0, ODD.count((i, t)))  # equal rows fare alike
    assert kept <= set(ODD)


def test_near_dedup_keeps_one_of_each_and_loses_no_text(spark):
    got = [(r["doc_id"], r["text"]) for r in ran(spark, "near-dedup", ROWS)]
    assert sorted(got, key=str) == sorted({(i, t) for i, t in ODD if (i, t) != (8, "")}, key=str)


def test_substring_dedup_keeps_every_row(spark):
    passage = prose(9, 50)
    rows = [*ROWS, (20, f"{prose(10, 30)} {passage}", None, "s", 1), (21, f"{passage} {prose(11, 30)}", None, "s", 1)]
    got = ran(spark, "substring dedup", rows)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[20] == prose(10, 30) and text[21] == prose(11, 30) and text[9] == LONG and text[7] is None and text[8] == ""
    assert {r["text"] for r in got if r["doc_id"] == 5} == {prose(2, 60), prose(3, 60)}
    assert {r["text"] for r in got if r["doc_id"] == 6} == {""}  # repeated rows take each other's words


def test_decontamination_drops_the_rows_that_leak(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").first()["text"]
    rows = [*ROWS, (5, f"{prose(12, 40)} {leak} {prose(13, 40)}", None, "s", 1), (None, leak, None, "s", 1)]
    got = [(r["doc_id"], r["text"]) for r in ran(spark, "benchmark decontamination", rows)]
    assert sorted(got, key=str) == sorted(ODD, key=str)


def test_packing_packs_every_row(spark):
    got = ran(spark, "packing", ROWS)
    first = [r for r in got if r["start"] == 0]
    assert sorted(str(r["doc_id"]) for r in first) == sorted(str(i) for i, _ in ODD)
    for i in (7, 8, 9):
        part = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in part) == part[0]["doc_tokens"]


@pytest.mark.parametrize("name", list(STAGES))
def test_no_documents(spark, name):
    assert ran(spark, name, []) == []


def test_tables_without_n_chars(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in STAGES["substring dedup"](spark, docs, SF).collect()} == {(1, "a b c"), (2, None)}
