"""Top-k search, WARC revisits, URL filters and the pipeline against brute force and SQL, with odd rows."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm import queries, topk, url_filter, warc
from tests.test_oracles import SF, TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.integers(-3, 4, size=(300, 6)).astype(float) / 64
    data = [(i, [float(v) for v in row], "x") for i, row in enumerate(x)]
    data += [(400, None, "x"), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (600, [float("nan")] * 6, "x"), (700, [float("inf")] * 6, "x"), (None, [0.0] * 6, "x"), (800, [1.0, 2.0], "x"), (5, data[5][1], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank string")
    got = {}
    for row in topk.top_k(df, F.col("vec_id") % 100 == 0, k=7, shard=64, block=2).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    q = np.floor(1024 * x).astype(np.int64)
    assert set(got) == {0, 100, 200}
    for i in got:
        score = q @ q[i]
        want = sorted((j for j in range(300) if j != i), key=lambda j: (-score[j], j))[:7]
        assert [got[i][k] for k in range(1, 8)] == [(j, int(score[j])) for j in want]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_threshold_stops_early_and_is_exact():
    r = np.random.default_rng(4)
    x = (r.pareto(1.5, size=(5000, 3)) * 100).astype(np.int64)
    lists, ids = np.argsort(x, axis=0, kind="stable").T, np.arange(5000)
    q = np.array([5, 1, 0])
    found, score = topk.threshold_topk(q, ids, x, lists, -1, 10)
    want = sorted(range(5000), key=lambda j: (-int(x[j] @ q), j))[:10]
    assert found.tolist() == want


RECORDS = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, payload string, base string"


def test_revisits(spark):
    h = {"Content-Length": "5", "ETag": '"a"', "X": "1"}
    data = [
        (1, "response", "http://www.A.com/p/?utm_x=1&b=2", 10, '"a"', None, h, "one", "z"),
        (2, "response", "https://a.com:443/p?b=2", 20, '"b"', "Mon", h, "two", "z"),
        (3, "revisit", "a.com/p?b=2#f", 30, 'W/"b"', None, {"x": "2", "content-length": "0"}, None, "z"),
        (4, "revisit", "a.com/p?b=2", 20, '"a"', None, None, None, "z"),
        (5, "revisit", "a.com/p?b=2", 15, '"q"', None, None, None, "z"),
        (6, "revisit", "a.com/p?b=2", 40, None, "Mon", None, None, "z"),
        (7, "revisit", "a.com/p?b=2", 41, None, None, None, None, "z"),
        (8, "revisit", "a.com/p?b=2", 5, '"a"', None, None, None, "z"),
        (9, "revisit", None, 50, '"a"', None, None, None, "z"),
        (10, "revisit", "a.com/p?b=2", None, '"a"', None, None, None, "z"),
        (11, "metadata", "a.com/p?b=2", 60, None, None, None, None, "z"),
        (12, "response", "a.com/p?b=2", 20, '"b2"', None, None, "tie", "z"),
        (13, "revisit", "a.com/p?b=2", 21, '"b2"', None, None, None, "z"),
    ]
    for buckets in (1, 1024):
        got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(data, RECORDS), buckets).collect()}
        assert {i: (r["outcome"], r["refers_to"]) for i, r in got.items() if r["kind"] == "revisit"} == {
            3: ("mismatch", None), 4: ("resolved", 1), 5: ("mismatch", None), 6: ("unverified", None), 7: ("unverified", None), 8: ("orphan", None), 9: ("orphan", None), 10: ("orphan", None), 13: ("resolved", 12),
        }
        assert got[4]["headers"] == {"content-length": "5", "etag": '"a"', "x": "1"} and got[4]["payload"] == "one"
    merged = spark.createDataFrame([(h, {"x": "2", "Content-Length": "0", "Date": "d"})], "a map<string,string>, b map<string,string>").select(warc.merged(F.col("a"), F.col("b"))).first()[0]
    assert merged == {"content-length": "5", "etag": '"a"', "x": "2", "date": "d"}
    assert warc.resolve(spark.createDataFrame([], RECORDS)).count() == 0


URLS = ["http://www.Example.com/en/1?x#y", "https://example.com/en/", "https://a.example.com/en", "http://b.net/es/x", "http://net/fr/", "http://knet/es/x", "HTTP://example.org/a", "nothing", "", None, "x://example.com", "http://EXAMPLE.com?/en/", "http://a.net/ES/", "http://example.com/en/é"]


def judged(host, path, rules=queries.URL_RULES):
    fit = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, "allow")


@pytest.mark.parametrize("inline", [1000, 0])
def test_url_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE", inline)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")], "page_id long, url string, verdict string")
    got = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == judged(host, path)
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize("inline", [1000, 0])
def test_rules_without_a_token_and_clashing_columns(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE", inline)
    rules = [("block", "", "/x"), ("block", "com", "/"), ("allow", "a.com", "/en")]
    hosts = ["", "b.", "a.com", "b.a.com", *[f"h{i}.com" for i in range(200)], "a.org"]
    pages = spark.createDataFrame([(f"http://{h}{p}", "mine", 7, "t") for h in hosts for p in ("/xy", "/en/1")], "url string, _best string, salt int, token string")
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == 2 * len(hosts)
    for r in got:
        assert (r["rule"], r["verdict"]) == judged(r["host"], r["path"], rules)
        assert (r["_best"], r["salt"], r["token"]) == ("mine", 7, "t")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns, name
            ids = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert 0 < len(ids) <= before
            if i == 0:
                kept = [labels[d] for d in ids if d in labels.index]
                assert np.mean(kept) > 0.98
            docs = out.cache()
            before = len(ids)
        else:
            assert set(r["doc_id"] for r in out.select("doc_id").distinct().collect()) == ids


def test_topk_with_repeated_ids_as_by_sql(spark, tmp_path):
    """Rows that share an id, alike or not, are candidates each; queries may share an id too."""
    r = np.random.default_rng(8)
    data = [(i % 150, [float(v) for v in row]) for i, row in enumerate(r.integers(-3, 4, size=(400, 5)) / 32)]
    data += [(7, data[7][1])] * 30 + [(100, data[100][1])] * 2
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = rows(con.sql(queries.ORACLE_SQL["op7_topk"]).df())
    for shard in (16, 8192):
        got = topk.top_k(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), F.col("vec_id") % 100 == 0, shard=shard, block=3)
        assert rows(got.toPandas()) == want


def test_revisits_of_a_url_in_many_spans(spark):
    """A URL with most captures, an outlying time, repeated times: as with one span."""
    data = [(i, "response" if i % 3 == 0 else "revisit", "a.com/hot" if i % 5 else f"a.com/{i % 7}", 10**12 if i == 299 else i // 2, f'"{i // 9}"', None, {"n": str(i)}, f"p{i}") for i in range(300)]
    records = spark.createDataFrame(data, RECORDS.rsplit(",", 1)[0])
    once, often = (sorted(map(str, warc.resolve(records, n).collect())) for n in (10**6, 7))
    assert once == often and len(once) == 300
    assert sum("resolved" in x for x in once) > 50


def test_rows_that_repeat_a_response(spark):
    data = [(1, "response", "a.com/x", 1, '"t"', None, {"h": "1"}, "body")] * 3 + [(2, "revisit", "a.com/x", 2, '"t"', None, None, None)] * 2
    got = warc.resolve(spark.createDataFrame(data, RECORDS.rsplit(",", 1)[0])).collect()
    assert len(got) == 5 and [r["payload"] for r in got] == ["body"] * 5
