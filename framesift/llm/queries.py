"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import decontaminate, language_id, packing, quality, toxicity, url_filter, warc
from framesift.llm.common import crc_fold
from framesift.llm.line_dedup import drop_repeated_lines
from framesift.llm.periodic_runs import looped, periodic_runs
from framesift.llm.simhash import near_duplicates
from framesift.llm.substring_dedup import remove_repeats
from framesift.llm.token_alignment import align
from framesift.llm.topk import top_k

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def vocabulary(*names: str) -> tuple[str, ...]:
    """Tokenizer files, by default those of the packing vocabulary (for `tokenizers` and as ranks), in FRAMESIFT_TOKENIZERS or where the public tokenizers are installed."""
    folder, names = os.environ.get("FRAMESIFT_TOKENIZERS"), names or ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return tuple(f"{folder}/{n}" if folder else public_tokenizers.path(n) for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, crc_fold("doc_id", 4) != 2)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", quality.held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxicity_categories() -> dict[str, object]:
    """Categories of the chain, in order, from the label columns."""
    toxic = F.col("toxic") == 1
    return {"unfit": toxic | (F.col("quality") == 0), "toxic": toxic, "toxic_prose": toxic & (F.col("quality") == 1)}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, toxicity_categories(), keep=crc_fold("doc_id", 5) != 3)
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", quality.held_out(5, 3).alias("held_out"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"), "p_unfit", "p_toxic_prose")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary(), window=1024)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, keep=crc_fold("doc_id", 3) != 1)
    found = quality.score(docs.select("doc_id", "text"), model)
    score = F.col("quality_score")
    return found.select("doc_id", quality.held_out(3, 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit(": "), e["value"])))
    return found.select("record_id", "kind", "url_key", "outcome", "refers_to", F.md5("payload").alias("payload"), F.array_join(lines, "\n").alias("headers"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), change=("doc_id", looped))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *vocabulary(), *vocabulary("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_language_id, op3_decontamination, op4_toxicity, op5_packing,
        op6_quality, op7_topk, op8_warc_revisits, op9_url_filters, op10_simhash_near_dedup,
        op11_periodic_runs, op12_line_dedup, op13_token_alignment,
    )
}

_UPPER_LOWER = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select r, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
        k as (select s.r, s.i, sha256(array_to_string(d.w[s.i:s.i + 34], ' ')) as h from s join d using (r)),
        rep as (select r, i from k where h in (select h from k group by h having count(*) > 1)),
        gone as (select distinct r, unnest(range(i, i + 35)) as p from rep),
        cut as (select r, list(p) as ps, count(*) as n from gone group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
            sha256(array_to_string(list_filter(w, lambda x, p: not list_contains(coalesce(ps, []), p)), ' ')) as kept_sha256
        from d left join cut using (r)""",
    "op7_topk": """
        with v as (select vec_id, list_transform(embedding, lambda e: cast(floor(1024 * cast(e as double)) as bigint)) as x from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
        p as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as bigint) as score
            from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.x) = len(q.x)),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p)
        select query_id, rank, vec_id, score from r where rank <= 10""",
    "op8_warc_revisits": """
        with p as (select page_id, url, md5(coalesce(html, '')) as digest, octet_length(encode(coalesce(html, ''))) as n from pages),
        r as (
            select 2 * page_id as record_id, 'response' as kind, url, page_id as ts, '"' || digest || '"' as etag, digest, n, '0' as expires from p
            union all
            select 2 * page_id + 1, 'revisit', url || case when contains(url, '#') then '' when contains(url, '?') then '&utm_source=again' else '?utm_source=again' end, page_id + 1000000,
                case when page_id % 10 = 0 then '"changed"' else '"' || digest || '"' end, null, 0, case when page_id % 6 = 0 then '600' else '0' end from p where page_id % 2 = 0),
        a as (select *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as rest from r),
        b as (select *, regexp_extract(rest, '^([^?]*)', 1) as address, list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: not starts_with(x, 'utm_') and x <> '')) as query from a),
        c as (select record_id, kind, ts, etag, digest, n, expires,
            regexp_replace(lower(regexp_extract(address, '^([^/]*)', 1)), '^www\\.|:(?:80|443)$', '', 'g') || regexp_replace(regexp_extract(address, '^[^/]*(.*)$', 1), '/+$', '')
            || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end as url_key from b),
        f as (select * from c where kind = 'response'),
        m as (select c.*, (select max(f.ts) from f where f.url_key = c.url_key and f.ts < c.ts) as base_ts from c),
        j as (select m.*, f.record_id as base_id, f.etag as base_etag, f.digest as base_digest, f.n as base_n from m left join f on m.kind = 'revisit' and f.url_key = m.url_key and f.ts = m.base_ts),
        o as (select *, case when kind = 'response' then 'response' when base_id is null then 'orphan' when base_etag = etag then 'resolved' else 'mismatch' end as outcome from j)
        select record_id, kind, url_key, outcome, case when outcome = 'resolved' then base_id end as refers_to,
            case when kind = 'response' then digest when outcome = 'resolved' then base_digest end as payload,
            case when kind = 'response' or outcome = 'resolved' then
                'content-length: ' || case when kind = 'response' then n else base_n end || chr(10) || 'content-type: text/html' || chr(10)
                || 'etag: ' || case when kind = 'revisit' then 'W/' else '' end || etag || chr(10) || 'expires: ' || expires
            else 'content-length: 0' || chr(10) || 'etag: ' || case when etag = '"changed"' then '' else 'W/' end || etag || chr(10) || 'expires: ' || expires end as headers
        from o""".replace("\\\\", "\\"),
    "op9_url_filters": f"""
        with a as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from a),
        c as (select page_id, translate(h, {_UPPER_LOWER}) as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
        r(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        m as (select c.page_id, c.host, c.path, max_by({{'rule': rhost || rpath, 'verdict': verdict}}, length(rhost) + length(rpath)) as best
            from c join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all)
        select c.page_id, c.host, c.path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from c left join m using (page_id, host, path)""",
    "op12_line_dedup": f"""
        with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        u as (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from d),
        l as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UPPER_LOWER}) as k from u),
        h as (select distinct r, doc_id, k from l where length(k) >= 40),
        f as (select k, max(doc_id) as keeper from h group by k having count(*) >= 5),
        j as (select l.*, coalesce(keeper is not null and (doc_id is null or doc_id < keeper), false) as gone from l left join f using (k))
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
        from j group by r, doc_id""",
}
