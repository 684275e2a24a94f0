"""op11 to op13 against brute force: runs by definition, lines by counting, pairs by plain tokenization."""

import hashlib
import os
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framesift.llm import line_dedup, periodic_runs, queries, token_alignment

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


# op11


def plain_runs(w, least=6, power=4):
    """By definition: for each period the maximal stretches, and of one stretch the smallest period."""
    n, found = len(w), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, power * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(500):
        docs = []
        for _ in range(r.randint(1, 4)):
            n, k = r.randint(0, 60), r.randint(1, 4)
            w = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.6:
                a, p = r.randrange(n), 1 + r.randrange(max(1, n // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        assert periodic_runs.find_runs(docs) == [plain_runs(w) for w in docs]


def test_runs_of_long_words():
    r = random.Random(2)
    for w in ([0] * 5000, [i % 7 for i in range(5000)], [0, 1, 0, 0, 1] * 800 + [1] * 9, [r.randrange(2) for _ in range(3000)], [k for i in range(500) for k in [i] * 6], [1] * 5):
        assert periodic_runs.find_runs([w]) == [plain_runs(w)]
    assert periodic_runs.find_runs([]) == [] and periodic_runs.find_runs([[], [1]]) == [[], []]


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@here
def test_op11_is_what_brute_force_gives(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == plain_row(r["doc_id"], docs[r["doc_id"]])
    assert sum(r["n_runs"] > 0 for r in got) > 3


def test_runs_of_odd_rows(spark):
    rows = [(None, "a " * 9), (1, None), (2, ""), (3, " \t\n"), (3, "x y " * 6), (3, "x y " * 6), (4, "b " * 5), (5, "p q p q " * 4), (6, "w " * 300_000)]
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, n_runs int, start string")
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["n_words"], r["n_runs"], r["start"], r["length"], r["period"], len(r["collapsed_text"])) for r in periodic_runs.periodic_runs(df, carry=("doc_id", "n_runs"), batch_words=20).collect()), key=str)
    assert got == sorted([
        (False, None, 9, 1, 0, 9, 1, 1), (True, 1, 0, 0, None, None, None, 0), (True, 2, 0, 0, None, None, None, 0), (True, 3, 0, 0, None, None, None, 0), (True, 3, 12, 1, 0, 12, 2, 3), (True, 3, 12, 1, 0, 12, 2, 3),
        (True, 4, 5, 0, None, None, None, 9), (True, 5, 8, 1, 0, 8, 1, 3), (True, 6, 300_000, 1, 0, 300_000, 1, 1),
    ], key=str)
    assert periodic_runs.periodic_runs(df.where("false")).isEmpty()
    whole = periodic_runs.periodic_runs(df.where("doc_id = 4"), carry=("text", "doc_id")).first()
    assert whole["text"] == "b " * 5 and whole["runs"] == [] and whole["runs_sha256"] == sha("")


# op12


def plain_lines(rows, least=40, documents=5):
    def key(line):
        k = line.strip(" \t\n\v\f\r")
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= least else None

    holders = {}
    for at, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            holders.setdefault(k, []).append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if keeper.get(key(x)) is None or (i is not None and i >= keeper[key(x)])]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def made_lines(seed, n):
    r = random.Random(seed)
    pool = ["common LINE of more than forty characters %d" % k for k in range(8)] + ["é" * 39, "é" * 40, "É" * 20, "x" * 39, "y" * 40, "", "  ", " " + "z" * 39]
    rows = []
    for _ in range(n):
        lines = [r.choice(["", " ", "\t", "\r"]) + r.choice([str.upper, str.lower, str])(r.choice(pool)) + r.choice(["", " ", "\x0b\x0c"]) for _ in range(r.randint(0, 6))]
        rows.append((r.choice([None, r.randrange(40)]), r.choice([None, "\n".join(lines), "\n".join(lines)])))
    return rows


def test_lines_of_random_rows(spark):
    for seed, batches, fan_in, hot in ((1, 1, 4, 1000), (2, 3, 2, 3)):
        rows = made_lines(seed, 120)
        df = spark.createDataFrame([(*row, "c", 1) for row in rows], "doc_id long, text string, key string, n_lines int")
        got = line_dedup.drop_repeated_lines(df, carry=("doc_id", "key", "n_lines"), batches=batches, fan_in=fan_in, hot=hot).collect()
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=str) == sorted(plain_lines(rows), key=str)
        assert {r["key"] for r in got} == {"c"}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("framesift_lines")]


def test_lines_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], schema), batches=1).isEmpty()
    long = "\n".join(["the same long line of text in very many documents " * 2] * 3 + [f"line {i} of a very long text that nothing repeats" for i in range(60_000)])
    rows = [(i, "the same long line of text in very many documents " * 2 + "\r") for i in range(6)] + [(99, long), (99, long)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, schema), carry=("doc_id", "text"), batches=2).collect()
    assert sorted((r["doc_id"], r["n_dropped"], r["n_lines"]) for r in got) == [*[(i, 1, 1) for i in range(6)], (99, 0, 60_003), (99, 0, 60_003)]
    assert all(r["kept_text"] == (long if r["doc_id"] == 99 else "") for r in got)


def test_runs_levels(spark):
    """Compaction keeps a key once, and every batch finds what those before it held."""
    lines = spark.createDataFrame([(bytes([k % 50]) * 16, k, k % 4) for k in range(400)], "key binary, id long, batch int")
    runs = line_dedup.LineRuns(spark, 2)
    for b in range(4):
        runs.add(lines.where(F.col("batch") == b))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    got = {bytes(r["key"]): (r["n"], r["keeper"]) for r in runs.counts().collect()}
    assert got == {bytes([k]) * 16: (8, 350 + k) for k in range(50)}
    runs.close()


# op13


def plain_alignment(rows, files):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[2])
    a_model.encode_special_tokens = True
    letters = {c: b for b, c in token_alignment.byte_letters().items()}
    out, links, per = [], Counter(), []
    for i, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            a = a_model.encode(" " + text, add_special_tokens=False)
            a_bytes = [bytes(letters[c] for c in t) if i != 50256 else t.encode() for i, t in zip(a.ids, a.tokens)]
            b = b_model.encode(text)
            b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b_model.id_to_piece(k)) for k in b)]
            if b"".join(a_bytes) == raw == b"".join(b_bytes):
                x = y = at_a = at_b = 0
                ga, gb = [], []
                while x < len(a.ids) or y < len(b):
                    if at_a <= at_b and x < len(a.ids):
                        ga.append(a.ids[x])
                        at_a += len(a_bytes[x])
                        x += 1
                    else:
                        gb.append(b[y])
                        at_b += len(b_bytes[y])
                        y += 1
                    if at_a == at_b:
                        groups.append((ga, gb))
                        ga, gb = [], []
        pairs = [(ga[-1], gb[-1]) for ga, gb in groups]
        links.update(pairs)
        per.append((i, groups, pairs))
    highest = {}
    for (_, b), n in links.items():
        highest[b] = max(highest.get(b, 0), n)
    for i, groups, pairs in per:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs), sum(links[p] == highest[p[1]] for p in pairs), sum(links[p] for p in pairs), sha(text) if groups else ""))
    return out


def vocabularies():
    return [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]


def digest(rows):
    return sorted((tuple(r) for r in rows), key=str)


@here
def test_op13_is_what_plain_counting_gives(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.op13_token_alignment(spark, SF).collect()
    assert digest(got) == digest(plain_alignment(rows, vocabularies()))


def test_alignment_of_odd_texts(spark):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "the", " don't", "é", "ß", "日本", "🙂", "▁", "<|endoftext|>", "<s>", "<0x41>", " ", "\x1c", "\x85", "!", "...", "12", "\r\n", "x" * 300, "́", "ﬁ", "word word "]
    rows = [(r.choice([None, k]), "".join(r.choice(parts) for _ in range(r.randint(1, 12)))) for k in range(400)]
    rows += [(1, None), (1, ""), (2, "same words"), (2, "same words"), (3, " " * 20_000 + "x"), (4, "y" * 20_000), (5, "some more words " * 20_000)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, block string")
    want = digest(plain_alignment(rows, vocabularies()))
    assert digest(token_alignment.align(df, *vocabularies()).collect()) == want
    assert digest(token_alignment.align(df.repartition(3), *vocabularies(), block_links=500).collect()) == want
    assert token_alignment.align(df.where("false"), *vocabularies()).isEmpty()


def test_runs_are_merged_in_chunks():
    """Chunks of any size and a threshold of any size give the same contributions."""
    import numpy as np

    r = np.random.default_rng(4)
    runs, totals = [], Counter()
    for _ in range(7):
        pairs = np.unique((r.integers(0, 40, 300) << 16 | r.integers(0, 30, 300)).astype(np.uint32))
        links = r.integers(1, 9, len(pairs))
        totals.update(dict(zip(pairs.tolist(), links.tolist())))
        runs.append((pairs, links))
    highest = {}
    for p, n in totals.items():
        highest[p >> 16] = max(highest.get(p >> 16, 0), n)
    want = [[totals[p] << 1 | (totals[p] == highest[p >> 16]) for p in pairs.tolist()] for pairs, _ in runs]
    for chunk, threshold in ((1, 1), (7, 20), (50, 3), (1000, 1 << 18)):
        cut = [[x for at in range(0, len(p), chunk) for x in (token_alignment.pack(p[at : at + chunk]), token_alignment.pack(n[at : at + chunk]))] for p, n in runs]
        got = token_alignment.merge_runs(cut, threshold)
        assert [[int(v) for x in parts for v in token_alignment.unpack(x, np.int64)] for parts in got] == want
