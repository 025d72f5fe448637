"""Each operator against a brute-force version on small texts with nulls, empties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from lakeforge.llm.contamination import find_contamination
from lakeforge.llm.jaccard_join import near_duplicates
from lakeforge.llm.language_id import identify
from lakeforge.llm.licenses import oracle, scan_licenses
from lakeforge.llm.ngram_lm import score_documents
from lakeforge.llm.pieces import Model, encode_documents
from lakeforge.llm.substring_bytes import dedup_byte_strings
from lakeforge.llm.substring_words import dedup_word_windows
from lakeforge.llm.toxicity import classify
from lakeforge.llm.vptree import nearest

KIND = "doc_id long, text string, n_bytes int, id int, block string, w int"


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(900))
    out = []
    for i in range(40):
        text = ""
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 2500)
            text += base[a : a + rng.randint(10, 300)] + rng.choice(["", f" X {rng.random()} ", "\n"])
        out.append((i if i % 7 else i // 2, text))
    out += [(None, base[:300]), (None, None), (5, None), (6, ""), (7, "  \t\n"), (8, "abab" * 100), (8, "abab" * 100), (9, "a b"), (10, "A  b"), (11, base[:300] + " z")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.mark.parametrize("window", [20, 3])
def test_word_windows(docs, rows, window):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    seen = {}
    for k, (_, ws) in sorted(enumerate(texts), key=lambda x: (x[1][0] is not None, x[1][0] or 0)):
        for i in range(len(ws) - window + 1):
            seen.setdefault(tuple(ws[i : i + window]), (k, i))
    want = Counter()
    for k, (d, ws) in enumerate(texts):
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] != (k, i):
                gone[i : i + window] = [True] * window
        want[(d, len(ws), sum(gone))] += 1
    assert Counter(tuple(r)[:3] for r in dedup_word_windows(docs, window=window).collect()) == want


@pytest.mark.parametrize("length", [101, 60, 41, 13])
def test_byte_strings(docs, rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    want = Counter()
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[(d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))] += 1
    assert Counter((*r[:4], bytes(r[4])) for r in dedup_byte_strings(docs, length=length).collect()) == want


def test_language_model(docs, rows):
    tokens = [(d, [*lower(t).split(), "end"]) for d, t in rows]
    train = [(d is not None and d % 3 != 0) for d, _ in tokens]
    count = Counter(w for (_, ws), x in zip(tokens, train, strict=True) if x for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((d, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens)
    results = []
    for most in (1 << 28, 0):  # broadcast, and by bucket
        got = score_documents(docs, F.col("doc_id") % 3 != 0, max_broadcast=most).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
        results.append(Counter((r.doc_id, round(r.score, 9)) for r in got))
    assert results[0] == results[1]


def test_jaccard_components(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(10):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([1, 2, 9, 20, 40, 90]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5003, "a b"), (5004, "A  b"), (None, "a b")]

    def shingles(t):
        w = lower(t).split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (n := len(a & sets[j])) and 100 * n >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    assert Counter(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())) == want


def test_pieces(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = Model(f.read())
    rng = random.Random(3)
    texts = ["", " ", "  a", " " * 40 + "x", "=" * 300, "the" * 50, "▁é中😀\0", "<s> </s> <0x41>"] + ["".join(rng.choice("aabbcdeeht  \n\t▁é中😀=/.12") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    ids = model.encode(texts)
    want = [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert model.decode(ids) == [library.decode(x) for x in want]
    got = encode_documents(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.decoded) for r in got) == Counter((d, len(x := library.encode(t or "", add_bos=True, add_eos=True)), library.decode(x)) for d, t in rows)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, (400, 6)).astype(float)
    vectors[50:120] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [1.0]), (None, [1.0] * 6)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7, shard_rows=90, block_rows=8).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    live = [i for i in range(400) if vectors[i].any()]
    for q in [i for i in live if i % 20 == 0]:
        best = sorted((-float(vectors[q] @ vectors[i]), i) for i in live if i != q)[:7]
        assert out[q] == [(i, -s) for s, i in best]


def test_licenses_match_their_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = Counter(map(tuple, scan_licenses(spark.read.parquet(f"{d}/documents.parquet")).collect()))
    assert got and got == Counter(db.execute(oracle()).fetchall())
    whole = spark.createDataFrame([(1, None), (2, ""), (3, "x.\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\nSee the GNU General Public License for more details.")], "doc_id int, text string")
    known = {"a": "x", "b": "see the gnu general public license for more details"}
    assert [(r.rule, r.first_sentence) for r in scan_licenses(whole, known=known, rules={"r": ("L", ["a", "b"]), "s": ("L", ["b", "a"])}).collect()] == [("r", 0)]


def test_contamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 15, 40, 60])))) for i in range(12)] + [(50, None), (51, "")]
    rows = [(None, None), (1, ""), (2, items[0][1])]
    for i in range(60):
        text = items[rng.randrange(12)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = word()
        rows.append((i + 10, " ".join([word() for _ in range(rng.randint(0, 30))] + text + [word() for _ in range(rng.randint(0, 30))])))

    def bag(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    want = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        for i, s in items:
            iw = (s or "").split()
            k, size = min(5, len(iw)), min(len(iw), len(w))
            for start in range(len(w) - size + 1 if iw and w else 0):
                a, b = bag(w[start : start + size], k), bag(iw, k)
                if a and (x := sum((a & b).values()) / sum((a | b).values())) >= 0.8 and x > want.get((d, i), 0):
                    want[(d, i)] = x
    got = find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_models_on_held_out_rows(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = identify(docs, F.col("doc_id") % 5 != 0).join(docs.select("doc_id", "lang"), "doc_id").where("not train").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    out = {r.doc_id: r.rejected for r in classify(docs, labels, [("quality", 0), ("toxic", 1)]).collect()}
    named = {r.doc_id for r in labels.collect()}
    assert sum(out[x] for x in toxic if x in out) >= 0.7 * len(toxic & out.keys())
    assert sum(out[x] for x in named - toxic if x in out) <= 0.03 * len(named)


def test_empty_and_null_tables(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (dedup_word_windows(empty), dedup_byte_strings(empty), score_documents(empty), near_duplicates(empty), identify(empty.withColumn("lang", F.lit("x"))), classify(empty, none, [("toxic", 1)]), scan_licenses(empty), encode_documents(empty, public_tokenizers.path("piece_bpe_32k.model"))):
        assert out.count() == 0
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert find_contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert {r.p_toxic for r in classify(docs, none, [("quality", 0), ("toxic", 1)]).collect()} == {0.5}
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
