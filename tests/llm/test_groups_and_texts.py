"""Large groups, long texts, clashing names, and whole pipelines against brute force."""

import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeforge.llm import language_id, pieces
from lakeforge.llm.blocks import ensure_checkpoint_dir
from lakeforge.llm.jaccard_join import Bands, near_duplicates, spanning_links
from lakeforge.llm.pieces import encode_documents
from lakeforge.llm.queries import CATEGORIES
from lakeforge.llm.substring_bytes import dedup_byte_strings
from lakeforge.llm.toxicity import classify


def word(rng, n=6):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def groups(sets, percent):
    """The least index reachable from each."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (n := len(a & sets[j])) and 100 * n >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("percent", [80, 90])
def test_links_of_a_large_group_span_it(percent):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = []
    for _ in range(150):
        some = base[rng.random(120) > rng.choice([0.02, 0.08, 0.12])]
        sets.append(np.unique(np.concatenate([some, rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)])))
    bands = Bands(percent, max(map(len, sets)))
    whole = np.arange(len(sets))
    want = groups([set(x.tolist()) for x in sets], percent)
    found = set()
    for one, two in ((whole, whole), (whole[:70], whole[:70]), (whole[:70], whole[70:]), (whole[70:], whole[70:])):
        links = spanning_links(sets, whole.copy(), one, two, bands, percent)
        assert len(links) < len(sets)
        for i, j in links:
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert 100 * len(a & b) >= percent * len(a | b)
        if one is whole:
            found = set(links)
            root = list(range(len(sets)))
            for i, j in sorted(found):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
            assert root == want


def test_near_misses_of_one_text_in_chunks(spark):
    """Copies of one text that are too far apart to link directly, compared by pairs of small chunks."""
    rng = random.Random(9)
    base = [word(rng) for _ in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(80), rng.choice([0, 1, 2, 3])):
            words[at] = word(rng)
        rows.append((i + 7, " ".join(words)))
    rows += [(500, " ".join(word(rng) for _ in range(30_000))), (501, None), (502, " \t ")]
    rows.append((503, rows[-3][1] + " end"))
    got = near_duplicates(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id int, text string, comp int, least int, n int").repartition(3), shingle=3, percent=90, chunk_bytes=4000)
    sets = [shingles(t, 3) for _, t in rows]
    want = {(d, len(s), rows[g][0]) for (d, _), s, g in zip(rows, sets, groups(sets, 90), strict=True)}
    assert set(map(tuple, got.collect())) == want
    with pytest.raises(ValueError, match="integers"):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_places_are_chosen_by_pieces():
    """The same places, starts and texts whatever the pieces."""
    from lakeforge.llm import substring_bytes as S

    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 90, 60)
    lengths[[3, 30]] = 700
    off = np.concatenate([[0], np.cumsum(lengths)])
    data = rng.integers(97, 100, off[-1]).astype(np.uint8)
    table = pa.table({"t": pa.array([data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.large_binary())})
    grams = S.Prefix.of_bytes(data).sliding(10)
    place, s1, s2, text = S._chosen(grams, off, 40, 10)
    for piece in (1, 7, 64, 333, 1 << 20):
        _, key, *got = S.chosen_places(table["t"], 40, 10, piece)
        assert all(np.array_equal(x, y) for x, y in zip(got, (place, s1, s2, text), strict=True))
        assert np.array_equal(key, grams[place] >> S.SHORT << S.SHORT)


@pytest.mark.parametrize("length", [90, 57, 25, 20])
def test_passages_beside_strings(spark, length):
    """Strings of `length` bytes removed, repeated passages of over 12 words or 80 bytes counted."""
    rng = random.Random(2)
    shared = [" ".join(word(rng, n) for _ in range(m)) for n, m in ((1, 13), (2, 14), (1, 12), (6, 30), (30, 4), (9, 9))]
    rows = []
    for i in range(40):
        parts = [" ".join(word(rng) for _ in range(rng.randint(2, 9))) for _ in range(3)]
        rows.append((i, f"{parts[0]} {rng.choice(shared)} {parts[1]} {rng.choice(shared)} {parts[2]}", 5, 6))
    rows += [(90, "é" * 20_000 + rows[0][1], 0, 0), (91, None, 0, 0), (91, "", 0, 0)]
    words, most = 12, 80

    def repeated(n):
        seen = Counter(b[i : i + n] for _, b in texts for i in range(len(b) - n + 1))
        return [[seen[b[i : i + n]] > 1 for i in range(len(b) - n + 1)] for _, b in texts]

    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    want = Counter()
    for (d, b), starts, shorter in zip(texts, repeated(length), repeated(2 * words + 1), strict=True):
        gone = bytearray(len(b))
        for i in np.flatnonzero(starts):
            gone[i : i + length] = b"\1" * length
        edge = np.flatnonzero(np.diff(np.array(shorter, np.int8), prepend=0, append=0)) if shorter else np.zeros(0, int)
        runs = [(x, y - 1 + 2 * words + 1) for x, y in zip(edge[::2], edge[1::2], strict=True)]
        whole = lambda x, y, b=b: len([1 for m in re.finditer(rb"[^ ]+", b) if m.start() >= x and m.end() <= y])
        runs = [(x, y) for x, y in runs if y - x > most or whole(x, y) > words]
        inside = set().union(*(range(x, y) for x, y in runs))
        want[(d, 5 if d < 50 else 0, len(b), sum(gone), len(runs), len(inside), bytes(x for x, g in zip(b, gone, strict=True) if not g))] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, kept int").repartition(4)
    got = dedup_byte_strings(df, length=length, keep=["n_removed"], passages_over=(words, most), suffix="_").collect()
    assert Counter((r.doc_id, r.n_removed, r.n_bytes_, r.n_removed_, r.n_passages_, r.n_passage_bytes_, bytes(r.kept_)) for r in got) == want
    with pytest.raises(ValueError, match="suffix"):
        dedup_byte_strings(df, keep=["kept"])


def test_languages_of_mixed_texts(spark, monkeypatch):
    """Against a Viterbi pass over one word at a time; slices of a few bytes change nothing."""
    rng = random.Random(8)
    letters = {"aa": "abcde", "bb": "dexyz", "cc": "абвг"}
    say = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 12)]
    rows += [(100 + i, " ".join(say(rng.choice(list(letters)), rng.randint(1, 6)) for _ in range(rng.randint(1, 5))), None) for i in range(40)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 !", None), (None, say("aa", 3), None), (303, say("bb", 20_000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    buckets, penalty = 1 << 12, 12.0
    results = []
    for size in (4 << 20, 200):
        monkeypatch.setattr(language_id, "SLICE_BYTES", size)
        out = language_id.identify(df, F.col("lang").isNotNull(), buckets=buckets, penalty=penalty).collect()
        results.append(Counter((r.doc_id, r.train, r.lang_pred, round(r.score, 9), tuple(map(tuple, r.spans))) for r in out))
    assert results[0] == results[1]
    langs, log, uses = language_id.learn(df.where("lang is not null"), "text", "lang", buckets)
    want = Counter()
    for d, t, lang in rows:
        chars = language_id.Chars([t or ""], buckets)
        at, score = 0, []
        for x, y, script in zip(chars.start, chars.end, chars.script, strict=True):
            s = log[chars.bucket[at : at + y - x]].astype(np.float32).sum(0).astype(float)
            at += y - x
            score.append(np.where(uses[script], s, -1e9))
        if not score:
            want[(d, lang is not None, "und", 0.0, ())] += 1
            continue
        best, back = score[0], []
        for s in score[1:]:
            move = [max(range(len(langs)), key=lambda i, j=j: best[i] - penalty * (i != j) + 1e-12 * (i == j)) for j in range(len(langs))]
            back.append(move)
            best = np.array([best[i] - penalty * (i != j) for j, i in enumerate(move)]) + s
        path = [int(best.argmax())]
        for move in reversed(back):
            path.append(move[path[-1]])
        path.reverse()
        share = np.bincount(path, [y - x for x, y in zip(chars.start, chars.end, strict=True)], len(langs))
        edge = [i for i in range(len(path)) if i == 0 or path[i] != path[i - 1]]
        spans = tuple((langs[path[a]], a, b - 1) for a, b in zip(edge, [*edge[1:], len(path)], strict=True))
        want[(d, lang is not None, langs[int(share.argmax())], round(share.max() / share.sum(), 9), spans)] += 1
    assert results[0] == want
    assert {r.lang_pred for r in language_id.identify(df.where("doc_id = 302"), F.lit(False)).collect()} == {"und"}


def test_toxic_rows_with_clashing_columns(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(word(rng, 3) for _ in range(20)) + (" vile scum" if i % 5 == 0 else ""), "x", 0.5) for i in range(200)]
    rows += [(None, "vile scum", "y", 0.1), (900, None, "y", 0.1), (901, "", "y", 0.1), (0, "fine", "y", 0.1), (902, "a " * 200_000 + "vile scum", "y", 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rejected string, p_toxic double")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    with pytest.raises(ValueError, match="suffix"):
        classify(docs, labels, CATEGORIES, keep=docs.columns)
    out = classify(docs, labels, CATEGORIES, keep=docs.columns, suffix="_").collect()
    assert Counter((r.doc_id, r.rejected) for r in out) == Counter((d, x) for d, _, x, _ in rows)
    assert all(r.rejected_ == ("vile" in (r.text or "")) for r in out)


def test_a_cluster_must_name_a_shared_folder():
    none = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage by plain loops: rejected words, shingle sets, byte strings, shared shingles, the library's ids."""
    import sentencepiece

    rng = random.Random(12)
    text = lambda n: " ".join(word(rng, rng.randint(4, 8)) for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    passage, rows = text(60), []
    add = lambda t: rows.append((len(rows) * 2, t, "en", "web", len(t or "")))
    for i in range(120):
        add(text(40) + (" vile scum" if i % 6 == 0 else ""))
    for i in (1, 2, 3):
        w = rows[i][1].split()
        add(rows[i][1])
        add(" ".join([*w[:20], "changed", *w[21:]]))
        add(" ".join([*w[:38], "other"]))
    for item in items[:3]:
        add(f"{text(12)} {item[1]} {text(12)}")
    for _ in range(3):
        add(f"{text(25)}\n{passage}\n{text(25)}")
    for t in (None, "", None, "", passage):
        add(t)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2 * i, 1, int(i % 6 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {d: t for d, t, *_ in rows if "vile" not in (t or "")}
    ids = list(left)
    near = groups([shingles(left[d], 5) for d in ids], 80)
    left = {d: left[d] for i, d in enumerate(ids) if near[i] == i}
    raw = {d: (t or "").encode() for d, t in left.items()}
    seen = Counter(b[i : i + 101] for b in raw.values() for i in range(len(b) - 100))
    cut = {}
    for d, b in raw.items():
        hit = [i for i in range(len(b) - 100) if seen[b[i : i + 101]] > 1]
        gone = set()
        while hit:
            run = [hit.pop(0)]
            while hit and hit[0] == run[-1] + 1:
                run.append(hit.pop(0))
            x, y = run[0], run[-1] + 101
            inner = len([m for m in re.finditer(rb"\S+", b) if m.start() >= x and m.end() <= y])
            if inner > 50 or y - x > 259:
                gone |= set(range(x, y))
        t = bytes(v for i, v in enumerate(b) if i not in gone).decode()
        if not gone or t.strip():
            cut[d] = t
    for d, t in list(cut.items()):
        w = t.lower().split()
        for _, item in items:
            iw = item.lower().split()
            want = Counter(tuple(iw[i : i + 5]) for i in range(len(iw) - 4))
            for s in range(len(w) - len(iw) + 1):
                own = Counter(tuple(w[s + i : s + i + 5]) for i in range(len(iw) - 4))
                if sum((own & want).values()) >= 0.8 * sum((own | want).values()):
                    cut.pop(d, None)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: tuple(library.encode(t, add_bos=True, add_eos=True)) for d, t in cut.items()}
    assert {r.doc_id: tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got} == want
    assert len(got) == len(want) < len(rows) - 20


def test_pieces_of_a_long_text(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(3)
    rows = [(1, " ".join(word(rng) for _ in range(30_000))), (1, "a"), (None, "a")]
    got = encode_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, decoded int"), path).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert Counter((r.doc_id, r.n_tokens, r.decoded) for r in got) == Counter((d, len(library.encode(t)) + 2, t) for d, t in rows)


def test_pieces_of_long_words(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = pieces.Model(f.read())
    rng = random.Random(1)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 100_000), ("ab", 20_000), ("=", 50_000), ("ACGT", 20_000)):
        text = "".join(rng.choice(letters) for _ in range(n))
        began = time.perf_counter()
        got = model.encode([text, "a b", text + " c"])
        assert time.perf_counter() - began < 5  # some tenths of a second; tens of seconds where a round costs the word's length
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_bos=True, add_eos=True) for t in (text, "a b", text + " c")]
    monkeypatch.setattr(pieces, "_LONG_WORD", 1)
    model.cache.clear()
    texts = ["".join(rng.choice("aabbcdeeht ▁é中=/.12theing") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == [library.encode(t, add_bos=True, add_eos=True) for t in texts]
