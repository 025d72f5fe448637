"""Stages of the pipeline on planted cases."""

import random

import corpus_pipeline


def test_repeated_passages_of_over_50_short_words_are_cut(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    fill = lambda: " ".join(word(6) for _ in range(30))
    cut = {
        "one letter": " ".join(word(1) for _ in range(51)),
        "short": " ".join(word(rng.randint(2, 4)) for _ in range(51)),
        "long": " ".join(word(9) for _ in range(26)),  # 259 bytes, and the spaces around it
    }
    stays = {"50 short": " ".join(word(3) for _ in range(50)), "brief": " ".join(word(5) for _ in range(25))}
    rows = []
    for passage in [*cut.values(), *stays.values()]:
        for _ in range(2):
            rows.append((len(rows), f"{fill()}\n{passage}\n{fill()}"))
    rows += [(100, None), (101, ""), (102, cut["short"])]
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int"), "").collect()}
    assert 102 not in got and {100, 101} <= got.keys()
    for i, (name, passage) in enumerate([*cut.items(), *stays.items()]):
        for d in (2 * i, 2 * i + 1):
            assert (passage in got[d]) == (name in stays), name
            before, after = rows[d][1].split(passage)
            assert got[d].startswith(before.strip()) and got[d].endswith(after.strip())


def test_stages_decide_by_row(spark, tmp_path):
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    a, b, c, d, e, f, item = (text() for _ in range(7))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = lambda run, rows: sorted(map(str, map(tuple, run(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path)).collect())))
    said = lambda rows: sorted(map(str, rows))
    copies = [(1, a), (1, a), (None, a), (None, b), (None, b), (3, c), (2, c + " x"), (2, d), (5, e), (4, e), (6, f), (None, None), (8, None), (8, "")]
    assert stage(corpus_pipeline.drop_near_copies, copies) == said([(1, a), (None, b), (2, c + " x"), (2, d), (4, e), (6, f), (None, None), (8, None), (8, "")])
    dirty = [(None, item), (1, "z " + item), (1, a), (None, b), (2, c), (2, c), (None, None), (3, "")]
    assert stage(corpus_pipeline.drop_contaminated, dirty) == said([(1, a), (None, b), (2, c), (2, c), (None, None), (3, "")])


def test_other_scripts_keep_what_is_not_repeated(spark):
    rng = random.Random(8)
    rows, passages = [], []
    for first, last in ((0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x4FFF), (0x61, 0x7A)):
        word = lambda: "".join(chr(rng.randint(first, last)) for _ in range(5))  # noqa: B023, E731
        passages.append(" ".join(word() for _ in range(60)))
        for _ in range(2):
            rows.append((len(rows), f"{' '.join(word() for _ in range(80))}\n{passages[-1]}\n{' '.join(word() for _ in range(80))}", 0))
    rows.append((99, passages[0], 0))
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), "").collect()}
    assert got.keys() == set(range(8))
    for i, text in got.items():
        before, after = rows[i][1].split(passages[i // 2])
        assert text.startswith(before.strip()) and text.endswith(after.strip()) and len(text) <= len(before + after)
