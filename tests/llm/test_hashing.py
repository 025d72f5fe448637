"""Words that collide under a polynomial modulo 2**64 stay apart in every operator that hashes words."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeforge.llm.hashing import LONG_WORD, Texts
from lakeforge.llm.jaccard_join import near_duplicates
from lakeforge.llm.ngram_lm import score_documents
from lakeforge.llm.substring_words import dedup_word_windows
from lakeforge.llm.toxicity import features


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.fixture(scope="module")
def pair():
    return thue_morse(1024), thue_morse(1024, "b", "a")


@pytest.fixture(scope="module")
def twins(spark, pair):
    words = " ".join(f"w{i}" for i in range(19))
    return spark.createDataFrame([(1, f"{words} {pair[0]}"), (2, f"{words} {pair[1]}")], "doc_id long, text string")


@pytest.mark.parametrize("size", [16, LONG_WORD, LONG_WORD + 1, 64, 1024, 4096])
@pytest.mark.parametrize("lane", [0, 1])
def test_words_stay_apart(size, lane):
    texts = Texts(pa.array([thue_morse(size), f"{thue_morse(size, 'b', 'a')} x {thue_morse(size)}"]))
    h = texts.words().hashes(lane)
    assert h[0] == h[3] and len(np.unique(h)) == 3


def test_sums_of_words(pair):
    row, key = features(pa.array(list(pair)))
    assert len(np.unique(key[row == 0])) and set(key[row == 0].tolist()).isdisjoint(key[row == 1].tolist())


def test_windows(twins):
    assert {r.doc_id: r.n_removed for r in dedup_word_windows(twins, window=20).collect()} == {1: 0, 2: 0}


def test_components(twins):
    assert {r.doc_id: r.component_id for r in near_duplicates(twins, shingle=3, percent=90).collect()} == {1: 1, 2: 2}


def test_known_words(twins):
    out = score_documents(twins, F.col("doc_id") == 1).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in out} == {1: (21, 21), 2: (21, 20)}
