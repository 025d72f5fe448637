"""Languages of mixed texts: script ranges, then Viterbi over per-word scores.

Learning counts character trigrams of each language over all training texts, in a
table of fixed size (`buckets` a language), and the share of each script in its
letters. A word's script narrows the languages to those that use it; each of them
scores the word by its trigrams; Viterbi with a switching penalty labels the words
and so finds spans of one language in a mixed text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeforge.llm.hashing import mix, sliced

#: The first and last code point of main script ranges, and the script's number.
SCRIPTS = [
    (0x0041, 0x024F, 1), (0x0370, 0x03FF, 2), (0x0400, 0x052F, 3), (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5),
    (0x0600, 0x077F, 6), (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0B80, 0x0BFF, 9), (0x0E00, 0x0E7F, 10),
    (0x10A0, 0x10FF, 11), (0x1100, 0x11FF, 12), (0x1E00, 0x1EFF, 1), (0x3040, 0x30FF, 13), (0x3400, 0x9FFF, 14),
    (0xAC00, 0xD7AF, 12), (0xF900, 0xFAFF, 14),
]
N_SCRIPTS = 15
#: Texts are taken by so many bytes at a time.
SLICE_BYTES = 4 << 20
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


class Chars:
    """Lower-cased code points of many texts, their words, and each character's trigram bucket."""

    def __init__(self, texts: list[str], buckets: int):
        low = [t.lower() for t in texts]
        n = np.array([len(t) for t in low], np.int64)
        self.off = np.concatenate([[0], np.cumsum(n)])
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        first, last = letter.copy(), letter.copy()
        if len(code):
            first[1:] &= ~letter[:-1]
            last[:-1] &= ~letter[1:]
            edge = np.unique(self.off)
            begin, stop = edge[edge < len(code)], edge[edge > 0] - 1
            first[begin], last[stop] = letter[begin], letter[stop]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Words of text i: [words[i], words[i + 1]).
        self.words = np.searchsorted(self.start, self.off)
        c = np.where(letter, code, 32).astype(np.uint64)
        before = np.concatenate([np.full(1, 32, np.uint64), c[:-1]]) if len(c) else c
        after = np.concatenate([c[1:], np.full(1, 32, np.uint64)]) if len(c) else c
        edge = np.zeros(len(c), bool)
        edge[self.off[:-1][n > 0]] = True
        before = np.where(edge, np.uint64(32), before)
        edge[:] = False
        edge[self.off[1:][n > 0] - 1] = True
        after = np.where(edge, np.uint64(32), after)
        key = (before << np.uint64(42)) | (c << np.uint64(21)) | after
        self.inside = np.flatnonzero(letter)
        self.bucket = (mix(key[self.inside]) % np.uint64(buckets)).astype(np.int64)
        low_, high, number = (np.array(x) for x in zip(*SCRIPTS, strict=True))
        at = np.maximum(np.searchsorted(low_, code[self.start], side="right") - 1, 0)
        hit = (code[self.start] >= low_[at]) & (code[self.start] <= high[at])
        self.script = np.where(hit, number[at], 0)


def learn(df: DataFrame, text_col: str, lang_col: str, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities of trigram buckets, and which language uses which script, of all rows of `df`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in sliced(whole, "text", SLICE_BYTES):
                langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text")
                for lang in dict.fromkeys(langs):
                    chars = Chars(texts.take(pa.array(np.flatnonzero(langs == lang))).to_pylist(), buckets)
                    new = np.concatenate([np.bincount(chars.bucket, minlength=buckets), np.bincount(chars.script, minlength=N_SCRIPTS)])
                    held[lang] = held.get(lang, 0) + new
        # by the task's number, so that a task that runs again deals its counts alike
        part = pa.array([TaskContext.get().partitionId() % 64] * len(held), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), part, pa.array([v.astype(np.int64).tobytes() for v in held.values()], pa.binary())], names=["lang", "part", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int64) for b in frame["counts"])
        return pd.DataFrame({"lang": pd.Series([frame["lang"].iloc[0]], dtype=object), "part": np.zeros(1, np.int64), "counts": [total.tobytes()]})

    kind = "lang string, part long, counts binary"
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # Tables of fixed size, one a task and language, added up in two steps.
    sums = rows.mapInArrow(count, kind).groupBy("lang", "part").applyInPandas(add, kind).groupBy("lang").applyInPandas(add, kind)
    found = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in sums.toLocalIterator())
    if not found:
        return [], np.zeros((buckets, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool)
    table = np.stack([x[:buckets] for _, x in found]).astype(float) + 0.1
    log = np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)
    scripts = np.stack([x[buckets:] for _, x in found]).astype(float)
    uses = (scripts > 0.005 * scripts.sum(1, keepdims=True)).T
    uses[~uses.any(1)] = True
    return [x for x, _ in found], np.ascontiguousarray(log), uses


def viterbi(score: np.ndarray, off: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; all texts advance together, longest first."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], off[:-1][order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), side="left")
    back = np.zeros(score.shape, np.uint16 if score.shape[1] > 255 else np.uint8)
    best = np.zeros((len(n), score.shape[1]))
    keep = np.arange(score.shape[1])
    for t in range(longest):
        k = live[t]
        at = begin[:k] + t
        v = best[:k]
        if t:
            top = v.argmax(1)
            enter = v[np.arange(k), top][:, None] - penalty
            switch = enter > v
            back[at] = np.where(switch, top[:, None], keep)
            v = np.where(switch, enter, v)
        best[:k] = v + score[at]
    out = np.zeros(len(score), np.int64)
    label = best.argmax(1) if len(n) else np.zeros(0, np.int64)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        out[at] = label[:k]
        if t:
            label[:k] = back[at, label[:k]]
    return out


def identify(df: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 12.0, buckets: int = 1 << 16) -> DataFrame:
    """Labels every text, learning from text and language of the rows for which `train` holds (all, if not given).

    Returns id_col, train, lang_pred (the language with most letters; of equals the first by name; `und` if the
    text is null, has no letter or nothing was learned), score (its share of the letters, 0 if `und`) and spans
    (language, first and last word that has letters, in order). The language column is read in training only.
    One row per input row, in slices of a few MB, a very long text alone; repeated and null ids are rows of their own.
    Other columns don't take part; an empty table gives no rows. Scoring is a narrow pass.
    """
    train = F.coalesce(train if train is not None else F.lit(True), F.lit(False))
    langs, log, uses = learn(df.where(train), text_col, lang_col, buckets)
    model = df.sparkSession.sparkContext.broadcast((langs, log, uses))  # of fixed size a language

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        langs, log, uses = model.value
        n, names = len(frame), np.array([*langs, "und"], dtype=object)
        chars = Chars([t if t is not None else "" for t in frame["text"]], buckets)
        pred, share = np.full(n, len(langs)), np.zeros(n)
        spans: list[list[dict]] = [[] for _ in range(n)]
        if langs and len(chars.start):
            size = chars.end - chars.start
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            score = np.add.reduceat(log[chars.bucket], first).astype(float)
            score[~uses[chars.script]] = -1e9
            labels = viterbi(score, chars.words, penalty)
            text = np.repeat(np.arange(n), np.diff(chars.words))
            total = np.bincount(text * len(langs) + labels, size, n * len(langs)).reshape(n, -1)
            letters = total.sum(1)
            some = letters > 0
            pred[some] = total[some].argmax(1)
            share[some] = total[some].max(1) / letters[some]
            new = np.concatenate([[True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])])
            at = np.flatnonzero(new)
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(labels)], strict=True):
                base = int(chars.words[text[a]])
                spans[text[a]].append({"lang": names[labels[a]], "first": a - base, "last": b - 1 - base})
        return pd.DataFrame({id_col: frame["id"], "train": frame["train"], "lang_pred": names[pred], "score": share, "spans": spans})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", SLICE_BYTES):
                out = label(batch.select(["text", "train"]).to_pandas().assign(id=0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("train"), pa.array(out["lang_pred"].tolist(), pa.string()), pa.array(out["score"].to_numpy(), pa.float64()), pa.array(out["spans"].tolist(), SPANS)],
                    names=[id_col, "train", "lang_pred", "score", "spans"],
                )

    schema = T.StructType([df.schema[id_col], *T._parse_datatype_string("train boolean, lang_pred string, score double, spans array<struct<lang:string,first:int,last:int>>").fields])
    return df.select(df[id_col].alias("id"), train.alias("train"), df[text_col].alias("text")).mapInArrow(run, schema)


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
