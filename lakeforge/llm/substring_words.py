"""Removal of repeated word windows, found through difference-cover anchors.

A difference cover D modulo p has, for any two places i and j, a shift s < p with
(i + s) mod p and (j + s) mod p both in D. So if two windows of w words are equal,
they share an equal run of w - p + 1 words that starts at a cover place in both:
an anchor. Only cover places are hashed (4 of 13 for windows of 20 words), and only
windows around an anchor that occurs again are extended to whole windows.

Two question rounds between blocks of documents and buckets of keys (see `blocks`):
which anchors occur again, then which start of a window is the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakeforge.llm import blocks as B
from lakeforge.llm.hashing import Prefix, Texts, covered

#: Periods with a difference cover each.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves an anchor over a third of the window."""
    period = max(p for p in COVERS if p == 1 or 3 * (window - p + 1) > window)
    return period, COVERS[period]


def dedup_word_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Removes each word covered by a window of `window` words that also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start; windows are judged on the input.
    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Returns id_col, n_words, n_removed, kept (kept words
    joined by one space). One row per input row: a null id comes before all others; rows with one id are
    documents of their own, ordered by their place in the input; null text is empty. Other columns don't
    take part. An empty table gives no rows.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    period, cover = cover_for(window)
    width = window - period + 1
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True
    packed = B.pack(df, text_col, [id_col])
    buckets = packed.buckets(1.3)

    def load(table: pa.Table):
        ids = table[id_col].combine_chunks().cast(pa.int64())
        ids = np.where(np.asarray(ids.is_null()), np.iinfo(np.int64).min, np.asarray(ids.fill_null(0)))
        return ids, Texts(table[text_col]).words()

    def anchors(words):
        """Places of anchors, their keys, and for each key its place among the distinct sorted ones."""
        room = words.room()
        local = np.arange(len(room)) - np.repeat(words.off[:-1], np.diff(words.off))
        at = np.flatnonzero(in_cover[local % period] & (room >= width))
        key = Prefix(words.hashes()).of(at, at + width)
        distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        return room, at, distinct, inverse, count

    def ask_anchors(table, have, block):
        _, words = load(table)
        _, _, distinct, _, count = anchors(words)
        return [(k, B.squeeze(distinct[a:b], (count[a:b] > 1).astype(np.uint8))) for k, a, b in B.split(distinct, buckets)]

    def judge_anchors(blobs, _):
        read = [B.expand(x, "u8", "u1") for x in blobs]
        return [B.bits(x) for x in B.repeated([x[0] for x in read], [x[1] for x in read])]

    def windows(table, have):
        """Candidate windows: start word, 128-bit key, and their distinct keys with the first start of each."""
        ids, words = load(table)
        room, at, distinct, inverse, _ = anchors(words)
        again = np.zeros(len(distinct), bool)
        for k, a, b in B.split(distinct, buckets):
            again[a:b] = B.flags_of(have[0][k], b - a)
        hit = np.zeros(len(room) + period + 1, np.int64)
        hit[at[again[inverse]] + 1] = 1
        total = np.cumsum(hit)
        n = np.arange(len(room))
        start = n[(room >= window) & (total[n + period] > total[n])]
        text = words.text_of_word()[start]
        key, other = (Prefix(words.hashes(lane), lane).of(start, start + window) for lane in (0, 1))
        rank = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        order = np.lexsort((start, place[text], other, key))
        fresh = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])]) if len(order) else np.zeros(0, bool)
        first = order[fresh]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(fresh) - 1
        return ids, words, start, text, key, other, first, of, place

    def by_bucket(key, first, place, text, start):
        """The distinct windows by bucket; within one by document and start, which packs well."""
        at = B.bucket_of(key[first], buckets)
        order = np.lexsort((start[first], place[text[first]], at))
        at = at[order]
        edges = [*B.runs_of(at), len(at)]
        return order, [(int(at[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def ask_windows(table, have, block):
        ids, words, start, text, key, other, first, _, place = windows(table, have)
        order, cuts = by_bucket(key, first, place, text, start)
        out = []
        for k, a, b in cuts:
            f = first[order[a:b]]
            out.append((k, B.squeeze(key[f], other[f], np.diff(ids[text[f]], prepend=0), np.diff(start[f], prepend=0).astype(np.int32))))
        return out

    def judge_windows(blobs, of_block):
        read = [B.expand(x, "u8", "u8", "i8", "i4") for x in blobs]
        if not read:
            return []
        key, other = (np.concatenate([x[i] for x in read]) for i in (0, 1))
        doc = np.concatenate([np.cumsum(x[2]) for x in read])
        start = np.concatenate([np.cumsum(x[3].astype(np.int64)) for x in read])
        source = np.repeat(np.array(of_block, np.int64), [len(x[0]) for x in read])
        order = np.lexsort((start, source, doc, other, key))
        first = np.zeros(len(key), bool)
        k, o = key[order], other[order]
        first[order[np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])]] = True
        return [B.bits(x) for x in np.split(first, np.cumsum([len(x[0]) for x in read])[:-1])]

    def finish(table, have, block):
        ids, words, start, text, key, other, first, of, place = windows(table, have)
        order, cuts = by_bucket(key, first, place, text, start)
        leads = np.zeros(len(first), bool)
        for k, a, b in cuts:
            leads[order[a:b]] = B.flags_of(have[1][k], b - a)
        stays = np.zeros(len(start), bool)
        stays[first] = leads
        dup = start[~stays]
        gone = covered(dup, dup + window, len(words.start))
        n_words = np.diff(words.off)
        total = np.concatenate([[0], np.cumsum(gone)])
        n_gone = total[words.off[1:]] - total[words.off[:-1]]
        kept = []
        for i in range(words.texts.n):
            parts = words.texts.bytes_of(i).split()
            if n_gone[i]:
                parts = [w for w, x in zip(parts, gone[words.off[i] : words.off[i + 1]], strict=True) if not x]
            kept.append(b" ".join(parts).decode())
        return pd.DataFrame({id_col: table[id_col].to_pandas(types_mapper=nullable.get), "n_words": n_words, "n_removed": n_gone, "kept": pd.Series(kept, dtype=object)})

    nullable = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
    schema = T.StructType([df.schema[id_col], *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])
    one = B.answer(B.ask(packed, None, ask_anchors), 0, judge_anchors)
    two = B.answer(B.ask(packed, one, ask_windows), 1, judge_windows)
    return B.each_block(packed, one.unionByName(two), finish, schema.simpleString().removeprefix("struct<").removesuffix(">"))
