"""Language-model scores from n-gram counts in a log-frequency Bloom filter.

A count c is kept as its level q = 1 + floor(log_b c): the filter holds the n-gram
with each of 1..q. A lookup probes (n-gram, 1), (n-gram, 2), ... until a probe
misses, and reads the count back as the lower edge of the last level, so that
seen counts never add up to more than their context has.

Counting, exact unigram counts and filter building are question rounds between
blocks of documents and buckets of keys (see `blocks`). Each bucket builds its own
segment of the filter, sized by its distinct n-grams. Segments are broadcast to the
workers up to `max_broadcast` bytes. A larger filter stays with its buckets, and
the blocks send their n-grams there: the same probes, the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeforge.llm import blocks as B
from lakeforge.llm.hashing import Prefix, Texts, mix

U64 = np.uint64


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base c), exactly at the edges."""
    edges = base ** np.arange(1, 2 + int(math.log(max(int(counts.max(initial=1)), 2), base)))
    return 1 + np.searchsorted(edges, counts, side="right")


def lower_edge(level: np.ndarray, base: float) -> np.ndarray:
    """The least whole count of a level; 0 of level 0."""
    return np.where(level > 0, np.ceil(base ** (level - 1.0) - 1e-9), 0.0)


class Segment:
    """A Bloom filter over (key, level) pairs: k probes in one array of bits."""

    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def build(cls, keys: np.ndarray, level: np.ndarray, bits_per_item: int, hashes: int) -> Segment:
        items = int(level.sum())
        out = cls(np.zeros(max(8, -(-items * bits_per_item // 8)), np.uint8), hashes)
        n = len(out.bits) * 8
        flat = np.zeros(n, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            some = keys[level >= q]
            for j in range(hashes):
                flat[cls._at(some, q, j, n)] = True
        out.bits = np.packbits(flat, bitorder="little")
        return out

    @staticmethod
    def _at(keys: np.ndarray, q: int, j: int, n: int) -> np.ndarray:
        return (mix(keys + U64((q * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F) % 2**64)) % U64(n)).astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """By repeated membership probes: the last level before the first miss."""
        out = np.zeros(len(keys), np.int64)
        n, left, q = len(self.bits) * 8, np.arange(len(keys)), 1
        while len(left):
            held = np.ones(len(left), bool)
            for j in range(self.hashes):
                at = self._at(keys[left], q, j, n)
                held &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left = left[held]
            out[left] = q
            q += 1
        return out


def score_documents(
    df: DataFrame,
    train: F.col = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    base: float = 1.5,
    bits_per_item: int = 10,
    hashes: int = 4,
    weight: float = 100.0,
    max_broadcast: int = 256 << 20,
) -> DataFrame:
    """Scores every text by an n-gram model of the rows for which `train` holds (all, if not given).

    Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end token; a null text is empty
    and has the end token alone. Order 1 is (c + 1) / (N + V + 1) with exact counts. Each higher order k
    mixes the count of the last k tokens, read from the filter, with the order below as `weight` pseudo-counts:
    (c_k + weight * p) / (C + weight), where C is the context's count (exact for one token, else its level's
    upper edge). Texts begin with a begin context that is never scored. `order`, `bits_per_item`, `hashes`
    and `base` set the model's size and fineness, all counts cover all training rows.

    Returns id_col, train (boolean, null as false), n_tokens, n_known (tokens with a count), train_tokens (N),
    base_score (log10, order 1) and score (log10, the model). One row per input row, also for repeated and
    null ids; other columns don't take part; an empty table gives no rows. With no training rows all counts are 0.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    train = F.lit(True) if train is None else train
    mark = "__train"
    while mark in df.columns:
        mark += "_"
    rows = df.select(F.col(id_col), F.col(text_col), F.coalesce(train, F.lit(False)).alias(mark))
    packed = B.pack(rows, text_col, [id_col, mark])
    buckets = packed.buckets(1.0)
    end, begin = (tuple(U64(mix(np.array([lane * 2 + k + 11], U64))[0]) for lane in (0, 1)) for k in (0, 1))

    def tokens(table):
        """128-bit codes of all tokens with an end after each text, and the range of tokens of each text."""
        words = Texts(table[text_col], lower=True).words()
        n = np.diff(words.off)
        off = words.off + np.arange(len(words.off))
        is_end = np.zeros(off[-1], bool)
        is_end[off[1:] - 1] = True
        code = []
        for lane in (0, 1):
            c = np.full(len(is_end), end[lane], U64)
            c[~is_end] = words.hashes(lane)
            code.append(c)
        return code[0], code[1], off, n + 1, np.asarray(table[mark].combine_chunks())

    def grams(code, off, k):
        """Keys of the k tokens that end at each token; a text begins after k - 1 begin tokens."""
        n = np.diff(off)
        wide = np.full(len(code) + (k - 1) * len(n), begin[0], U64)
        wide[np.arange(len(code)) + np.repeat(np.arange(1, len(n) + 1), n) * (k - 1)] = code
        at = np.arange(len(code)) + np.repeat(np.arange(len(n)), n) * (k - 1)
        return mix(Prefix(wide).of(at, at + k) + U64(k))

    def distinct_tokens(code, other):
        by = np.lexsort((other, code))
        fresh = np.concatenate([[True], (code[by][1:] != code[by][:-1]) | (other[by][1:] != other[by][:-1])]) if len(by) else np.zeros(0, bool)
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(fresh) - 1
        return by[fresh], of

    def ask_tokens(table, have, block):
        code, other, off, n, learn = tokens(table)
        first, of = distinct_tokens(code, other)
        count = np.bincount(of, np.repeat(learn, n), len(first)).astype(np.int64)
        key, check = code[first], other[first]
        return [(k, B.squeeze(key[a:b], check[a:b], count[a:b])) for k, a, b in B.split(key, buckets)]

    def judge_tokens(blobs, _):
        """Counts of each blob's tokens, behind the bucket's number of distinct tokens and of all."""
        read = [B.expand(x, "u8", "u8", "i8") for x in blobs]
        key, check, count = (np.concatenate([x[i] for x in read]) for i in range(3))
        by = np.lexsort((check, key))
        new = np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (check[by][1:] != check[by][:-1])])
        total = np.add.reduceat(count[by], np.flatnonzero(new))
        back = np.empty(len(key), np.int64)
        back[by] = np.repeat(total, np.diff([*np.flatnonzero(new), len(by)]))
        head = np.array([(total > 0).sum(), total.sum()], np.int64).tobytes()
        return [head + B.squeeze(x) for x in np.split(back, np.cumsum([len(x[0]) for x in read])[:-1])]

    seen = B.answer(B.ask(packed, None, ask_tokens), 0, judge_tokens)
    # Two numbers of each bucket, the same in all its answers.
    size = seen.groupBy("bucket").agg(F.min(F.substring("blob", 1, 16)).alias("head")).select(
        *(_long("head", at).alias(name) for at, name in ((0, "v"), (8, "n"))),
    )
    vocabulary, total = (int(x or 0) for x in size.agg(F.sum("v"), F.sum("n")).first())

    def ask_grams(only_train):
        def emit(table, have, block):
            code, _, off, n, learn = tokens(table)
            part = np.repeat(learn, n) if only_train else np.ones(len(code), bool)
            keys = np.concatenate([grams(code, off, k)[part] for k in range(2, order + 1)])
            keys, count = np.unique(keys, return_counts=True)
            return [(k, B.squeeze(keys[a:b], count[a:b].astype(np.int32))) for k, a, b in B.split(keys, buckets)]

        return emit

    def build(frame):
        read = [B.expand(x, "u8", "i4") for x in frame["blob"]]
        key, count = np.concatenate([x[0] for x in read]), np.concatenate([x[1] for x in read]).astype(np.int64)
        by = np.argsort(key, kind="stable")
        starts = B.runs_of(key[by])
        level = levels(np.add.reduceat(count[by], starts), base)
        made = Segment.build(key[by][starts], level, bits_per_item, hashes)
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "segment": pd.Series([made.bits.tobytes()], dtype=object, index=frame.index[:1])})

    replies, sent = seen, None
    if order > 1:
        segments = B.checkpoint(B.ask(packed, None, ask_grams(True)).groupBy("bucket").applyInPandas(build, "bucket int, segment binary"))
        if (segments.agg(F.sum(F.length("segment"))).first()[0] or 0) <= max_broadcast:
            sent = df.sparkSession.sparkContext.broadcast({r["bucket"]: r["segment"] for r in segments.toLocalIterator()})
        else:
            def probe(key, left, right):
                made = Segment(np.frombuffer(right["segment"].iloc[0], np.uint8), hashes) if len(right) else None
                out = []
                for blob in left["blob"]:
                    keys = B.expand(blob, "u8", "i4")[0]
                    out.append(B.squeeze((made.level(keys) if made else np.zeros(len(keys))).astype(np.uint8)))
                return pd.DataFrame({"block": left["block"], "round": np.int32(1), "bucket": left["bucket"], "blob": pd.Series(out, dtype=object, index=left.index)})

            asked = B.ask(packed, None, ask_grams(False))
            replies = seen.unionByName(asked.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInPandas(probe, B.REPLY))

    def gram_levels(keys, have):
        distinct, of = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        for k, a, b in B.split(distinct, buckets):
            if sent is None:
                out[a:b] = B.expand(have[1][k], "u1")[0]
            elif k in sent.value:
                out[a:b] = Segment(np.frombuffer(sent.value[k], np.uint8), hashes).level(distinct[a:b])
        return out[of]

    def finish(table, have, block):
        code, other, off, n, learn = tokens(table)
        first, of = distinct_tokens(code, other)
        count = np.zeros(len(first), np.int64)
        for k, a, b in B.split(code[first], buckets):
            count[a:b] = B.expand(have[0][k][16:], "i8")[0]
        count = count[of]
        low = (count + 1.0) / (total + vocabulary + 1.0)
        p = low
        if order > 1:
            keys = [grams(code, off, k) for k in range(2, order + 1)]
            level = np.split(gram_levels(np.concatenate(keys), have), order - 1)
            at_start = np.zeros(len(code), bool)
            at_start[off[:-1]] = True
            context = np.where(at_start, n_train, np.concatenate([[0], count[:-1]])).astype(float)
            for k in range(2, order + 1):
                c = lower_edge(level[k - 2], base)
                p = (np.minimum(c, context) + weight * p) / (context + weight)
                before = np.concatenate([[0], level[k - 2][:-1]])
                context = np.where(at_start, n_train, np.where(before > 0, np.ceil(base**before.astype(float)), 0.0))
        sums = [np.add.reduceat(x, off[:-1]) for x in ((count > 0).astype(np.int64), np.log10(low), np.log10(p))]
        return pd.DataFrame({
            id_col: table[id_col].to_pandas(types_mapper=nullable.get), "train": learn, "n_tokens": n, "n_known": sums[0],
            "train_tokens": np.int64(total), "base_score": sums[1], "score": sums[2],
        })

    n_train = int(rows.where(F.col(mark)).count()) if order > 1 else 0
    nullable = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
    schema = T.StructType([df.schema[id_col], *T._parse_datatype_string("train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return B.each_block(packed, replies, finish, schema.simpleString().removeprefix("struct<").removesuffix(">"))


def _long(column: str, at: int) -> F.col:
    """Eight bytes of a binary column, least first, as a long."""
    parts = [F.substring(column, at + 8 - i, 1) for i in range(8)]
    return F.conv(F.hex(F.concat(*parts)), 16, 10).cast("long")
