"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A suffix array groups suffixes by their first bytes and refines the groups by the groups of later offsets.
Here the initial buckets are those of q-grams, kept only at content-chosen places: of any `length - q + 1`
neighbouring q-grams the one with the least fingerprint (rightmost of equals). Equal strings of `length` bytes
choose the same place, so a place whose bucket has one member holds no repeated string and leaves at once.

What is left, some of the bytes, is refined. Each offset has the pointer of its bucket: first that of its q-gram;
then, by doubling, that of its own pointer and the pointer as many bytes later. A pointer is a fingerprint of the
two that it comes from, so equal strings get equal pointers in every block and no renumbering pass is needed.
Refinement works on cells, ranges of start offsets around the chosen place. Each round sorts the members of a bucket
by the pointers of the string that all starts of the cell share and of the string that they span:

- the shared string has one member: no start in the cell is repeated;
- a member's spanned string is repeated: all starts in the cell are;
- else the members are refined again with smaller cells, down to single starts.

Blocks keep their open cells, and the bytes around them, from round to round: texts are hashed twice, whatever
the number of rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeforge.llm import blocks as B
from lakeforge.llm.hashing import Prefix, Texts, covered, mix

U64 = np.uint64
#: Initial buckets go by the upper 48 bits: a chance meeting only opens a cell.
SHORT = U64(16)
#: Starts whose places are chosen at a time.
PIECE = 1 << 18


def cell_sizes(width: int) -> list[int]:
    """From the whole range of starts down to one, by factors of at most 18."""
    sizes = [width]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 18))
    return sizes


class Pointers:
    """Bucket pointers of all offsets of some bytes for widths q, 2q, 4q ... up to `most`."""

    def __init__(self, data: np.ndarray, lane: int, q: int, most: int):
        held = Prefix.of_bytes(data, lane).sliding(q)
        self.widths, self.held = [q], [held]
        while 2 * self.widths[-1] <= most and len(held) > self.widths[-1]:
            width = self.widths[-1]
            held = mix(held[:-width] * U64(0x9E3779B97F4A7C15) + held[width:])
            self.widths.append(2 * width)
            self.held.append(held)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the strings [start, end) of at least q bytes: the pointers of the widest width at either end."""
        size = end - start
        out = np.zeros(len(size), U64)
        level = np.searchsorted(self.widths, size, side="right") - 1
        for k, (width, held) in enumerate(zip(self.widths, self.held, strict=True)):
            some = np.flatnonzero(level == k)
            out[some] = mix(held[start[some]] * U64(0xC2B2AE3D27D4EB4F) + held[end[some] - width] + size[some].astype(U64))
        return out


def _chosen(grams: np.ndarray, off: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Chosen places, the first and last start that choose each, and the text of each."""
    lens = np.diff(off)
    if not len(grams) or not (lens >= length).any():
        return (np.zeros(0, np.int64),) * 4
    top = U64(0xFFFFFFFF)
    low = grams & ~top  # places, the later the less, in the lower half
    low |= top - np.arange(len(grams), dtype=U64)
    width, have = length - q + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    n = np.maximum(lens - length + 1, 0)
    text = np.repeat(np.arange(len(lens), dtype=np.int32), n)
    starts = np.arange(len(text)) + (off[:-1] - (np.cumsum(n) - n))[text]
    place = (top - (low[starts] & top)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    return place[at], starts[at], starts[np.concatenate([at[1:] - 1, [len(starts) - 1]])], text[at]


def chosen_places(column: pa.ChunkedArray, length: int, q: int, piece: int) -> tuple:
    """Texts; of each chosen place its initial bucket, itself, the first and last start, its text.

    By `piece` starts at a time, so that a very long text needs no more memory than its bytes.
    """
    texts = Texts(column)
    parts = []
    for low in range(0, len(texts.data), piece):
        data = texts.data[low : low + piece + length - 1]
        first, last = np.searchsorted(texts.off, [low, low + len(data)], side="right") - 1
        off = np.clip(texts.off[first : last + 2], low, low + len(data)) - low
        grams = Prefix.of_bytes(data).sliding(q)
        place, s1, s2, text = _chosen(grams, off, length, q)
        parts.append((grams[place] >> SHORT << SHORT, place + low, s1 + low, s2 + low, text.astype(np.int64) + first))
    key, place, s1, s2, text = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, U64 if i == 0 else np.int64) for i in range(5))
    # a place that starts of two pieces choose is one
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(place) else np.zeros(0, np.int64)
    return texts, key[new], place[new], s1[new], s2[np.append(new[1:], len(place))[: len(new)] - 1], text[new]


def _packed(cells: list[np.ndarray]) -> bytes:
    """Places and moves by their differences, all else from the place: small numbers."""
    place, s1, s2, lo, hi, shift, o1, o2 = cells
    return B.squeeze_numbers(np.diff(place, prepend=0), place - s1, place - s2, place - lo, hi - place, np.diff(shift, prepend=0), o1, o2 - o1)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    place, s1, s2, lo, hi, shift, o1, o2 = B.expand_numbers(blob, 8)
    place = np.cumsum(place)
    return [place, place - s1, place - s2, place - lo, hi + place, np.cumsum(shift), o1, o2 + o1]


def repeated_strings(blocks: B.Blocks, column: str, length: int, q: int | None = None, origin: str | None = None) -> DataFrame:
    """Ranges of bytes that the strings of `length` bytes cover that start more than once in all texts of `blocks`.

    As answers of each block, one a round: starts and ends of ranges within the block's texts end to end, or by the
    places that the column `origin` gives for the first byte of each text. Starts of one range are neighbours; the
    last is `length` before its end.
    """
    q = q or max(1, length // 4)
    width = length - q + 1
    sizes = cell_sizes(width)
    buckets = blocks.buckets(0.25)

    def chosen(table: pa.Table) -> tuple:
        """Keys are scrambled: a chosen fingerprint is the least of `width`, so that most would share the first buckets."""
        texts, key, *where = chosen_places(table[column], length, q, PIECE)
        return texts, mix(key) >> SHORT << SHORT, *where

    def initial(table: pa.Table, _: B.Replies, block: int) -> list[tuple[int, bytes]]:
        keys, count = np.unique(chosen(table)[1], return_counts=True)
        return [(k, B.squeeze_numbers(np.diff(keys[x:y] >> SHORT, prepend=U64(0)), count[x:y] > 1)) for k, x, y in B.split(keys, buckets)]

    def judge_initial(blobs: list[bytes], _: list[int]) -> list[bytes]:
        read = [B.expand_numbers(x, 2) for x in blobs]
        return [B.bits(x) for x in B.repeated([np.cumsum(x[0]) for x in read], [x[1] for x in read])]

    def row(block: int, data: np.ndarray, cells: list[np.ndarray], found: bytes | None) -> pd.DataFrame:
        """A block's open cells with the bytes around them alone, and the ranges found in this round.

        A cell: its place, the first and last start that choose it, the bounds of its bytes, how far they were moved, and
        its first and last offset from the place.
        """
        place, s1, s2, lo, hi, shift, o1, o2 = cells
        if not len(place):
            return pd.DataFrame({"block": [block], "n_bytes": [0], "payload": [None], "found": [found]})
        a = np.maximum(place + o1, lo)
        b = np.minimum(place + o2 + length, hi)
        stays = covered(a, b, len(data))
        back = place - (np.cumsum(stays)[place] - 1)  # a cell's bytes all stay, and move by as much
        cells = [place - back, s1 - back, s2 - back, a - back, b - back, shift + back, o1, o2]
        table = pa.table({"data": pa.array([data[stays].tobytes()], pa.large_binary()), "cells": pa.array([_packed(cells)], pa.large_binary())})
        return pd.DataFrame({"block": [block], "n_bytes": [int(stays.sum())], "payload": [B.pack_table(table)], "found": [found]})

    def opened(table: pa.Table, have: B.Replies, block: int) -> pd.DataFrame:
        """The places whose initial bucket has several members."""
        texts, key, place, s1, s2, text = chosen(table)
        keys, of = np.unique(key, return_inverse=True)
        many = np.zeros(len(keys), bool)
        for k, x, y in B.split(keys, buckets):
            many[x:y] = B.flags_of(have[0][k], y - x)
        go = np.flatnonzero(many[of.reshape(-1)])
        begin = texts.off[:-1]
        from_ = begin if origin is None else table[origin].to_numpy()
        t = text[go]
        return row(block, texts.data, [place[go], s1[go], s2[go], begin[t], texts.off[1:][t], (from_ - begin)[t], np.full(len(go), 1 - width), np.zeros(len(go), np.int64)], None)

    def refined(table: pa.Table, level: int) -> tuple:
        """Entries of a block's cells, sorted: pointers of the shared and the spanned string, with how many cells; the cells, and which entry each has."""
        data = np.frombuffer(table["data"][0].as_buffer(), np.uint8)
        cells = _unpacked(table["cells"][0].as_py())
        place, _, _, lo, hi, _, o1, o2 = cells
        # equal spans need both to agree: 128 bits, by codes of their own
        core = Pointers(data, 0, q, length + width).of(place + o2, place + o1 + length)
        a, b = np.maximum(place + o1, lo), np.minimum(place + o2 + length, hi)
        span = Pointers(data, 1, q, length + width).of(a, b) ^ mix((a - place).astype(U64) + U64(level << 32))
        order = np.lexsort((span, core))
        c, s = core[order], span[order]
        fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
        head = np.flatnonzero(fresh)
        of = np.empty(len(c), np.int64)
        of[order] = np.cumsum(fresh) - 1
        return (c[head], s[head]), np.diff([*head, len(c)]) > 1, data, cells, of

    def asker(level: int) -> Callable:
        def emit(table: pa.Table, _: B.Replies, block: int) -> list[tuple[int, bytes]]:
            keys, many, *_ = refined(table, level)
            return [(k, B.squeeze(*(key[x:y] for key in keys), many[x:y].astype(np.uint8))) for k, x, y in B.split(keys[0], buckets)]

        return emit

    def judge(blobs: list[bytes], _: list[int]) -> list[bytes]:
        read = [B.expand(x, "u8", "u8", "u1") for x in blobs]
        core, span, many = (np.concatenate([x[i] for x in read]) for i in range(3))
        order = np.lexsort((span, core))
        c, s = core[order], span[order]
        new_core = np.concatenate([[True], c[1:] != c[:-1]])
        new_span = new_core | np.concatenate([[True], s[1:] != s[:-1]])
        weight = many[order].astype(np.int64) + 1
        heads = np.flatnonzero(new_span)
        yes = np.repeat(np.add.reduceat(weight, heads) > 1, np.diff([*heads, len(c)]))
        heads = np.flatnonzero(new_core)
        mixed = ~np.logical_and.reduceat(yes, heads) & (np.add.reduceat(weight, heads) > 1)
        flags = np.empty((2, len(c)), bool)
        flags[0, order], flags[1, order] = yes, np.repeat(mixed, np.diff([*heads, len(c)]))
        return [B.bits(x.reshape(-1)) for x in np.split(flags, np.cumsum([len(x[0]) for x in read])[:-1], axis=1)]

    def updater(level: int) -> Callable:
        def update(table: pa.Table, have: B.Replies, block: int) -> pd.DataFrame:
            keys, _, data, cells, of = refined(table, level)
            flags = np.zeros((2, len(keys[0])), bool)
            for k, x, y in B.split(keys[0], buckets):
                flags[:, x:y] = B.flags_of(have[level + 1][k], 2 * (y - x)).reshape(2, -1)
            place, s1, s2, lo, hi, shift, o1, o2 = cells
            yes = np.flatnonzero(flags[0][of])
            f1, f2 = np.maximum(place + o1, s1)[yes] + shift[yes], np.minimum(place + o2, s2)[yes] + shift[yes] + length
            found = B.squeeze(f1, f2) if len(yes) else None
            if level + 1 == len(sizes):
                return row(block, data, [x[:0] for x in cells], found)
            # with cells of a repeated span, which others may be equal to in part
            go = np.flatnonzero(flags[1][of])
            parts = -(-sizes[level] // sizes[level + 1])
            pick = np.repeat(go, parts)
            n1 = o1[pick] + np.tile(np.arange(parts) * sizes[level + 1], len(go))
            n2 = np.minimum(n1 + sizes[level + 1] - 1, o2[pick])
            has = (n1 <= o2[pick]) & (place[pick] + n1 <= s2[pick]) & (place[pick] + n2 >= s1[pick])
            return row(block, data, [*(x[pick[has]] for x in cells[:6]), n1[has], n2[has]], found)

        return update

    def state(source: B.Blocks, answers: DataFrame, run: Callable) -> tuple[B.Blocks, DataFrame]:
        """The blocks that still have open cells, and what was found."""
        out = B.laid_out(B.each_block(source, answers, run, "block long, n_bytes long, payload binary, found binary"), blocks.partitions, "block")
        n, size = out.where("payload is not null").agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        return B.Blocks(out.where("payload is not null").select("block", "n_bytes", "payload"), n, size, blocks.spark, blocks.partitions), out.where("found is not null").select("block", "found")

    live, _ = state(blocks, B.answer(B.ask(blocks, None, initial), 0, judge_initial), opened)
    found = []
    for level in range(len(sizes)):
        if not live.count:
            break
        buckets = live.buckets(1.0)
        live, new = state(live, B.answer(B.ask(live, None, asker(level)), level + 1, judge), updater(level))
        found.append(new.select("block", F.lit(0).alias("round"), F.lit(level).alias("bucket"), F.col("found").alias("blob")))
    if not found:
        return blocks.spark.createDataFrame([], B.REPLY)
    out = found[0]
    for new in found[1:]:
        out = out.unionByName(new)
    return out


def _ranges(have: B.Replies, rnd: int) -> tuple[np.ndarray, np.ndarray]:
    read = [B.expand(x, "i8", "i8") for x in have.get(rnd, {}).values()]
    none = [np.zeros(0, np.int64)]
    return np.concatenate([x[0] for x in read] or none), np.concatenate([x[1] for x in read] or none)


def _runs(a: np.ndarray, b: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring starts, as ranges. Texts are apart here: the last start of one is `length` before the next one's first."""
    edge = np.flatnonzero(np.diff(covered(a, b - length + 1, n).astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2] - 1 + length


def _long_runs(texts: Texts, a: np.ndarray, b: np.ndarray, length: int, over: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs of neighbouring starts those that span more than so many whole words or so many bytes."""
    a, b = _runs(a, b, length, len(texts.data))
    words = texts.words()
    n_words = np.searchsorted(words.end, b, "right") - np.searchsorted(words.start, a, "left")
    worth = (n_words > over[0]) | (b - a > over[1])
    return a[worth], b[worth]


def dedup_byte_strings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: list[str] | None = None, only_over: tuple[int, int] | None = None, passages_over: tuple[int, int] | None = None, suffix: str = "") -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts anywhere else.

    With `only_over` (words, bytes), of the runs of neighbouring starts of such strings, those go that span more than
    so many whole words (between white space) or more than so many bytes; a repeated string is part of one run. Cuts
    are then made between whole characters, so that valid UTF-8 stays valid.

    With `passages_over` (words, bytes), counts repeated passages besides: runs of neighbouring starts of repeated
    strings of 2 * words + 1 bytes that span more than so many words or bytes. No passage of more words is shorter.
    Strings of `length`, where that is more, are then looked for within such runs alone, which hold all of them.

    "Elsewhere" includes the same document; overlaps count; strings are judged on the input and never
    cross documents. Texts are UTF-8; null text is empty. Returns id_col, the columns `keep`, n_bytes,
    n_removed, n_spans (maximal removed runs), kept (binary: what remains, in order) and, if asked for, n_passages and
    n_passage_bytes, each name with `suffix`, which tells them from columns of `keep`. One row per input row; repeated and null
    ids are documents of their own; a very long text is a block of its own; other columns don't take part; an empty
    table gives no rows.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    *counts, rest = (c + suffix for c in ("n_bytes", "n_removed", "n_spans", *(["n_passages", "n_passage_bytes"] if passages_over else []), "kept"))
    keep = [id_col, *[c for c in keep or [] if c not in (id_col, text_col)]]
    if clash := {*counts, rest} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} of keep are made here: give a suffix")
    packed = B.pack(df, text_col, keep, block_bytes=1 << 20)
    shortest = 2 * passages_over[0] + 1 if passages_over else length
    found = repeated_strings(packed, text_col, shortest)
    if length > shortest:

        def segments(table: pa.Table, have: B.Replies, block: int) -> pd.DataFrame:
            """The runs that are long enough to hold a string of `length`."""
            texts = Texts(table[text_col])
            a, b = _runs(*_ranges(have, 0), shortest, len(texts.data))
            a, b = a[b - a >= length], b[b - a >= length]
            held = pa.table({"text": pa.array([texts.data[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.large_binary()), "origin": pa.array(a, pa.int64())})
            return pd.DataFrame({"block": [block], "n_bytes": [int((b - a).sum())], "payload": [B.pack_table(held)]})

        cut = B.laid_out(B.each_block(packed, found, segments, "block long, n_bytes long, payload binary").where("n_bytes > 0"), packed.partitions, "block")
        n, size = cut.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        inside = repeated_strings(B.Blocks(cut, n, size, packed.spark, packed.partitions), "text", length, origin="origin")
        found = found.unionByName(inside.withColumn("round", F.lit(1)))
    elif length < shortest:
        found = found.unionByName(repeated_strings(packed, text_col, length).withColumn("round", F.lit(1)))

    def finish(table: pa.Table, have: B.Replies, block: int) -> pd.DataFrame:
        texts = Texts(table[text_col])
        lo, hi = texts.off[:-1], texts.off[1:]
        a, b = _ranges(have, int(length != shortest))
        if only_over is not None:
            a, b = _long_runs(texts, a, b, length, only_over)
            inner = np.append((texts.data & 0xC0) == 0x80, False)  # within a character
            for _ in range(3):
                a, b = a + inner[a], b - inner[b]
        gone = covered(a, b, len(texts.data))
        total = np.concatenate([[0], np.cumsum(gone)])
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        begin = lo[np.diff(texts.off) > 0]
        rise[begin] = gone[begin]
        spans = np.concatenate([[0], np.cumsum(rise)])
        n_gone = total[hi] - total[lo]
        kept = [texts.data[x:y][~gone[x:y]].tobytes() if n else texts.bytes_of(i) for i, (x, y, n) in enumerate(zip(lo, hi, n_gone, strict=True))]
        numbers = [hi - lo, n_gone, spans[hi] - spans[lo]]
        if passages_over is not None:
            a, b = _long_runs(texts, *_ranges(have, 0), shortest, passages_over)
            inside = np.concatenate([[0], np.cumsum(covered(a, b, len(texts.data)))])
            numbers += [np.searchsorted(a, hi) - np.searchsorted(a, lo), inside[hi] - inside[lo]]
        out = {c: table[c].to_pandas(types_mapper=nullable.get) if table[c].type in nullable else pd.Series(table[c].to_pylist(), dtype=object) for c in keep}
        return pd.DataFrame(out | dict(zip(counts, numbers, strict=True)) | {rest: pd.Series(kept, dtype=object)})

    nullable = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in counts), T.StructField(rest, T.BinaryType())])
    return B.each_block(packed, found, finish, schema.simpleString().removeprefix("struct<").removesuffix(">"))
