"""Near-duplicate groups by word shingles: a parity-sketch join with exact verification.

Sets of equal shingles are one class from the start. Classes are laid into size bands:
two sets that link lie in the same band or in neighbouring ones, and differ in at most
d elements, d being set by the band's largest size. In each band a set's elements are
dealt by hash into more than d parts, and each element flips one bit of its part's
parity word. An element in one set only changes one word by at most a bit, so the
Hamming distance of two sketches is at most the symmetric difference, and some words
are equal (pigeonhole). Sets that share enough words are candidates; their shingles decide.

A word is kept in two widths. The join needs words that are seldom equal by chance, so
its words have 2**64 places, of which the fingerprint (the XOR of the flipped places'
codes) stands for the word. Sketches that are compared have 64 places a word, folded at first.

Components, not pairs, are asked for:

1. Each class is tested against a leader or two, found by its few least words.
2. Blocks ask by all words which of them are in several components still. A set with
   fewer of those in a band than it must share with any link there has no more links there.
3. The others give their words, but for so many of the largest as they must share. Sets that share one with
   sets of another component are grouped by the least id among them; a task holds some groups with their sets,
   compares the sketches, verifies the pairs within the Hamming bound, and returns links that join components
   only: fewer than it has sets, however many pairs are similar.

Every pair is then connected, ruled out by its words or sketches, or tested: no link is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeforge.llm import blocks as B
from lakeforge.llm.hashing import Texts, mix

U64 = np.uint64


def shingle_sets(column: pa.ChunkedArray | pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles of each text, sorted, and the size of each set."""
    words = Texts(column, lower=True).words()
    code, n = words.hashes(), np.diff(words.off)
    room = words.room()
    at = np.flatnonzero(room >= k)
    h = np.full(len(at), U64(k))
    for j in range(k):
        h = mix(h) * U64(0x9E3779B97F4A7C15) + code[at + j]
    row = words.text_of_word()[at]
    few = np.flatnonzero((n > 0) & (n < k))  # the whole sequence is the one shingle
    if len(few):
        own = n[few].astype(U64)
        for j in range(k - 1):
            some = n[few] > j
            own[some] = mix(own[some]) * U64(0x9E3779B97F4A7C15) + code[words.off[few[some]] + j]
        h, row = np.concatenate([h, own]), np.concatenate([row, few])
    h = mix(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
    h, row = h[fresh], row[fresh]
    return row, h, np.bincount(row, minlength=len(n))


class Bands:
    """Size bands for links at `percent`: neighbouring sizes that can link lie at most one band apart."""

    def __init__(self, percent: int, largest: int):
        edges = [1]
        while edges[-1] <= largest:
            edges.append(100 * edges[-1] // percent + 1)
        edges.append(100 * edges[-1] // percent + 1)
        self.edges = np.array(edges)
        #: The largest symmetric difference of two sets that link, up to the band's upper size.
        self.most = (100 - percent) * 2 * (self.edges[1:] - 1) // (100 + percent)
        #: Parts: some more than that, so that more than one word is equal; none where only equal sets link.
        self.parts = np.where(self.most > 0, self.most + 4 + self.most // 7, 0)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, size, side="right") - 1


def part_of(h: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    return (mix(h ^ U64(0x5851F42D4C957F2D)) % np.asarray(parts, U64)).astype(np.int64)


def sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray, bands: Bands, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band of each set (its own, or with step 1 the next), its number of words there (0 if empty), and all wide words."""
    band = bands.of(np.maximum(size, 1)) + step
    parts = np.where(size > 0, bands.parts[np.minimum(band, len(bands.parts) - 1)], 0)
    base = np.cumsum(parts) - parts
    word = np.zeros(int(parts.sum()), U64)
    some = parts[row] > 0
    row, h = row[some], h[some]
    np.bitwise_xor.at(word, base[row] + part_of(h, parts[row]), mix(h + U64(0x14057B7EF767814F)))
    return band, parts, word


def sketch_keys(row: np.ndarray, h: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, key, need) of the wide words of every set, in its own band and the next.

    Of two sets that link, parts - most words at least are equal. A set with fewer zero words than that shares one
    that isn't zero, and its zero words, which many sets have, are left out; else so many are zero in both sets.
    `need`: how many of its words at least a set shares in that band with each set that it links to.
    """
    out = []
    for step in (0, 1):
        band, parts, word = sketches(row, h, size, bands, step)
        owner = np.repeat(np.arange(len(size)), parts)
        part = np.arange(len(word)) - (np.cumsum(parts) - parts)[owner]
        zeros = np.bincount(owner[word == 0], minlength=len(size))
        equal = parts - bands.most[np.minimum(band, len(bands.most) - 1)]
        all_of = zeros >= equal
        need = np.where(all_of, 1, equal - zeros)
        use = (word != 0) | all_of[owner]
        owner, part, word = owner[use], part[use], word[use]
        out.append((owner, band[owner], mix(word ^ mix((band[owner].astype(U64) << U64(40)) | part.astype(U64))), need[owner]))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


#: Words folded into one for comparison.
FOLD = 8


def fold(words: np.ndarray) -> np.ndarray:
    """An eighth of each row's words, each the XOR of eight: a coarser parity sketch, whose distances are bounds as well."""
    n = -(-words.shape[1] // FOLD)
    padded = np.concatenate([words, np.zeros((len(words), FOLD * n - words.shape[1]), U64)], axis=1)
    return np.bitwise_xor.reduce(padded.reshape(len(words), FOLD, n), axis=1)


def parities(sets: list[np.ndarray], parts: int) -> np.ndarray:
    """A row of `parts` words of 64 places for each set."""
    row, h = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    word = np.zeros(len(sets) * parts, U64)
    np.bitwise_xor.at(word, row * parts + part_of(h, parts), U64(1) << (h >> U64(58)))
    return word.reshape(len(sets), parts)


class Union:
    """Components within a task."""

    def __init__(self, label: np.ndarray):
        self.up = label

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[b] = a
        return a != b

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


#: Pairs of sketches that are compared at a time, and bytes of sets in a chunk of a large group.
PAIRS, CHUNK_BYTES = 1 << 20, 16 << 20


def spanning_links(sets: list[np.ndarray], comp: np.ndarray, one: np.ndarray, two: np.ndarray, bands: Bands, percent: int) -> list[tuple[int, int]]:
    """Links between rows `one` and `two` (equal or disjoint) that join components, none twice.

    Pairs of different components meet in the larger set's band: folded sketches first, nearest pairs first, then
    whole sketches, then the sets.
    """
    size = np.array([len(x) for x in sets])
    own = bands.of(np.maximum(size, 1))
    _, first, label = np.unique(comp, return_index=True, return_inverse=True)
    union = Union(first[label.reshape(-1)])
    out: list[tuple[int, int]] = []

    def test(i: int, j: int) -> bool:
        if union.root(i) == union.root(j):
            return False
        a, b = sets[i], sets[j]
        shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        if 100 * shared < percent * (len(a) + len(b) - shared):
            return False
        out.append((i, j))
        return union.join(i, j)

    for band in np.unique(own):
        parts = int(bands.parts[band])
        x, y = (at[(own[at] == band) | (own[at] == band - 1)] for at in (one, two))
        if not parts or not len(x) or not len(y) or len(np.unique(union.roots()[np.concatenate([x, y])])) < 2:
            continue
        same = np.array_equal(x, y)
        wide_x = parities([sets[i] for i in x], parts)
        wide_y = wide_x if same else parities([sets[i] for i in y], parts)
        small_x, small_y = fold(wide_x), fold(wide_y)
        step = max(1, PAIRS // len(y))
        for k in range(0, len(x), step):
            at = x[k : k + step]
            distance = np.zeros((len(at), len(y)), np.int32)
            for c in range(small_x.shape[1]):
                distance += np.bitwise_count(small_x[k : k + step, c, None] ^ small_y[None, :, c])
            most = (100 - percent) * (size[at][:, None] + size[y][None]) // (100 + percent)
            fits = (distance <= most) & ((own[at] == band)[:, None] | (own[y] == band)[None])
            if same:
                fits &= np.arange(len(y))[None] > np.arange(k, k + len(at))[:, None]
            joined = True
            while joined:  # each row with the nearest of another component
                roots = union.roots()
                fits &= roots[at][:, None] != roots[y][None]
                rows = np.flatnonzero(fits.any(1))
                near = np.where(fits[rows], distance[rows], np.iinfo(np.int32).max).argmin(1)
                fits[rows, near] = False
                joined = sum([test(int(at[i]), int(y[j])) for i, j in zip(rows, near, strict=True)]) > 0
            i, j = np.nonzero(fits)
            for z in range(0, len(i), max(1, PAIRS // parts)):
                a, b = i[z : z + max(1, PAIRS // parts)], j[z : z + max(1, PAIRS // parts)]
                whole = np.bitwise_count(wide_x[k + a] ^ wide_y[b]).sum(1, dtype=np.int32)
                close = np.flatnonzero(whole <= most[a, b])
                close = close[np.argsort(whole[close], kind="stable")]
                for m, n in zip(at[a[close]].tolist(), y[b[close]].tolist(), strict=True):
                    test(m, n)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id in `edges` (a, b): the least id reachable. Labels spread and jump until none changes."""
    both = B.checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = B.checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        spread = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        near = label.join(spread, "id").select("id", "comp", F.least("comp", "m").alias("next"))
        jump = label.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        new = B.checkpoint(near.join(jump, "next", "left").select("id", "comp", F.least("next", "far").alias("new")))
        label = new.select("id", F.col("new").alias("comp"))
        if new.where("new < comp").isEmpty():
            return label


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, chunk_bytes: int = CHUNK_BYTES, first_words: int = 6) -> DataFrame:
    """Groups of texts whose shingle sets have at least `percent` hundredths of their union in common.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. A text's set: distinct shingles of `shingle` words; of
    fewer words the whole sequence is one; null texts and texts without words are linked with nothing. Returns
    id_col, n_shingles and component_id (the least id reachable by links, itself included; the id where there is
    none). One row per input row. Rows with one id are linked texts of that id. Rows with a null id belong to the
    component of an equal set, else to none (null). `first_words`: the words by which a set finds leaders; `chunk_bytes`:
    the sets of one group that a task compares with as many; neither changes the result. A very long text is a block
    and a chunk of its own. Ids must be integers. Other columns don't take part, whatever their names; an empty table
    gives no rows.
    """
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold integers")
    packed = B.pack(df, text_col, [id_col], block_bytes=2 << 20)
    blocks = packed.df.select("block", "payload")

    def measure(table: pa.Table, _, block: int) -> pd.DataFrame:
        row, h, size = shingle_sets(table[text_col], shingle)
        one, two = np.zeros(len(size), U64), np.zeros(len(size), U64)
        np.add.at(one, row, mix(h + U64(1)))
        np.add.at(two, row, mix(h ^ U64(0xA5A5A5A5A5A5A5A5)))
        return pd.DataFrame({"id": table[id_col].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get), "block": np.int64(block), "row": np.arange(len(size), dtype=np.int32), "n": size, "h1": one.view(np.int64), "h2": two.view(np.int64)})

    sets = B.checkpoint(B.each_block(packed, None, measure, "id long, block long, row int, n long, h1 long, h2 long"))
    classes = sets.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "block", "row")).alias("r"))
    classes = B.checkpoint(classes.select("h1", "h2", "n", "r.*"))
    largest = classes.agg(F.max("n")).first()[0] or 1
    bands = Bands(percent, largest)
    buckets = packed.buckets(1.0)

    def keys_of(payload: bytes, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in `rows`, band, key, need) of the words of some rows of a block."""
        return sketch_keys(*shingle_sets(B.unpack(payload).take(pa.array(rows))[text_col], shingle), bands)

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The least words of each set, in each of its bands."""
        if not len(left) or not len(right):
            return pd.DataFrame({"key": np.zeros(0, np.int64), "id": np.zeros(0, np.int64)})
        right = right.sort_values("row")
        row, band, key, _ = keys_of(left["payload"].iloc[0], right["row"].to_numpy())
        order = np.lexsort((key, band, row))
        row, band, key = row[order], band[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(band) != 0)])) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(starts, np.diff([*starts, len(row)]))
        some = rank < first_words
        return pd.DataFrame({"key": key[some].view(np.int64), "id": right["id"].to_numpy(np.int64)[row[some]]})

    least = B.checkpoint(blocks.groupBy("block").cogroup(classes.select("block", "row", "id").groupBy("block")).applyInPandas(first, "key long, id long"))
    sizes = least.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    fame = least.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("fame"))
    # A group's leader is the member whose words most sets have: of the copies of one text, that text.
    known = least.join(fame, "id")
    leads = known.groupBy("key").agg(F.max(F.struct("fame", -F.col("id"))).alias("x"), F.count("*").alias("n")).where("n > 1")
    leads = leads.select("key", (-F.col("x.col2")).alias("leader"))
    place = classes.select("id", "block", "row")

    def take(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The sets of some rows of a block."""
        rows = np.unique(right["row"].to_numpy()) if len(left) else np.zeros(0, np.int32)
        if not len(rows):
            return pd.DataFrame({"block": np.zeros(0, np.int64), "row": np.zeros(0, np.int32), "set": pd.Series([], dtype=object)})
        row, h, _ = shingle_sets(B.unpack(left["payload"].iloc[0]).take(pa.array(rows))[text_col], shingle)
        cut = np.searchsorted(row, np.arange(len(rows) + 1))
        return pd.DataFrame({"block": left["block"].iloc[0], "row": rows, "set": pd.Series([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], dtype=object)})

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        """Links that join components of some groups: within a chunk of one or between two."""
        order = np.lexsort([frame[c].to_numpy() for c in ("id", "q", "p", "least")])
        least, p, q, chunk, ids, comp = (frame[c].to_numpy()[order] for c in ("least", "p", "q", "chunk", "id", "comp"))
        blobs = frame["set"].to_numpy()[order]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)]))
        out = [np.zeros((0, 2), np.int64)]
        for x, y in zip(heads, [*heads[1:], len(order)], strict=True):
            pairs = spanning_links([np.frombuffer(b, U64) for b in blobs[x:y]], comp[x:y], np.flatnonzero(chunk[x:y] == p[x]), np.flatnonzero(chunk[x:y] == q[x]), bands, percent)
            if pairs:
                out.append(ids[x:y][np.array(pairs)])
        a, b = np.concatenate(out).T
        return pd.DataFrame({"a": a, "b": b})

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links between rows of a block and sets that were sent to it."""
        a, b = [], []
        if len(left) and len(right):
            rows = np.unique(np.concatenate(right["rows"].to_list()))
            row, h, _ = shingle_sets(B.unpack(left["payload"].iloc[0]).take(pa.array(rows))[text_col], shingle)
            cut = np.searchsorted(row, np.arange(len(rows) + 1))
            for theirs, mine, ids, lead in zip(right["set"], right["rows"], right["ids"], right["leader"], strict=True):
                theirs = np.frombuffer(theirs, U64)
                for r, i in zip(np.searchsorted(rows, mine), ids, strict=True):
                    own = h[cut[r] : cut[r + 1]]
                    at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
                    shared = int((theirs[at] == own).sum())
                    if 100 * shared >= percent * (len(own) + len(theirs) - shared):
                        a.append(i)
                        b.append(lead)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (id, leader): a leader's set goes once to each block that has its partners."""
        leads = pairs.select(F.col("leader").alias("id")).distinct().join(place, "id")
        found = blocks.groupBy("block").cogroup(leads.select("block", "row").groupBy("block")).applyInPandas(take, "block long, row int, set binary")
        found = found.join(place, ["block", "row"]).select(F.col("id").alias("leader"), "set")
        sent = pairs.join(place, "id").groupBy("block", "leader").agg(F.collect_list("row").alias("rows"), F.collect_list("id").alias("ids"))
        return B.checkpoint(blocks.groupBy("block").cogroup(sent.join(found, "leader").groupBy("block")).applyInPandas(test, "a long, b long"))

    # First each class against the two leaders with which it has the most of its first words in common.
    votes = least.join(leads, "key").where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("n", -F.col("leader"))), asc=False), 1, 2)
    asked = votes.groupBy("id").agg(top.alias("x")).select("id", F.explode("x").alias("x"))
    edges = verified(B.checkpoint(asked.select("id", (-F.col("x.col2")).alias("leader"))))
    label = components(edges)

    # Then: which words are in several components?
    def hold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        blob = B.squeeze(frame["row"].to_numpy(np.int64), frame["id"].to_numpy(np.int64), frame["comp"].to_numpy(np.int64))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "round": np.int32(0), "bucket": np.int32(0), "blob": [blob]})

    members = place.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    held = B.checkpoint(members.groupBy("block").applyInPandas(hold, B.REPLY))

    def words_of(table: pa.Table, have: B.Replies) -> tuple:
        """Words of a block's classes by key: place, band, key, need; starts of equal keys; ids; components."""
        rows, ids, comp = B.expand(have[0][0], "i8", "i8", "i8") if 0 in have else (np.zeros(0, np.int64),) * 3
        row, band, key, need = sketch_keys(*shingle_sets(table.take(pa.array(rows))[text_col], shingle), bands)
        key >>= U64(16)
        order = np.argsort(key, kind="stable")
        row, band, key, need = row[order], band[order], key[order], need[order]
        return row, band, key, need, B.runs_of(key), ids, comp

    def emit(table: pa.Table, have: B.Replies, _: int) -> list[tuple[int, bytes]]:
        """Each key once, with the least and the greatest component that have it in the block."""
        row, _, key, _, starts, _, comp = words_of(table, have)
        if not len(key):
            return []
        low, high = np.minimum.reduceat(comp[row], starts), np.maximum.reduceat(comp[row], starts)
        key = key[starts]
        return [(b, B.squeeze_numbers(np.diff(key[x:y], prepend=U64(0)).view(np.int64), low[x:y], high[x:y] - low[x:y])) for b, x, y in B.split(key << U64(16), buckets)]

    def judge(blobs: list[bytes], _: list[int]) -> list[bytes]:
        read = [B.expand_numbers(blob, 3) for blob in blobs]
        key = np.concatenate([np.cumsum(x[0]) for x in read])
        low = np.concatenate([x[1] for x in read])
        high = np.concatenate([x[1] + x[2] for x in read])
        order = np.argsort(key, kind="stable")
        starts = B.runs_of(key[order])
        several = np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts)
        flags = np.empty(len(key), bool)
        flags[order] = np.repeat(several, np.diff([*starts, len(key)]))
        return [B.bits(x) for x in np.split(flags, np.cumsum([len(x[0]) for x in read])[:-1])]

    def narrow(table: pa.Table, have: B.Replies, _: int) -> pd.DataFrame:
        """The words of sets that have enough words in several components, but for the largest that they must share."""
        row, band, key, need, starts, ids, comp = words_of(table, have)
        flags = np.zeros(len(starts), bool)
        for b, x, y in B.split(key[starts] << U64(16), buckets):
            flags[x:y] = B.flags_of(have[1][b], y - x)
        some = np.repeat(flags, np.diff([*starts, len(key)]))
        row, band, key, need = row[some], band[some], key[some], need[some]
        order = np.lexsort((key, band, row))
        row, band, key, need = row[order], band[order], key[order], need[order]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(band) != 0)])) if len(row) else np.zeros(0, np.int64)
        n = np.diff([*heads, len(row)])
        rank = np.arange(len(row)) - np.repeat(heads, n)
        use = rank <= np.repeat(n, n) - need
        return pd.DataFrame({"key": key[use].view(np.int64), "band": band[use].astype(np.int32), "id": ids[row[use]], "comp": comp[row[use]]})

    answers = B.answer(B.ask(packed, held, emit), 1, judge)
    known = B.checkpoint(B.each_block(packed, held.unionByName(answers), narrow, "key long, band int, id long, comp long"))
    # Of groups of equal words that hold several components: all sets with the least id of their group.
    mixed = known.groupBy("key").agg(F.min("id").alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "least")
    near = B.checkpoint(known.join(mixed, "key").select("least", "id", "comp").distinct().join(classes.select("id", "n"), "id"))
    held_bytes = near.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 8
    if held_bytes:
        wanted = near.select("id").distinct().join(place, "id").select("block", "row")
        found = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(take, "block long, row int, set binary")
        found = B.checkpoint(found.join(place, ["block", "row"]).select("id", "set"))
        # A large group is compared by pairs of its chunks, so that no task holds all of it; small ones share tasks.
        chunks = near.groupBy("least").agg(F.ceil(F.sum("n") * 8 / chunk_bytes).cast("long").alias("chunks"))
        dealt = near.drop("n").join(chunks, "least").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        dealt = dealt.withColumn("p", F.least("chunk", "other")).withColumn("q", F.greatest("chunk", "other"))
        task = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("least"), F.lit(2 * held_bytes // chunk_bytes + 64))).otherwise(F.xxhash64("least", "p", "q"))
        dealt = dealt.select("least", "id", "comp", "chunk", "p", "q", task.alias("task")).join(found, "id")
        more = B.checkpoint(dealt.groupBy("task").applyInPandas(link, "a long, b long"))
        if not more.isEmpty():
            label = components(edges.unionByName(more))
    out = sets.join(classes.select("h1", "h2", "n", F.col("id").alias("rep")), ["h1", "h2", "n"], "left")
    out = out.join(label.withColumnRenamed("id", "rep"), "rep", "left")
    kind = df.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "id").cast(kind).alias("component_id"))
