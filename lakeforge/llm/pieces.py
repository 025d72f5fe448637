"""SentencePiece BPE in vectorised merge rounds, and its decoding.

Texts are cut where a space symbol follows another symbol: no piece crosses such a
cut, so each run of spaces with the word behind it merges by itself. All distinct
words of a batch stand in one array of symbols. A round looks up the rank of every
neighbouring pair, takes each word's least rank, merges the leftmost non-overlapping
pairs of that rank in all words at once, and compacts the array. Words without a
mergeable pair leave it. A long word has its rounds by itself: linked symbols instead of compaction, and the places
of each rank kept, so that a round costs what it merges, not the word's length. Where a merged piece could merge further before the other
pairs of its rank, only the word's first pair is merged in that round, which is the
order that one merge at a time would take.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CACHE_WORDS = 200_000
_LONG_WORD = 1000

codecs.register_error("one-for-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    """Vocabulary and merges of a SentencePiece BPE model with byte fallback."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are known here")
        self.prefix = norm.add_dummy_prefix
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.unknown = proto.trainer_spec.unk_id
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind not in (_UNKNOWN, _CONTROL, _BYTE)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("a piece holds a space behind another symbol")
        self.byte_ids = np.zeros(256, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        #: Characters of pieces that are no pieces themselves get ids behind the vocabulary.
        extra = sorted({c for p in ids for c in p} - ids.keys())
        symbols = ids | {c: len(pieces) + i for i, c in enumerate(extra)}
        self.size, self.none = len(pieces), len(pieces) + len(extra)
        self.char_id = {c: i for c, i in symbols.items() if len(c) == 1}
        rank = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in ids.values()}, reverse=True))}
        merges = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    merges[(a << 32) | b] = (rank[pieces[i][1]], i)
        self.keys = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([merges[k][1] for k in self.keys.tolist()], np.int64)
        own = {i: rank[pieces[i][1]] for i in ids.values()}
        risky = {r for (r, i), k in zip(zip(self.ranks.tolist(), self.merged.tolist(), strict=True), self.keys.tolist(), strict=True) for part in (k >> 32, k & 0xFFFFFFFF) if part in own and own[part] >= r for r in (own[part],)}
        self.one_at_a_time = np.zeros(len(rank) + 1, bool)
        self.one_at_a_time[list(risky)] = True
        # decoding
        raw = [bytes([int(p[1:-1], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.silent = np.array([kind == _CONTROL for _, _, kind in pieces])
        self.cache: dict[str, bytes] = {}

    # --- encoding

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the last rank: none), and the symbol that it merges to."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.one_at_a_time) - 1), self.merged[at]

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """All merges of one word."""
        n, inf = len(sym), len(self.one_at_a_time) - 1
        sym = np.append(sym, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, to = np.full(n + 1, inf), np.zeros(n + 1, np.int64)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            rank[at], to[at] = self.pairs(sym[at], sym[after[at]])
            at = at[rank[at] < inf]
            order = np.argsort(rank[at], kind="stable")
            at, r = at[order], rank[at][order]
            edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
            for value, some in zip(r[edge].tolist(), np.split(at, edge[1:]), strict=False):
                if value not in places:
                    places[value] = []
                    heapq.heappush(heap, value)
                places[value].append(some)

        put(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.one_at_a_time[r]:
                if len(at) > 1:
                    places[r] = [at[1:]]
                    heapq.heappush(heap, r)
                at = at[:1]
            else:  # within a run of touching pairs every other one is merged
                new_run = np.concatenate([[True], at[1:] != after[at[:-1]]])
                begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            sym[at] = to[at]
            rank[gone], sym[gone] = inf, -1
            after[at] = after[gone]
            before[after[at]] = at
            put(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return sym[sym >= 0]

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of all words: symbols and word numbers, in order of words."""
        done = []
        inf = len(self.one_at_a_time) - 1
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], inf), inf)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff([*heads, len(sym)])
            least = np.minimum.reduceat(rank, heads)
            live = np.repeat(least < inf, size)
            if not live.all():
                done.append((sym[~live], word[~live]))
                pick = np.flatnonzero(live)
                if not len(pick):
                    break
                sym, word, rank = sym[pick], word[pick], rank[pick]
                at = np.append(at, 0)[pick]
                size, least = size[least < inf], least[least < inf]
                heads = np.concatenate([[0], np.cumsum(size)[:-1]])
            least_of = np.repeat(least, size)
            chosen = np.flatnonzero(rank == least_of)
            # within a run of touching pairs every other one is merged
            new_run = np.concatenate([[True], chosen[1:] != chosen[:-1] + 1])
            begin = np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))
            first = np.concatenate([[True], word[chosen][1:] != word[chosen][:-1]])
            chosen = chosen[((np.arange(len(chosen)) - begin) % 2 == 0) & (first | ~self.one_at_a_time[least_of[chosen]])]
            sym = sym.copy()
            sym[chosen] = self.merged[at[chosen]]
            stay = np.ones(len(sym), bool)
            stay[chosen + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = (np.concatenate([x[i] for x in done]) for i in (0, 1)) if done else (sym, word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of distinct words into the cache."""
        if not words:
            return
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) for w in words])
        distinct, of = np.unique(chars, return_inverse=True)
        # A character in no piece gets a symbol of its own, which merges with nothing.
        known = np.array([self.char_id.get(chr(c), self.none + i) for i, c in enumerate(distinct.tolist())], np.int64)
        sym, word = known[of], np.repeat(np.arange(len(words)), sizes)
        long = np.flatnonzero(sizes > _LONG_WORD)
        begin = np.cumsum(sizes) - sizes
        parts = [self.merge_long(sym[begin[i] : begin[i] + sizes[i]]) for i in long]
        short = np.repeat(sizes <= _LONG_WORD, sizes)
        sym, word = self.merge(sym[short], word[short])
        if len(long):
            sym, word = np.concatenate([sym, *parts]), np.concatenate([word, np.repeat(long, [len(x) for x in parts])])
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        if (sym >= self.size).any():
            spelled = {i: np.array([self.byte_ids[b] for b in chr(c).encode()]) for i, c in zip(known.tolist(), distinct.tolist(), strict=True) if i >= self.size}
            count = np.ones(len(sym), np.int64)
            odd = np.flatnonzero(sym >= self.size)
            count[odd] = [len(spelled[i]) for i in sym[odd].tolist()]
            place = np.cumsum(count) - count
            word = np.repeat(word, count)
            wide = np.repeat(sym, count)
            for i in odd.tolist():
                wide[place[i] : place[i] + count[i]] = spelled[int(sym[i])]
            sym = wide
        ids = sym.astype("<u4")
        off = np.searchsorted(word, np.arange(len(words) + 1))
        raw = ids.tobytes()
        self.cache.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words, off[:-1].tolist(), off[1:].tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        cut = [_WORDS.findall(((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else "") for t in texts]
        head, tail = (int(i).to_bytes(4, "little") for i in (self.bos, self.eos))
        out: list[bytes] = []
        at = 0
        while at < len(cut):
            if len(self.cache) > _CACHE_WORDS:
                self.cache.clear()
            to, fresh = at, set()
            while to < len(cut) and (to == at or len(fresh) < _CACHE_WORDS // 4):
                fresh.update(w for w in cut[to] if w not in self.cache)
                to += 1
            self.learn(list(fresh))
            get = self.cache.__getitem__
            out += [b"".join((head, *map(get, c), tail)) for c in cut[at:to]]
            at = to
        return out

    # --- decoding

    def decode(self, encoded: list[bytes]) -> list[str]:
        """The texts of id sequences: spaces for space symbols, bytes joined to characters, the first space dropped if it was put there."""
        out = []
        for raw in encoded:
            ids = np.frombuffer(raw, "<u4").astype(np.int64)
            n = self.lengths[ids]
            at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            spoken = ids[~self.silent[ids]]
            data = self.data[at]
            if self.prefix and len(spoken) and not (self.byte_ids == spoken[0]).any() and data[:1] == 32:
                data = data[1:]
            out.append(data.tobytes().decode("utf-8", "one-for-each-byte"))
        return out


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes every text as the model's library does, with begin and end ids and no sampling, and decodes the ids.

    Long texts are encoded whole, and long words in time that grows as their length. A null or empty text has begin and end alone and decodes to "". Returns id_col, the columns `keep`, n_tokens,
    ids (binary: little-endian unsigned 32-bit integers) and decoded. One row per input row, whatever its id; other
    columns don't take part; an empty table gives no rows. A narrow pass: no shuffle, a lost task is read again.
    The model file (its size is that of a vocabulary) is read by the driver and goes out with the task.
    """
    with open(model_path, "rb") as f:
        blob = f.read()
    keep = [id_col, *[c for c in keep or [] if c != id_col]]
    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string("n_tokens long, ids binary, decoded string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(blob)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = model.encode([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
                fields = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*fields, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(model.decode(ids), pa.string())],
                    names=[*keep, "n_tokens", "ids", "decoded"],
                )

    text = "__text"
    while text in keep:
        text += "_"
    return df.select(*keep, df[text_col].alias(text)).mapInArrow(run, schema)
