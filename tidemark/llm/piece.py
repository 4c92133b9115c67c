"""SentencePiece BPE by vectorised merge rounds, and its inverse.

A text's symbols lie in flat numpy arrays.  In each round every word finds
the best (smallest) rank among its adjacent pairs by a segmented minimum and
merges the leftmost pairs of that rank; words without a mergeable pair leave,
the rest is compacted, until none is left.  Only the pairs of new products are
looked up again.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Bounded, groups, map_arrow, ragged

SPACE = "▁"
NONE = np.int64(1 << 40)
UNKNOWN = 1 << 24  # symbols at or above: characters without a piece
CACHE_WORDS = 200_000
NORMAL, CONTROL, BYTE = 1, 3, 6
#: Symbols from which on a part whose products pair at once is merged one by one.
LONG_PART = 64


class PieceModel:
    """Vocabulary, pair ranks and byte pieces of a model file (BPE with byte
    fallback, identity normaliser, dummy prefix)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules, spec = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if spec.model_type != 2 or not spec.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or kinds - {1, 2, 3, 6}:
            raise ValueError("only BPE with byte fallback, identity normaliser and dummy prefix")
        self.size = len(proto.pieces)
        self.bos, self.eos = spec.bos_id, spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        alphabet = {c for p in self.ids for c in p}
        #: symbol of every code point: its piece, else UNKNOWN + code point
        self.symbol = np.arange(0x110000, dtype=np.int64) + UNKNOWN
        for c in alphabet & self.ids.keys():
            self.symbol[ord(c)] = self.ids[c]
        scores = sorted({proto.pieces[i].score for i in self.ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        symbol_of = lambda s: self.ids[s] if s in self.ids else int(self.symbol[ord(s)]) if len(s) == 1 else None
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol_of(piece[:cut]), symbol_of(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank_of[proto.pieces[i].score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # no piece holds these across, so texts are cut there
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces cross words")
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if "\n" in alphabet else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        #: pairs of characters that stand side by side in some piece
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in self.ids for a, b in itertools.pairwise(p)}), np.int64)
        self._table: dict[int, tuple[int, int]] | None = None
        self._decoder(proto)

    def _decoder(self, proto) -> None:
        raw = []
        for p in proto.pieces:
            if p.type == BYTE:
                raw.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                raw.append(b"")
            elif p.type == 2:
                raw.append(proto.trainer_spec.unk_surface.encode())
            else:
                raw.append(p.piece.replace(SPACE, " ").encode())
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        kinds = np.array([p.type for p in proto.pieces])
        self.is_plain, self.is_control = kinds == NORMAL, kinds == CONTROL

    # -- encoding --------------------------------------------------------
    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    @staticmethod
    def _leftmost(chosen: np.ndarray) -> np.ndarray:
        """Of positions that follow each other every other one, from the left."""
        at = np.flatnonzero(chosen)
        if not len(at):
            return at
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) != 1
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - first) % 2 == 0]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (a non-empty run between cuts).

        Words are cut further between characters that no piece holds side by
        side, for nothing merges there.  In a round every part merges the
        leftmost pairs of its best rank.  A product that pairs with a
        neighbour at a better rank would be merged on at once by the library,
        so a part's round ends with the first such product; a long part with
        one is left to ``_one_by_one``.
        """
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sym = self.symbol[codes]
        word = np.repeat(np.arange(len(words)), lengths)
        beside = codes[:-1] << 21 | codes[1:]
        joint = self.beside[np.minimum(np.searchsorted(self.beside, beside), len(self.beside) - 1)] == beside
        inside = joint & (word[1:] == word[:-1])
        owner = word[np.flatnonzero(np.r_[True, ~inside])]
        part = np.cumsum(np.r_[0, ~inside])
        done_sym, done_part = [], []
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1)
        at = np.flatnonzero(inside)
        rank[at], made[at] = self._rank(sym[at], sym[at + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            each = np.repeat(np.minimum.reduceat(rank, first), size)
            over = each == NONE
            if over.any():
                done_sym.append(sym[over])
                done_part.append(part[over])
                live = ~over
                sym, part, rank, made, each = sym[live], part[live], rank[live], made[live], each[live]
                if not len(sym):
                    break
            at = self._leftmost(rank == each)
            best, product, own = rank[at], made[at], part[at]
            # the pairs of each product with its neighbours at the time of its merge
            beside = np.r_[False, at[1:] - 2 == at[:-1]] & np.r_[False, own[1:] == own[:-1]]
            before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
            has_left, has_right = (at > 0) & (part[before] == own), (at + 2 < len(sym)) & (part[after] == own)
            left = np.where(beside, np.r_[0, product[:-1]], sym[before])
            l_rank, l_made = self._rank(left, product)
            r_rank, r_made = self._rank(product, sym[after])
            l_rank, r_rank = np.where(has_left, l_rank, NONE), np.where(has_right, r_rank, NONE)
            early = (l_rank <= best) | (r_rank <= best)
            if early.any():
                earlier = np.cumsum(early) - early
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                stay = earlier == np.repeat(earlier[start], np.diff(np.r_[start, len(own)]))
                at, product, beside, has_left, l_rank, l_made, r_rank, r_made = (x[stay] for x in (at, product, beside, has_left, l_rank, l_made, r_rank, r_made))
                long = np.isin(part, own[early])
                long &= np.bincount(part, minlength=len(owner))[part] > LONG_PART
                if long.any():
                    for p in np.unique(part[long]).tolist():
                        ids = self._one_by_one(sym[part == p].tolist())
                        done_sym.append(np.array(ids, np.int64))
                        done_part.append(np.full(len(ids), p))
                    live, mine = ~long, ~long[at]
                    place = np.cumsum(live) - 1
                    sym, part, rank, made = sym[live], part[live], rank[live], made[live]
                    at, product, beside, has_left, l_rank, l_made, r_rank, r_made = (x[mine] for x in (place[at], product, beside, has_left, l_rank, l_made, r_rank, r_made))
                    if not len(at):
                        continue
            follows = np.r_[beside[1:], False]
            sym[at] = product
            rank[at] = np.where(follows, np.r_[l_rank[1:], 0], r_rank)
            made[at] = np.where(follows, np.r_[l_made[1:], 0], r_made)
            free = has_left & ~beside
            rank[at[free] - 1], made[at[free] - 1] = l_rank[free], l_made[free]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, part, rank, made = sym[keep], part[keep], rank[keep], made[keep]
        sym, part = np.concatenate(done_sym), np.concatenate(done_part)
        order = np.argsort(part, kind="stable")
        sym, word = sym[order], owner[part[order]]
        if (odd := sym >= UNKNOWN).any():
            sym, word = self._bytes(sym, word, odd)
        ends = np.searchsorted(word, np.arange(len(words)), "right")
        return np.split(sym.astype("<u4"), ends[:-1])

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """One merge at a time, the best rank first, then the leftmost: a heap
        of pairs over a linked list."""
        if self._table is None:
            self._table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        find = self._table.get
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, sym[i], sym[i + 1], found[1]) for i in range(n - 1) if (found := find(sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, product = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = product, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if found := find(product << 32 | sym[k]):
                    heapq.heappush(heap, (found[0], i, product, sym[k], found[1]))
            if (h := left[i]) >= 0 and (found := find(sym[h] << 32 | product)):
                heapq.heappush(heap, (found[0], h, sym[h], product, found[1]))
        return [x for x in sym if x >= 0]

    def _bytes(self, sym, word, odd):
        """Characters without a piece as their UTF-8 bytes' pieces."""
        codes = sym[odd] - UNKNOWN
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(c) for c in coded]
        out, owner = np.repeat(sym, size), np.repeat(word, size)
        out[np.repeat(odd, size)] = self.bytes[np.frombuffer(b"".join(coded), np.uint8)]
        return out, owner

    def parts(self, text: str) -> list[str]:
        """The words of a text with its dummy prefix; none of the empty text."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    # -- decoding --------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, one leading blank goes, byte
        runs that are no UTF-8 become one U+FFFD a byte."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.is_control[ids]]
        if not len(ids):
            return ""
        data = self.raw[ragged(self.raw_at[ids], self.raw_len[ids])].tobytes()
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("utf-8", "tidemark_each_byte")
        return text[1:] if text.startswith(" ") and self.is_plain[ids[0]] else text


def _each_byte(error):
    return "�", error.start + 1


import codecs  # noqa: E402

codecs.register_error("tidemark_each_byte", _each_byte)


class Pieces:
    """Texts to ids through a bounded cache of words."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.cache: Bounded = Bounded(CACHE_WORDS)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.model.parts(t) for t in texts]
        cache = self.cache
        if fresh := cache.missing(set().union(*parts)):
            cache.update(zip(fresh, (x.tobytes() for x in self.model.words(fresh)), strict=True))
        ends = np.array([self.model.bos], "<u4").tobytes(), np.array([self.model.eos], "<u4").tobytes()
        return [np.frombuffer(b"".join([ends[0], *[cache[w] for w in p], ends[1]]), "<u4") for p in parts]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process and model file."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode_texts(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Every row's ids (begin and end included) and their decoded text:
    columns ``keep``, ids array<int>, decoded string.  A null text counts as
    the empty one, whose ids are begin and end alone; texts and words may be of
    any length.  Rows are independent, repeated ones too; no shuffle.  Columns
    not in ``keep`` are not read; ``keep`` names neither ids nor decoded."""
    keep = keep or ["doc_id"]

    def run(batches):
        tool = pieces(model)
        for batch in batches:
            for low, texts in groups(batch.column("text").to_pylist()):
                ids = tool.encode(texts)
                cut = batch.slice(low, len(texts))
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(cut.column(k) for k in keep), flat, pa.array([tool.model.decode(x) for x in ids], pa.string())], [*keep, "ids", "decoded"])
        # other stages follow in the same worker: it keeps no words for them
        tool.cache.clear()
        tool.cache.old = {}

    source = docs.select(*keep, F.col("text").cast("string").alias("text")) if "text" not in keep else docs.select(*keep)
    types = dict(source.dtypes)
    return map_arrow(source, run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "ids array<int>", "decoded string"]))


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, texts as in
    ``encode_texts``; other columns are not read."""

    def run(batches):
        tool = pieces(model)
        for batch in batches:
            for low, texts in groups(batch.column("text").to_pylist()):
                ids = tool.encode(texts)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, len(texts)), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.tobytes()) for x in ids]), pa.array([sha(tool.model.decode(x).encode()) for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(source, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
