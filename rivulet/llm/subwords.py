"""SentencePiece encoding of merge-type (BPE) vocabularies, and decoding.

The encoder starts from a text's characters and keeps an agenda of adjacent
symbol pairs whose concatenation is a piece. It takes the pair with the best
score, of equal ones the leftmost, merges it, and puts the new neighbours'
pairs on the agenda, until it is empty. What is then not a piece becomes its
UTF-8 bytes' pieces.

Where no piece has the space sign after another character, pairs never cross
the start of a run of space signs, so a text falls into segments with agendas
of their own. Short segments are encoded together: one round takes the best
pair of every segment at once, in NumPy, and the results of recurring segments
are kept. A long segment gets a heap. The segments of an Arrow batch that are
not among the kept results are encoded by the sentencepiece library as well; a
text with a segment on which the two differ takes the library's ids and is
marked in ``agreed``. So each segment is checked when it is first met, and no
text as a whole.

Defined cases: a null text is empty and has the end id alone; a null doc_id is
carried along; repeated rows are encoded each; texts are encoded whole. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, steps

SPACE, LONG, KEPT = "▁", 48, 1_000_000
_NONE = np.iinfo(np.int32).max
_MADE: dict = {}


_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Numbers(dict):
    """Numbers segments in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class MergeEncoder:
    """Encoder for the BPE model in ``file``; only ``library`` reads the file."""

    def __init__(self, file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=file)
        self.end_id = sp.eos_id()
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.has_bytes = all(sp.is_byte(int(i)) for i in self.bytes)
        # symbols: the pieces by their ids, then single characters that only occur within pieces
        symbol = dict(self.piece)
        for c in sorted({c for p in self.piece for c in p}):
            symbol.setdefault(c, size + len(symbol) - len(self.piece))
        self.symbols = size + len(symbol) - len(self.piece)
        self.id_of = np.full(self.symbols + 1, -1, np.int32)  # the last symbol: characters that no piece has
        for p, i in self.piece.items():
            self.id_of[i] = i
        self.code = np.full(0x110000, self.symbols, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.code[ord(s)] = i
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs = {}
        for p, i in self.piece.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (self.symbols + 1) + b] = (order[sp.get_score(i)], i)
        self.pairs = pairs
        # the same table for arrays of pairs: open addressing, a quarter full at most
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rank, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32), np.full(1 << bits, -1, np.int32)
        for key, at in zip(pairs, self.slot(np.array([*pairs], np.int64)).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], (self.rank[at], self.made[at]) = key, pairs[key]
        self.cuts = not any(b == SPACE and a != SPACE for p in self.piece for a, b in zip(p, p[1:]))
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.differ: set[str] = set()
        self.unsure: set[str] = set()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def segments(self, text: str) -> list[str]:
        """Segments of a normalised text, each without the space sign that it begins with."""
        if not self.cuts:
            return [text[1:]]
        if SPACE * 2 not in text:
            return text[1:].split(SPACE)
        return [s[1:] for s in _SEGMENT.findall(text)]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (lower is better) and result of merging a and b."""
        key = a.astype(np.int64) * (self.symbols + 1) + b
        at = self.slot(key)
        found = self.keys[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        return self.rank[at], self.made[at]  # an empty place has no rank

    def spelled(self, symbol: int, char: str) -> list[int]:
        """Ids of a symbol that nothing is merged with any more."""
        found = int(self.id_of[symbol])
        return [found] if found >= 0 else self.bytes[list(char.encode())].tolist()

    def by_heap(self, text: str) -> list[int]:
        """The agenda as a heap, for one segment."""
        n = len(text)
        symbol = [int(self.code[ord(c)]) for c in text]
        left, right, size = list(range(-1, n - 1)), [*range(1, n), -1], [1] * n
        agenda: list[tuple[int, int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (got := self.pairs.get(symbol[i] * (self.symbols + 1) + symbol[j])):
                heapq.heappush(agenda, (got[0], i, j, symbol[i], symbol[j], got[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b, made = heapq.heappop(agenda)
            if not size[i] or not size[j] or right[i] != j or symbol[i] != a or symbol[j] != b:
                continue  # one of the two is gone or has grown
            symbol[i], size[i], size[j], right[i] = made, size[i] + size[j], 0, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for i in range(n) if size[i] for x in self.spelled(symbol[i], text[i])]

    def by_rounds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short segments in a row, and how many each has."""
        n, whole = len(texts), "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, n)
        symbol, seg, at = self.code[code], np.repeat(np.arange(n), length), np.arange(len(code))
        rank, made = self.find(symbol[:-1], symbol[1:])
        rank[seg[1:] != seg[:-1]] = _NONE
        rank, made = np.append(rank, _NONE).astype(np.int32), np.append(made, -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            count = np.diff(np.append(first, len(seg)))
            best = np.repeat(np.minimum.reduceat(rank, first), count)
            open_ = best < _NONE
            if not open_.all():
                done.append((at[~open_], symbol[~open_]))
                symbol, seg, at, rank, made, best = (x[open_] for x in (symbol, seg, at, rank, made, best))
                if not len(symbol):
                    break
            take = np.flatnonzero(rank == best)
            take = take[np.append(True, seg[take][1:] != seg[take][:-1])]
            symbol[take] = made[take]
            keep = np.ones(len(symbol), bool)
            keep[take + 1] = False
            moved = take - np.arange(len(take))  # where the merged symbols stand after the others are gone
            symbol, seg, at, rank, made = (x[keep] for x in (symbol, seg, at, rank, made))
            inner = np.concatenate((moved - 1, moved))
            inner = inner[(inner >= 0) & (inner < len(symbol) - 1)]
            r, m = self.find(symbol[inner], symbol[inner + 1])
            r[seg[inner] != seg[inner + 1]] = _NONE
            rank[inner], made[inner] = r, m
            rank[-1] = _NONE
        at = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)
        symbol = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int32)
        order = np.argsort(at)
        at, ids = at[order], self.id_of[symbol[order]]
        seg = np.repeat(np.arange(n), length)[at]
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters that are no piece: their bytes
            spelled = [self.bytes[list(whole[i].encode())] for i in at[odd].tolist()]
            many = np.ones(len(ids), np.int64)
            many[odd] = [len(x) for x in spelled]
            out, to = np.repeat(ids, many), np.cumsum(many) - many
            for k, x in zip(to[odd].tolist(), spelled):
                out[k : k + len(x)] = x
            ids, seg = out, np.repeat(seg, many)
        return ids, np.bincount(seg, minlength=n)

    def checked(self, new: list[str], ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of the segments, ``many`` of each, held against the library's."""
        self.unsure.update(s for s, n in zip(new, self.library.normalize(new), strict=True) if n != SPACE + s)
        theirs = self.library.encode(new, num_threads=1)
        count = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(itertools.chain.from_iterable(theirs), np.int32, int(count.sum()))
        if np.array_equal(count, many) and np.array_equal(flat, ids):
            return ids, many
        own = np.split(ids, np.cumsum(many)[:-1])
        for k, s in enumerate(new):
            if s not in self.unsure and own[k].tolist() != theirs[k]:
                self.differ.add(s)
                own[k] = np.array(theirs[k], np.int32)
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)

    def learn(self) -> None:
        """Encode the segments that have got numbers but no ids."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        short = [k for k, s in enumerate(new) if len(s) < LONG]
        ids, many = self.by_rounds([SPACE + new[k] for k in short]) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(short) < len(new):
            parts = dict(zip(short, np.split(ids, np.cumsum(many)[:-1]) if short else [], strict=True))
            parts |= {k: np.array(self.by_heap(SPACE + s), np.int32) for k, s in enumerate(new) if k not in parts}
            ids, many = np.concatenate([parts[k] for k in range(len(new))]), np.array([len(parts[k]) for k in range(len(new))], np.int64)
        ids, many = self.checked(new, ids.astype(np.int32), many)
        self.ids = np.concatenate((self.ids, ids)).astype(np.int32)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(many)))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, without an end id, and whether the library gave the same ones."""
        if not self.has_bytes:
            raise ValueError("the vocabulary has no piece for each byte")
        if len(self.known) > KEPT:
            self.forget()
        normal = self.library.normalize(texts)
        cuts = [self.segments(x) if x else [] for x in normal]
        number = self.known.__getitem__
        found = [np.fromiter(map(number, c), np.int64, len(c)) for c in cuts]
        self.learn()
        out, agreed = [], []
        for text, n, c, which in zip(texts, normal, cuts, found, strict=True):
            start = self.ends[which]
            many = self.ends[which + 1] - start
            place = np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)
            out.append(self.ids[place])
            agreed.append(not self.differ or self.differ.isdisjoint(c))
            if n and n[0] != SPACE or self.unsure and not self.unsure.isdisjoint(c):
                theirs = np.array(self.library.encode(text), np.int32)
                agreed[-1] = agreed[-1] and np.array_equal(theirs, out[-1])
                out[-1] = theirs
        return out, agreed


def encoder(file: str | None = None) -> MergeEncoder:
    """The process's encoder for this file, made once."""
    import public_tokenizers as public

    file = file or public.path("piece_bpe_32k.model")
    if file not in _MADE:
        _MADE[file] = MergeEncoder(file)
    return _MADE[file]


def encode_decode(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, ids (the end id last), decoded (the library's decode of them), agreed (with the library's encoding)."""

    def run(batches):
        e = encoder(file)
        for b in steps(batches):
            texts = b.column("text").to_pylist()
            own, agreed = e.encode(texts)
            flat = [np.append(x, np.int32(e.end_id)) for x in own]
            decoded = e.library.decode([x.tolist() for x in flat], num_threads=1)
            ends = np.cumsum([0, *map(len, flat)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(decoded, pa.string()), pa.array(agreed)], ["doc_id", "ids", "decoded", "agreed"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string, agreed boolean")
