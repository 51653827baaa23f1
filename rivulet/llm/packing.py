"""Best-fit packing of tokenised documents by a plan over length counts.

Documents are tokenised to pieces of at most ``size`` tokens. Only how many
pieces have each length goes to the driver: ``size`` counts, whatever the
corpus. ``plan`` runs best-fit-decreasing over these counts: sequences with
equal room form a segment of consecutive numbers, and one step puts as many
pieces of a length into a segment as it can take. A length leaves at most two
more segments than it found, so the plan stays small too. The plan is a table
of runs: ranks ``lo <= rank < hi`` of a length take slots from ``first_sequence``
on, ``each`` to a sequence, from ``offset``. A piece's rank within its length is
its place among those of its own task plus the pieces of that length in earlier
tasks; a join on length and rank gives its slot.

Nulls: a null text is empty, and an empty text has the end id alone; a null
doc_id is carried along. Repeated rows are packed each. Long texts are cut to
full pieces, with the shorter rest first. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only, steps

SIZE, END_ID = 1024, 2
_PIECES = "doc_id long, piece int, start long, length long, tokens binary, part int, place long"
_RUNS = "length long, lo long, hi long, first_sequence long, each long, offset long"
_MADE: dict = {}


class Encoder:
    """Ids as the tokenizers library gives them for the vocabulary ``json``.

    The rank file of the same vocabulary is several times faster and gives the
    same ids wherever no special token's string stands in the text (the tests
    compare the two on every seventh code point below 0x30000); other texts, and any on which the
    fast path fails, go to the tokenizers library itself.
    """

    def __init__(self, json: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the fast library's pattern gives up on some texts
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.full.encode(text, add_special_tokens=False).ids


def encoder(json: str | None = None, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """The process's encoder for these files, read once."""
    import public_tokenizers as public

    key = (json or public.path("byte_bpe_50k.json"), ranks or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN)
    if key not in _MADE:
        _MADE[key] = Encoder(*key)
    return _MADE[key]


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, after the rest if there is one."""
    rest = n % size
    cuts = [(0, rest)] if rest else []
    return cuts + [(s, size) for s in range(rest, n, size)]


def tokenize(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, files: tuple = ()) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, tokens (little-endian unsigned 32-bit), part, place.

    ``part`` and ``place`` number a piece among those of its task that have its length.
    """

    def run(batches):
        encode, part, seen = encoder(*files), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in steps(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                for k, (start, n) in enumerate(pieces_of(len(ids), size)):
                    rows.append((doc, k, start, n, ids[start : start + n].tobytes(), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "tokens", "part", "place"])

    return only(docs, "doc_id", "text").mapInArrow(run, _PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts by length; runs (length, lo, hi, first_sequence, each, offset)."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free tokens: (first sequence, sequences)
    runs, opened = [], 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank, free = counts[length], 0, length
        while left:
            while free < size and not room[free]:
                free += 1
            each = free // length
            if room[free]:
                first, have = room[free].pop()
            else:  # nothing has room: open what the rest needs
                first, have = opened, -(-left // each)
                opened += have
            full = min(have, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, size - free))
                room[free - each * length].append((first, full))
                rank, left, first, have = rank + full * each, left - full * each, first + full, have - full
            if have and left and left < each:
                runs.append((length, rank, rank + left, first, left, size - free))
                room[free - left * length].append((first, 1))
                first, have, left = first + 1, have - 1, 0
            if have:
                room[free].append((first, have))
    return runs


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with length, part, place) and the slot of each: sequence_id, offset."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    runs = spark.createDataFrame(plan({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size), _RUNS)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    runs = F.broadcast(runs.withColumnRenamed("length", "run_length"))  # its size depends on `size` alone
    at = (ranked["length"] == runs["run_length"]) & (ranked["rank"] >= runs["lo"]) & (ranked["rank"] < runs["hi"])
    nth = F.col("rank") - F.col("lo")
    slot = {"sequence_id": F.col("first_sequence") + F.expr("(rank - lo) div each"), "offset": F.col("offset") + (nth % F.col("each")) * F.col("length")}
    placed = ranked.join(runs, at).withColumn("sequence_id", slot["sequence_id"]).withColumn("offset", slot["offset"])
    return placed.drop("part", "place", "base", "rank", "run_length", "lo", "hi", "first_sequence", "each")


def pack_pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, files: tuple = ()) -> DataFrame:
    """All pieces with their tokens and slots: doc_id, piece, start, length, tokens, sequence_id, offset."""
    return assign(materialize(tokenize(docs, size, end_id, files), "pieces"), size)


def pack_sequences(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, files: tuple = ()) -> DataFrame:
    """Packed sequences: sequence_id, tokens (binary), and the doc_ids and offsets in order of place.

    A sequence holds at most ``size`` tokens, so no group here is large.
    """
    part = F.struct("offset", "doc_id", "piece", "tokens")
    got = pack_pieces(docs, size, end_id, files).groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["tokens"]))
    return got.select("sequence_id", joined.alias("tokens"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
