import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rivulet.llm import packing
from rivulet.llm.queries import packed

from .cases import awkward, table


def full():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_librarys_for_every_character():
    fast, library = packing.encoder(), full()
    texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}.  {chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += ["x <|endoftext|> y", "<|endoftext|>", "  " * 500, "\n" * 999, "ab" * 5000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast(text) == want.ids


def test_pieces_put_the_rest_first():
    assert packing.pieces_of(5, 10) == [(0, 5)]
    assert packing.pieces_of(20, 10) == [(0, 10), (10, 10)]
    assert packing.pieces_of(23, 10) == [(0, 3), (3, 10), (13, 10)]


def expand(runs):
    """All slots of a plan: sequence -> sorted (offset, length)."""
    out = defaultdict(list)
    for length, lo, hi, first, each, offset in runs:
        for rank in range(lo, hi):
            out[first + (rank - lo) // each].append((offset + (rank - lo) % each * length, length))
    return {k: sorted(v) for k, v in out.items()}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 60), max_size=25))
def test_plan_places_every_piece_once_without_gaps(counts):
    runs = packing.plan(counts, 40)
    ranks = defaultdict(list)
    for length, lo, hi, *_ in runs:
        ranks[length] += range(lo, hi)
    assert {n: len(r) for n, r in ranks.items()} == {n: c for n, c in counts.items() if c}
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for slots in expand(runs).values():
        at = 0
        for offset, length in slots:
            assert offset == at
            at += length
        assert at <= 40


def test_plan_is_best_fit_decreasing():
    counts = {700: 3, 500: 4, 324: 5, 100: 9, 24: 7}
    rooms = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= length]
        if fit:
            k = min(fit, key=lambda k: rooms[k])
            rooms[k] -= length
        else:
            rooms.append(1024 - length)
    got = expand(packing.plan(counts))
    assert Counter(1024 - sum(n for _, n in v) for v in got.values()) == Counter(rooms)


def test_plan_size_does_not_follow_the_counts():
    few, many = ({n: k * (n * 7919 % 97 + 1) for n in range(1, 1025)} for k in (10, 10_000_000))
    assert len(packing.plan(many)) < 3 * len(packing.plan(few)) + 5000


def test_query_against_brute_force(spark):
    rows = awkward() + [(100 + k, "word " * (k * 37 % 700)) for k in range(60)] + [(4, "again")]
    got = packed(table(spark, rows)).collect()
    library, want, sequences, total = full(), Counter(), defaultdict(list), 0
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        for k, (start, n) in enumerate(packing.pieces_of(len(ids), 1024)):
            want[doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) <= math.ceil(total / 1024) * 1.05 + 1


def test_sequences_hold_their_documents_tokens(spark):
    rows = [(k, "word " * k) for k in range(1, 30)]
    library = full()
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in rows}
    seen = []
    for r in packing.pack_sequences(table(spark, rows)).collect():
        tokens = np.frombuffer(r.tokens, "<u4").tolist()
        for doc, at in zip(r.doc_ids, r.offsets, strict=True):
            assert tokens[at : at + len(ids[doc])] == ids[doc]
            seen.append(doc)
    assert sorted(seen) == sorted(ids)


def test_empty_table(spark):
    assert packed(table(spark, [(1, "x")]).limit(0)).count() == 0
