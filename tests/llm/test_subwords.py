import hashlib
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from rivulet.llm import subwords

from .cases import awkward, prose, table


def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_are_the_librarys():
    r = random.Random(3)
    signs = "ab  the▁\n\t\x00é😀中<s>ñ0x41ing​́"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 150))) for _ in range(800)]
    texts += ["", " ", "a" * 4000, " " * 300, "x" * 48, "x" * 49, " " + "z" * 47, "ing" * 1500, "▁▁a ▁", prose(5, 400)]
    own, agreed = subwords.encoder().encode(texts)
    assert [x.tolist() for x in own] == library().encode(texts)
    assert all(agreed)


def test_heap_and_rounds_give_the_same():
    e = subwords.encoder()
    texts = [f"▁{w}" for w in prose(6, 300).split()] + ["▁", "▁▁▁", "▁\x00", "▁中文😀"]
    ids, many = e.by_rounds(texts)
    at = 0
    for text, n in zip(texts, many.tolist(), strict=True):
        assert ids[at : at + n].tolist() == e.by_heap(text)
        at += n


def test_a_wrong_own_id_is_found_and_replaced():
    e = subwords.MergeEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    e.pairs.clear()
    e.keys[:], e.rank[:] = -1, subwords._NONE  # no merges at all
    own, agreed = e.encode(["the cat", "a"])
    assert own[0].tolist() == library().encode("the cat")
    assert not agreed[0]


def test_forgets_and_goes_on():
    e = subwords.encoder()
    e.forget()
    kept, subwords.KEPT = subwords.KEPT, 5
    try:
        for seed in range(4):
            text = prose(seed, 50)
            assert e.encode([text])[0][0].tolist() == library().encode(text)
    finally:
        subwords.KEPT = kept


def test_query(spark):
    rows = awkward()
    sp = library()
    decimal = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("h")
    got = subwords.encode_decode(table(spark, rows)).select("doc_id", "ids", "decoded", "agreed", decimal).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, sp.encode(t or "", add_eos=True)) for i, t in rows]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.agreed and r.decoded == sp.decode(list(r.ids))
        assert r.h == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert subwords.encode_decode(table(spark, rows).limit(0)).count() == 0
