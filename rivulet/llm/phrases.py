"""Phrases whose words stand together more often than chance has it, from suffixes sorted by language and first word.

After Berberich and Bedathur ("Computing n-gram statistics in MapReduce", 2013). Texts are cut into pieces at punctuation and
line ends. Each word begins a suffix of at most ``LONGEST`` words of its piece. Suffixes are dealt by language and first
word and sorted reverse-lexicographically, so that those with a common prefix are neighbours; a stack of the prefixes that
are open then counts all of them in one pass. A phrase's parts are joined to it afterwards.

Three things keep the exchange small and even, and none changes a count:

* Words are counted first, then the pairs of them that stand together, by slots of 32 bits. A phrase of ``least``
  occurrences has no word or pair with fewer, so suffixes end before such a one. Map tasks know the frequent ones by
  filters of ``FILTER_BITS`` bits, which are of one size whatever the input and may let through a rare one, but never stop
  a frequent one.
* Tasks make a row for each suffix, at most one a word, and Spark's aggregate adds up equal ones before and after the exchange.
* Suffixes of a word that makes up more than one in ``HOT`` of all words are dealt over ``SALTS`` tasks by their whole text;
  their prefixes are counted in parts, which are then added up.

Nulls: a null text is empty, a null lang is ``und``; doc_id is not read. Repeated rows count each. An empty table gives an
empty result. Texts are read whole, long ones in blocks that look ahead by the words that a suffix needs. Ties go to the
cut after fewer words, and to the phrase that is first in UTF-8. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, heavy_join, materialize, only, steps, text_bytes
from .textvec import LOWER, U, blocks, cut, hash_ranges, mix, strings

LEAST, LONGEST, TOP, INSIDE = 100, 5, 2000, 100
FILTER_BITS, HOT, SALTS = 1 << 26, 512, 64
#: Bytes of text that one step handles, and rows of counts that a task holds before it sends them.
STEP, HELD = 1 << 19, 1 << 18

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True
_END = _BREAK | _GAP
#: In the table of counted words, the name of the number of all words of a language; no word is empty.
ALL = ""


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Text number, start and end of each word, the bytes of all words in a row, and the words, capitals made small."""
    inside = ~_END[data]
    doc, start, end = cut(inside.view(np.uint8), offs)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    letters = LOWER[data[inside]]
    return doc, start, end, letters, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()


def _langs(batch: pa.RecordBatch) -> pa.DictionaryArray:
    return pc.fill_null(batch.column("lang").cast(pa.string()), "und").dictionary_encode()


def _parts(batch: pa.RecordBatch):
    """The text of a step, or of a long text its blocks: bytes, offsets, and where the last word that counts must begin."""
    data, offs = text_bytes(batch.column("text"))
    if len(batch) > 1 or len(data) <= 2 * STEP:
        yield data, offs, len(data)
        return
    for lo, hi in blocks(data, _END, STEP):
        more = _ahead(data, hi)
        yield data[lo:more], np.array([0, more - lo]), hi - lo


def _ahead(data: np.ndarray, at: int) -> int:
    """The place where the LONGEST-th word from ``at`` on begins, or the end."""
    width = 1 << 10
    while True:
        end = _END[data[at : at + width]]
        starts = np.flatnonzero(end[:-1] & ~end[1:])
        if len(starts) >= LONGEST:
            return at + int(starts[LONGEST - 1]) + 1
        if at + width >= len(data):
            return len(data)
        width *= 4


def _summed(batches, keys: list[str]):
    """Counts ``n`` of equal keys added up over batches, held until there are too many."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= HELD:
            total = _added(held, keys)
            if len(total) > HELD // 2:
                yield from total.to_batches()
                held, rows = [], 0
            else:
                held, rows = total.to_batches(), len(total)
    if held:
        yield from _added(held, keys).to_batches()


def _added(batches: list[pa.RecordBatch], keys: list[str]) -> pa.Table:
    return pa.Table.from_batches(batches).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def _count_words(batches):
    for b in steps(batches, limit=STEP):
        langs = _langs(b)
        of = langs.indices.to_numpy().astype(np.int64)
        for data, offs, upto in _parts(b):
            doc, start, _, _, words = _words(data, offs)
            width = max(1, len(words.dictionary))
            live = start < upto
            key, n = np.unique((of[doc] * width + words.indices.to_numpy())[live], return_counts=True)
            total = np.bincount(of[doc[live]], minlength=len(langs.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([langs.dictionary.take(pa.array(key // width)), langs.dictionary]),
                    pa.concat_arrays([words.dictionary.take(pa.array(key % width)).cast(pa.string()), pa.array([ALL] * len(total), pa.string())]),
                    pa.array(np.append(n, total).astype(np.int64)),
                ],
                ["lang", "word", "n"],
            )


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """Frequent words and, under the name ``ALL``, the number of all words: lang, word, n."""
    counts = only(docs, "lang", "text").mapInArrow(lambda bs: _summed(_count_words(bs), ["lang", "word"]), "lang string, word string, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("word") == ALL))


def _hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """One hash for each pair of a language and a word."""
    (a, a_offs), (b, b_offs) = text_bytes(langs.cast(pa.string())), text_bytes(words.cast(pa.string()))
    return mix(hash_ranges(a, a_offs[:-1], a_offs[1:]) * U(0x9E3779B97F4A7C15) + hash_ranges(b, b_offs[:-1], b_offs[1:]))


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for each hash."""
    return (hashes % U(FILTER_BITS)).astype(np.int64), ((hashes >> U(32)) % U(FILTER_BITS)).astype(np.int64)


def _filter_cells(batches):
    for b in batches:
        hashes = _hashes(b.column("lang"), b.column("word")) if "word" in b.schema.names else mix(b.column("slot").to_numpy().view(U))
        at = np.unique(np.concatenate(_bits(hashes)))
        cell, first = np.unique(at // 64, return_index=True)
        mask = np.bitwise_or.reduceat(U(1) << (at % 64).astype(U), first) if len(at) else np.zeros(0, U)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mask.view(np.int64))], ["cell", "mask"])


def _filter(rows: DataFrame) -> np.ndarray:
    """The filter of these words or slots: FILTER_BITS / 64 cells of 64 bits at most come to the driver."""
    cells = rows.mapInArrow(_filter_cells, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    found = np.zeros(FILTER_BITS // 64, np.int64)
    found[cells["cell"].to_numpy()] = cells["mask"].to_numpy()
    return found


def frequent_words(words: DataFrame) -> np.ndarray:
    return _filter(words.filter(F.col("word") != ALL).select("lang", "word"))


def frequent_pairs(docs: DataFrame, words: np.ndarray, least: int) -> np.ndarray:
    """The filter of the slots of pairs with ``least`` occurrences of words that stand together in a piece."""
    counts = only(docs, "lang", "text").mapInArrow(lambda bs: _summed(_count_pairs(bs, words), ["slot"]), "slot long, n long")
    slots = materialize(counts.groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("slot"), "pair-slots")
    cells = _filter(slots)
    drop(slots)
    return cells


def hot_words(words: DataFrame) -> np.ndarray:
    """Hashes of the words, fewer than HOT, that each make up more than one in HOT of all."""
    total = words.filter(F.col("word") == ALL).agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = words.filter((F.col("word") != ALL) & (F.col("n") * HOT > total)).select("lang", "word").toArrow()
    return np.sort(_hashes(rows["lang"].combine_chunks(), rows["word"].combine_chunks()))


def _known(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in _bits(hashes):
        out &= (cells.view(U)[at // 64] >> (at % 64).astype(U)) & U(1) != 0
    return out


@dataclass
class _Chain:
    """Words of a part of the texts, in order; ``link`` tells that a word and the next are frequent and stand in one piece."""

    langs: pa.Array
    lang: np.ndarray  # by word
    start: np.ndarray
    size: np.ndarray
    letters: np.ndarray
    hash: np.ndarray  # of language and word
    link: np.ndarray
    upto: int


def _chains(batches, frequent: np.ndarray):
    for b in steps(batches, limit=STEP):
        langs = _langs(b)
        of = langs.indices.to_numpy().astype(np.int64)
        for data, offs, upto in _parts(b):
            doc, start, end, letters, words = _words(data, offs)
            if not len(start):
                continue
            width = len(words.dictionary)
            pair, back = np.unique(of[doc] * width + words.indices.to_numpy(), return_inverse=True)
            hashes = _hashes(langs.dictionary.take(pa.array(pair // width)), words.dictionary.take(pa.array(pair % width)))
            fine, piece = _known(frequent, hashes)[back], np.cumsum(_BREAK[data], dtype=np.int32)[start]
            link = np.zeros(len(start), bool)
            link[:-1] = fine[:-1] & fine[1:] & (doc[:-1] == doc[1:]) & (piece[:-1] == piece[1:])
            yield _Chain(langs.dictionary, of[doc], start, end - start, letters, hashes[back], link, upto)


def _slots(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slots of the pairs that the words ``at`` make with the next."""
    return (mix(hashes[at] * U(0x9E3779B97F4A7C15) + hashes[at + 1]) >> U(32)).astype(np.int64)


def _count_pairs(batches, frequent: np.ndarray):
    for c in _chains(batches, frequent):
        slot, n = np.unique(_slots(c.hash, np.flatnonzero(c.link & (c.start < c.upto))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])


def _suffixes(batches, frequent: np.ndarray, pairs: np.ndarray, hot: np.ndarray):
    for c in _chains(batches, frequent):
        linked = np.flatnonzero(c.link)
        link = c.link.copy()
        link[linked] = _known(pairs, mix(_slots(c.hash, linked).view(U)))
        size, going = np.ones(len(link), np.int64), link.copy()
        for _ in range(LONGEST - 1):
            size += going
            going = np.append(going[1:], False) & link
        # words with one space after each
        at = np.zeros(len(link) + 1, np.int64)
        np.cumsum(c.size + 1, out=at[1:])
        spaced = np.full(at[-1], 0x20, np.uint8)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        spaced[inside] = c.letters
        begins = np.flatnonzero((size > 1) & (c.start < c.upto))
        kind = c.lang[begins] * 2 + np.isin(c.hash[begins], hot)
        for k in np.unique(kind).tolist():
            mine = begins[kind == k]
            suffix = strings(spaced, at[mine], at[mine + size[mine]]).cast(pa.string())
            salt = np.full(len(mine), -1, np.int32)
            if k % 2:
                raw, ends = text_bytes(suffix)
                salt = (hash_ranges(raw, ends[:-1], ends[1:]) % U(SALTS)).astype(np.int32)
            lang = pa.repeat(pa.scalar(c.langs[k // 2].as_py(), pa.string()), len(mine))
            yield pa.RecordBatch.from_arrays([lang, pa.array(salt), suffix, pa.array(np.ones(len(mine), np.int64))], ["lang", "salt", "suffix", "n"])


def common_bytes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes each string has in common with the one before it."""
    size = np.diff(offs)
    out = np.zeros(len(size), np.int64)
    most = np.minimum(size[1:], size[:-1])
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live, at = np.flatnonzero(most > 0), 0
    while len(live):
        other = (eights[offs[live] + at].view(U) ^ eights[offs[live + 1] + at].view(U)).ravel()
        same = other == 0
        lowest = np.log2(np.where(same, U(1), other & (~other + U(1))).astype(np.float64)).astype(np.int64) // 8
        out[live + 1] = at + np.where(same, 8, lowest)
        at += 8
        live = live[same]
        live = live[most[live] > at]
    out[1:] = np.minimum(out[1:], most)
    return out


def _count_prefixes(least: int):
    """Counts of all prefixes of two words and more of sorted suffixes, each followed by a space.

    ``open_`` is the stack: the number of occurrences so far of each prefix of the last suffix, by its number of words.
    """

    def closed(lang, salt, data, start, end, n):
        keep = (n >= least) | (salt >= 0)
        phrase = strings(data, start[keep], end[keep] - 1).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang.filter(pa.array(keep)), phrase, pa.array(n[keep])], ["lang", "phrase", "n"])

    def run(batches):
        last, open_ = None, {}
        for b in batches:
            if not len(b):
                continue
            if last is not None:
                b = pa.concat_batches([last, b])
            lang, salt = b.column("lang").cast(pa.string()), b.column("salt").to_numpy()
            data, offs = text_bytes(b.column("suffix").cast(pa.string()))
            n = b.column("n").to_numpy().copy()
            if last is not None:
                n[0] = 0  # it is counted in the stack
            code = lang.dictionary_encode().indices.to_numpy()
            same = np.append(False, (code[1:] == code[:-1]) & (salt[1:] == salt[:-1]))
            common = np.where(same, common_bytes(data, offs), 0)
            space = np.flatnonzero(data == 0x20)
            row = np.searchsorted(offs, space, "right") - 1
            upto = np.full((LONGEST + 1, len(n)), -1, np.int64)  # bytes of the prefix of so many words
            rank = np.arange(len(space)) - np.searchsorted(row, row) + 1
            upto[rank, row] = space + 1 - offs[row]
            still: dict[int, int] = {}
            for k in range(2, LONGEST + 1):
                rows = np.flatnonzero(upto[k] > 0)
                if not len(rows):
                    continue
                first = np.flatnonzero(common[rows] < upto[k, rows])
                first = np.unique(np.append(0, first))
                sums = np.add.reduceat(n[rows], first)
                if rows[0] == 0 and last is not None:
                    sums[0] += open_[k]
                if rows[-1] == len(n) - 1:
                    still[k] = int(sums[-1])
                    first, sums = first[:-1], sums[:-1]
                at = rows[first]
                yield closed(lang.take(pa.array(at)), salt[at], data, offs[at], offs[at] + upto[k, at], sums)
            last, open_ = b.slice(len(b) - 1), still
        if last is not None:
            data, offs = text_bytes(last.column("suffix").cast(pa.string()))
            ends = np.flatnonzero(data == 0x20) + 1
            for k, n in open_.items():
                yield closed(last.column("lang").cast(pa.string()), last.column("salt").to_numpy(), data, offs[:1], ends[k - 1 : k], np.array([n]))

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Phrases of two words and more that occur ``least`` times: lang, phrase, n."""
    frequent, hot = frequent_words(words), hot_words(words)
    pairs = frequent_pairs(docs, frequent, least)
    each = only(docs, "lang", "text").mapInArrow(lambda bs: _suffixes(bs, frequent, pairs, hot), "lang string, salt int, suffix string, n long")
    found = each.groupBy("lang", "salt", "suffix").agg(F.sum("n").alias("n"))
    dealt = found.repartition("lang", F.substring_index("suffix", " ", 1), "salt").sortWithinPartitions("lang", "salt", F.desc("suffix"))
    return dealt.mapInArrow(_count_prefixes(least), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _joined(rows: DataFrame, parts: DataFrame, part: str, count: str) -> DataFrame:
    named = heavy_join(rows.withColumnRenamed(part, "part"), parts, ["lang", "part"], "uses")
    return named.withColumnsRenamed({"part": part, "f": count}).drop("uses")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words = materialize(word_counts(docs, least), "words")
    phrases = materialize(phrase_counts(docs, words, least), "phrases")
    ws = F.split("phrase", " ")
    cuts = phrases.withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.size(ws) - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(ws, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(ws, F.col("k") + 1, F.size(ws)), " "), "m": F.size(ws)})
    uses = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part")).groupBy("lang", "part").agg(F.count("*").alias("uses"))
    counts = phrases.withColumnRenamed("phrase", "part").unionByName(words.filter(F.col("word") != ALL).withColumnRenamed("word", "part")).withColumnRenamed("n", "f")
    parts = materialize(counts.join(uses, ["lang", "part"]), "parts")
    left = materialize(_joined(cuts, parts, "first", "l"), "cuts-left")
    totals = materialize(words.filter(F.col("word") == ALL).select("lang", "n"), "totals")
    priced = materialize(heavy_join(_joined(left, parts, "rest", "r"), totals, ["lang"], "n"), "cuts")
    drop(left, parts)

    # a phrase within a longer one of as many occurrences is also within one that is longer by a word, its first or last
    within = lambda part, f, k: priced.filter((F.col("m") > 2) & (F.col("k") == k) & (100 * F.col("a") >= inside * F.col(f))).select("lang", F.col(part).alias("phrase"))
    covered = within("first", "l", F.col("m") - 1).unionByName(within("rest", "r", F.lit(1))).distinct()
    product = lambda a, b: (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")
    score = F.call_function("div", product(1000 * F.col("a"), F.col("n")), product(F.col("l"), F.col("r")))
    best = priced.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    out = best.join(covered, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
