"""Secrets in texts: fixed patterns, and values in credential contexts that would take many guesses.

The base patterns find assignments, access keys and long hexadecimal runs. Beyond them, every value that stands where a
credential would (after a key word and ``:``, ``=`` or ``=>``, after an authorisation scheme, as the password of a URL) is
priced as an attacker would build it: the cheapest segmentation into words, dates, repeats, keyboard walks and brute-force
spans, found by dynamic programming over the value. A value is a span of the kind ``guess`` if its price reaches
``GUESS_BITS``, so that placeholders and prose are left alone and passwords without any fixed form are found.

Prices are whole sixteenths of a bit. A segment costs SEGMENT, and besides

* a brute-force span, for each character, the logarithm of the value's alphabet (10 digits, 26 small and 26 capital letters,
  33 signs, as far as they occur in it),
* a word the logarithm of its rank, one bit for a first or all capitals, else a bit a letter where cases are mixed, and
  one bit for each sign that stands for a letter,
* a date or year its number of possibilities,
* a repeat its first unit by brute force and REPEAT, however many units follow,
* a walk over neighbouring keys, or along the alphabet or digits, WALK for its first key, TURN for each new direction, and
  STEP_ON for each further step in one.

The words are ``COMMON`` and then those of the corpus, by frequency, that make up one in ``SHARE`` of all its words or more:
fewer than ``SHARE`` words, whatever the input. Values in credential contexts do not count as words of the corpus.

Nulls: a null text is empty; rows with a null or repeated doc_id are scanned each. Spans count code points, the end is
exclusive. Texts are scanned whole. The price of a value is followed until it must exceed ``MOST_BITS``, so a long value
costs no more than its length; it is reported as that. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measured, only, steps, text_bytes
from .textvec import LOWER, cut, strings

GUESS_BITS, MOST_BITS = 40, 128
SEGMENT, REPEAT, WALK, TURN, STEP_ON = 32, 128, 96, 48, 4
UNIT, SHORTEST, LONGEST, SHARE = 8, 3, 16, 100_000
STEP = 8 << 20

# Frequent passwords and placeholders, in order of rank, and the keys of a keyboard by rows.
COMMON = (
    "password passwd secret token admin welcome qwerty letmein login master hello changeme dragon monkey example test default guest root user pass "
    "love abc sunshine princess football baseball shadow superman batman iloveyou access key api trustno none null undefined true false your here "
    "my the placeholder redacted hidden sample dummy demo temp temporary public private string value required optional empty unknown xxx"
).split()
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./", strict=True))
SUBSTITUTES = dict(zip("013457@$!", "oleastasi", strict=True))

_BASE = {
    "assign": re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(rb"[0-9a-f]{24,}"),
}
KINDS = (*_BASE, "guess")
LEAST_VALUE = 6
_VALUE = rb"""([!#-&(-+\--:=?-~]+)"""
_CONTEXTS = (
    re.compile(rb"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|encryption)[_-]?key|credentials?|auth(?:orization)?)["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?""" + _VALUE, re.I),
    re.compile(rb"(?:bearer|basic|--(?:password|passphrase|token|secret|api-key))[ \t]+" + _VALUE, re.I),
    re.compile(rb"://[!#-.0-9;=?A-~]+:([!#-.0-9:;=?A-~]+)@"),
)


def _cost(n: float) -> int:
    return math.ceil(16 * math.log2(n))


_PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_SLANTS = {(0, 1): 0, (0, -1): 1, (-1, 0): 2, (-1, 1): 3, (1, 0): 4, (1, -1): 5}
DIRECTIONS = 8
_YEAR, _DATE, _SEPARATED = _cost(150), _cost(150 * 365), 32


def brute(value: str) -> int:
    """Price of each character of the value by brute force."""
    kinds = {"0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "!" for c in value}
    return _cost(sum({"0": 10, "a": 26, "A": 26, "!": 33}[k] for k in kinds))


def directions(a: str, b: str) -> list[int]:
    """The directions in which key ``b`` follows ``a``."""
    a, b = a.lower(), b.lower()
    out = []
    if abs(ord(a) - ord(b)) == 1 and (a.isalpha() and b.isalpha() or a.isdigit() and b.isdigit()):
        out.append(6 if b > a else 7)
    p, q = _PLACE.get(SHIFTED.get(a, a)), _PLACE.get(SHIFTED.get(b, b))
    if p and q and (d := _SLANTS.get((q[0] - p[0], q[1] - p[1]))) is not None:
        out.append(d)
    return out


def word_cost(piece: str, words: dict[str, int]) -> int | None:
    """Price of a piece as a word, by its rank, or None if it is none."""
    plain = "".join(SUBSTITUTES.get(c, c) for c in piece.lower())
    rank = words.get(plain)
    if rank is None:
        return None
    letters = [c for c in piece if c.isalpha()]
    small = not any(c.isupper() for c in letters)
    regular = small or all(c.isupper() for c in letters) or letters[0].isupper() and not any(c.isupper() for c in letters[1:])
    return _cost(rank) + (0 if small else 16 if regular else 16 * len(letters)) + 16 * sum(c in SUBSTITUTES for c in piece)


def _real(y: int, m: int, d: int) -> bool:
    try:
        date(y, m, d)
    except ValueError:
        return False
    return True


def date_cost(piece: str) -> int | None:
    """Price of a piece as a year from 1900 to 2049 or a date in it, with or without separators."""
    if len(piece) == 4 and piece.isdigit():
        return _YEAR if 1900 <= int(piece) < 2050 else None
    parts = re.fullmatch(r"(\d{4})([-/._]?)(\d\d)\2(\d\d)", piece)
    if parts:
        orders = [(int(parts[1]), int(parts[3]), int(parts[4]))]
        mark = parts[2]
    else:
        parts = re.fullmatch(r"(\d\d)([-/._]?)(\d\d)\2(\d{4}|\d\d)", piece)
        if not parts:
            return None
        a, b, y, mark = int(parts[1]), int(parts[3]), int(parts[4]), parts[2]
        years = [y] if len(parts[4]) == 4 else [1900 + y, 2000 + y]
        orders = [(y, *md) for y in years for md in ((a, b), (b, a))]
    return _DATE + (_SEPARATED if mark else 0) if any(1900 <= y < 2050 and _real(y, m, d) for y, m, d in orders) else None


def guess_cost(value: str, words: dict[str, int]) -> int:
    """Price of the cheapest segmentation, in sixteenths of a bit, or that of MOST_BITS if it is not under it."""
    n, far, most = len(value), 1 << 60, 16 * MOST_BITS
    best, span = [0] + [far] * n, far
    repeat = [[far] * (n + 1) for _ in range(UNIT + 1)]
    walk = [far] * DIRECTIONS
    each = brute(value) if value else 0
    for j in range(1, n + 1):
        span = min(span, best[j - 1] + SEGMENT) + each
        found = span
        for size in range(SHORTEST, min(LONGEST, j) + 1):
            start = best[j - size] + SEGMENT
            if start < found:
                piece = value[j - size : j]
                for price in (word_cost(piece, words), date_cost(piece) if size >= 4 and piece[0].isdigit() else None):
                    if price is not None and start + price < found:
                        found = start + price
        for u in range(1, min(UNIT, j // 2) + 1):
            if value[j - u : j] == value[j - 2 * u : j - u]:
                begun = best[j - 2 * u] + SEGMENT + u * each + REPEAT
                repeat[u][j] = min(begun, repeat[u][j - u])
                found = min(found, repeat[u][j])
        if j > 1:
            ways = directions(value[j - 2], value[j - 1])
            begun = best[j - 2] + SEGMENT + WALK + TURN
            walk = [min(begun, walk[d] + STEP_ON, min(w for k, w in enumerate(walk) if k != d) + TURN) if d in ways else far for d in range(DIRECTIONS)]
            found = min(found, *walk)
        best[j] = found
        # whatever comes next goes on from one of these
        if min(min(best[max(0, j - LONGEST) : j + 1]), span, *walk, *(min(repeat[u][max(0, j - u + 1) : j + 1]) for u in range(1, UNIT + 1))) >= most:
            return most
    return min(best[n], most)


def _values(text) -> list[tuple[int, int]]:
    """Byte ranges of the values that stand in credential contexts."""
    out = set()
    for pattern in _CONTEXTS:
        for m in pattern.finditer(text):
            lo, hi = m.span(1)
            while hi > lo and text[hi - 1] in b".:!?)]}":  # the end of a sentence or a bracket around it
                hi -= 1
            if hi - lo >= LEAST_VALUE:
                out.add((lo, hi))
    return sorted(out)


def _ascii_letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the words of SHORTEST to LONGEST letters, all of them ASCII."""
    low = LOWER[data]
    ascii_ = (low >= 0x61) & (low <= 0x7A)
    _, start, end = cut((ascii_ | (data >= 0x80)).view(np.uint8), offs)
    other = np.flatnonzero(data >= 0x80)
    pure = np.searchsorted(other, start) == np.searchsorted(other, end)
    size = end - start
    keep = pure & (size >= SHORTEST) & (size <= LONGEST)
    return start[keep], end[keep]


def _count_words(batches):
    for b in steps(batches, limit=STEP):
        data, offs = text_bytes(b.column("text"))
        data = data.copy()
        view = memoryview(data)
        for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            for a, z in _values(view[lo:hi]):
                data[lo + a : lo + z] = 0x20
        start, end = _ascii_letters(data, offs)
        found = strings(LOWER[data], start, end).value_counts()
        yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])


def corpus_words(docs: DataFrame) -> list[str]:
    """Words that make up one in SHARE of all words or more, most frequent first, ties by the word."""
    counts, of = measured(only(docs, "text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words", total=F.sum("n"))
    rows = counts.filter(F.col("n") * SHARE >= (of["total"] or 0)).toArrow().to_pylist()
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def ranks(words) -> dict[str, int]:
    """Rank of each word, those of COMMON first."""
    return {w: k + 1 for k, w in enumerate(dict.fromkeys([*COMMON, *words]))}


def _chars(data: np.ndarray, at: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    out, last, n = {}, 0, 0
    for x in sorted(set(at)):
        for lo in range(last, x, 1 << 20):
            n += int(np.count_nonzero((data[lo : min(x, lo + (1 << 20))] & 0xC0) != 0x80))
        out[x], last = n, x
    return out


def spans_of(data: np.ndarray, words: dict[str, int], least_bits: float = GUESS_BITS) -> list[tuple[str, int, int, float | None]]:
    """Spans of one text in UTF-8: kind, start and end in code points, and bits of guesses; by start, then kind."""
    text, found = memoryview(data), []
    for kind, pattern in _BASE.items():
        for m in pattern.finditer(text):
            if kind != "assign" or m.end(1) - m.start(1) >= LEAST_VALUE:
                found.append((kind, m.start(), m.end(), None))
    for lo, hi in _values(text):
        bits = guess_cost(bytes(text[lo:hi]).decode("ascii"), words) / 16
        if bits >= least_bits:
            found.append(("guess", lo, hi, bits))
    at = _chars(data, [x for s in found for x in s[1:3]])
    return [(k, at[a], at[z], bits) for k, a, z, bits in sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))]


def _scan(words: dict[str, int], least_bits: float):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches):
        for b in steps(batches):
            data, offs = text_bytes(b.column("text"))
            spans = [[dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in spans_of(data[lo:hi], words, least_bits)] for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, words: list[str] | None = None, least_bits: float = GUESS_BITS) -> DataFrame:
    """doc_id and its spans (kind, start, end, bits), by start and then in the order of ``KINDS``; ``words``: the corpus's own if None."""
    known = ranks(corpus_words(docs) if words is None else words)
    return only(docs, "doc_id", "text").mapInArrow(_scan(known, least_bits), "doc_id long, spans array<struct<kind: string, start: long, end: long, bits: double>>")
