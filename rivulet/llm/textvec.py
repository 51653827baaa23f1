"""Vectorised words, hashes and shingles over the UTF-8 bytes of a batch of texts.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. These
characters are single bytes in UTF-8 and are part of no longer sequence, so
words can be cut on bytes. A hash takes eight bytes at a time and mixes after
each, so it has no arithmetic structure that texts could follow; where equality
must be exact, ``same_bytes`` compares the bytes behind equal hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Ranges of more bytes are hashed one by one.
LONG = 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of one buffer."""
    size = end - start
    out = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(0xD6E8FEB86659FD93))
    if not len(start):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live = np.flatnonzero(size <= LONG)
    at = 0
    while len(live := live[size[live] > at]):
        block = eights[start[live] + at].view(U).ravel()
        left = np.minimum(size[live] - at, 8).astype(U)
        block &= U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * left)
        out[live] = mix((out[live] ^ block) * U(0xC2B2AE3D27D4EB4F) + U(at + 1))
        at += 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].data)
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether the ranges of ``size`` bytes from ``a`` and from ``b`` on are equal, pair by pair."""
    for lo in range(0, len(a), 1 << 14):
        n = size[lo : lo + (1 << 14)]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(a[lo : lo + (1 << 14)], n) + inside] != data[np.repeat(b[lo : lo + (1 << 14)], n) + inside]).any():
            return False
    return True


def sum_by_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of true bytes in each text."""
    out, full = np.zeros(len(offs) - 1, np.int64), np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        out[full] = np.add.reduceat(flags.view(np.uint8), offs[full], dtype=np.int64)
    return out


@dataclass
class Words:
    """Words of a batch, in order: text number, byte range and hash of each; count by text."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    count: np.ndarray


def breaks(n: int, offs: np.ndarray) -> np.ndarray:
    at = np.zeros(n + 1, bool)
    at[offs] = True
    return at


def cut(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind that cross no text's border: text number, start, end."""
    n = len(kind)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = breaks(n, offs)
    edge[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    return np.searchsorted(offs, start, "right") - 1, start, end


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    doc, start, end = cut((~SPACE[data]).view(np.uint8), offs)
    return Words(doc, start, end, hash_ranges(data, start, end), np.bincount(doc, minlength=len(offs) - 1))


_STEP = [U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(16)]


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words; a text of fewer words has one run of them all.

    Returns text number, hash, and index of the run's first word.
    """
    n = len(w.hash)
    doc, out, at = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
    if n >= size:
        first = np.flatnonzero(w.doc[: n - size + 1] == w.doc[size - 1 :])
        total = np.zeros(len(first), U)
        for k in range(size):
            total += w.hash[first + k] * _STEP[k]
        doc, out, at = [w.doc[first]], [mix(total)], [first]
    begin = np.cumsum(w.count) - w.count
    for m in range(1, size):
        few = np.flatnonzero(w.count == m)
        total = np.full(len(few), m, U)
        for k in range(m):
            total += w.hash[begin[few] + k] * _STEP[k]
        doc.append(few), out.append(mix(total)), at.append(begin[few])
    return np.concatenate(doc), np.concatenate(out), np.concatenate(at)


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted, with their counts: text number, value, count."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


#: ASCII capitals to small letters; all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """The byte ranges of a buffer as strings; they must begin and end between characters."""
    size = (end - start).astype(np.int64)
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    inside = np.arange(offs[-1])
    inside += np.repeat(start - offs[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(data[inside]))


def blocks(data: np.ndarray, ends: np.ndarray, limit: int):
    """Ranges of some ``limit`` bytes that cover a long text and end before a byte of the table ``ends`` or with the text."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + limit
        while hi < n:
            found = np.flatnonzero(ends[data[hi : hi + 4096]])
            if len(found):
                hi += int(found[0])
                break
            hi += 4096
        hi = min(hi, n)
        yield lo, hi
        lo = hi
