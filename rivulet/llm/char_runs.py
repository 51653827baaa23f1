"""Runs of characters of lines in NumPy: min-hash bands, distinct runs, and exact similarities of pairs.

Lines come as UTF-16 units (big-endian). A run's hash takes four units at a
time and mixes after each, so it has no arithmetic structure. Runs are hashed
``CHUNK`` at a time, so a step's memory does not depend on the length of a line
but for the distinct runs of one or two lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_bytes
from .textvec import U, mix

CHUNK = 1 << 15
#: For each register a word to add to a run's hash and an odd word to multiply it by.
_SALT = mix(np.arange(1, 2049, dtype=U)).astype(np.uint32) | np.tile(np.array([0, 1], np.uint32), 1024)


def hashes(data: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` units that begin at the units ``lo`` to ``hi`` of the bytes ``data``."""
    units = np.zeros(hi - lo + k + 3, U)
    got = data[2 * lo : 2 * (hi + k - 1)].view(">u2")
    units[: len(got)] = got
    fours = units[:-3] << U(48) | units[1:-2] << U(32) | units[2:-1] << U(16) | units[3:]
    out = np.full(hi - lo, U(k))
    for at in range(0, k, 4):
        out ^= fours[at : at + hi - lo] >> U(16 * max(0, 4 - (k - at)))
        out *= U(0xC2B2AE3D27D4EB4F)
        out ^= out >> U(29)
    return mix(out)


def registers(units: pa.BinaryArray, k: int, m: int) -> np.ndarray:
    """The least value that each of ``m`` hash functions takes on the runs of each line: a run's hash, mixed anew for each."""
    data, offs = text_bytes(units)
    offs = offs // 2
    out = np.full((m, len(units)), 0xFFFFFFFF, np.uint32)
    for lo in range(0, int(offs[-1]), CHUNK):
        hi = min(lo + CHUNK, int(offs[-1]))
        first, last = np.searchsorted(offs, lo, "right") - 1, np.searchsorted(offs, hi, "left")
        start, end = np.maximum(offs[first:last], lo) - lo, np.minimum(offs[first + 1 : last + 1] - k + 1, hi) - lo
        full = np.flatnonzero(end > start)
        if not len(full):
            continue
        at, row = np.stack((start[full], end[full]), 1).ravel(), first + full
        h = (hashes(data, lo, hi, k) >> U(32)).astype(np.uint32)
        x, shifted = np.zeros(hi - lo + 1, np.uint32), np.empty(hi - lo, np.uint32)  # an end may be the end of the chunk
        for r in range(m):
            y = np.bitwise_xor(h, _SALT[2 * r], out=x[:-1])
            y *= _SALT[2 * r + 1]
            y ^= np.right_shift(y, np.uint32(15), out=shifted)
            y *= np.uint32(0x846CA68B)  # the order of products is that of their high bits, which all bits reach
            out[r, row] = np.minimum(out[r, row], np.minimum.reduceat(x, at)[::2])
    return out.T.astype(U)


def banded(parts: np.ndarray, k: int, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of the registers of each line (n x bands)."""
    parts = parts.reshape(len(parts), bands, rows)
    total = mix(np.zeros(parts.shape[:2], U) + np.arange(1, bands + 1, dtype=U) * U(0xE7037ED1A0B428DB) + U(k))
    for r in range(rows):
        total = mix(total + parts[:, :, r]) + U(r + 1)
    return total


def keys(units: pa.BinaryArray, k: int, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each line (n x bands)."""
    return banded(registers(units, k, bands * rows), k, bands, rows)


def _once(values: np.ndarray) -> np.ndarray:
    values.sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def distinct(units: bytes, k: int) -> np.ndarray:
    """Hashes of the distinct runs of a line, sorted."""
    data, many = np.frombuffer(units, np.uint8), len(units) // 2 - k + 1
    out = np.empty(max(many, 0), U)
    for lo in range(0, many, CHUNK):
        out[lo : lo + CHUNK] = hashes(data, lo, min(lo + CHUNK, many), k)
    return _once(out)


#: Names of the 64-bit words of a sketch, and of one with as many slots as tell lines of a thousand runs apart.
WORDS = ("w0", "w1", "w2", "w3")
WIDE = tuple(f"w{i}" for i in range(8))


def parities(values: np.ndarray) -> np.ndarray:
    """A sketch of a set: for each of 256 slots whether an odd number of its elements falls there, as four words.

    Elements of both of two sets cancel out, so the sketches of two sets differ in no more bits than the sets in elements.
    """
    odd = np.bincount((values & U(64 * len(WORDS) - 1)).astype(np.intp), minlength=64 * len(WORDS)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: Lines whose sets are sketched at once.
TOGETHER = 256
#: Lines with so many distinct runs for each register have their registers from one hash of each run, others from one for each register.
FILLED = 3


def sets(units: pa.BinaryArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of its distinct runs and the sketch of their set (n x ``WIDE``), many lines at a time."""
    return _sets(units, k, 0, True)[:2]


def _sets(units: pa.BinaryArray, k: int, m: int, sketched: bool, words: int = len(WIDE)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``sets``, and ``m`` registers of each line (n x m): the range of the hashes is cut to so many bins, and the least
    hash in each is the one register it fills (an empty bin has the largest value). As for other min-hashes, a register of two
    sets is equal with the probability of their similarity, or greater where it is empty in both.

    A run counts by 48 bits of its hash, above which stands the number of its line, so that one sort finds what recurs, and
    the first of each bin.
    """
    data, offs = text_bytes(units)
    offs, slots = offs // 2, 64 * words
    many, sketch = np.zeros(len(units), np.int64), np.zeros((len(units), words), np.int64)
    least = np.full((len(units), m), U(0xFFFFFFFFFFFF))
    lo = 0
    while lo < len(units):
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + 2 * CHUNK, "right")) - 1), lo + TOGETHER, len(units))
        runs = np.maximum(np.diff(offs[lo : hi + 1]) - k + 1, 0)
        if offs[hi] - offs[lo] > 2 * CHUNK:  # a single long line
            once = distinct(units[lo].as_py(), k) >> U(16)
            once = once[np.append(True, once[1:] != once[:-1])]
        elif not runs.any():
            lo = hi
            continue
        else:
            line = np.repeat(np.arange(hi - lo), runs)
            at = np.arange(len(line)) + (offs[lo:hi] - offs[lo] - np.cumsum(runs) + runs)[line]
            once = _once(hashes(data, int(offs[lo]), int(offs[hi]), k)[at] >> U(16) | line.astype(U) << U(48))
        line = (once >> U(48)).astype(np.intp)
        many[lo:hi] = np.bincount(line, minlength=hi - lo)
        if m:
            once &= U(0xFFFFFFFFFFFF)
            place = line * m + ((once >> U(16)) * U(m) >> U(32)).astype(np.intp)
            first = np.append(True, place[1:] != place[:-1])
            least[lo:hi].reshape(-1)[place[first]] = once[first]
        if not sketched:
            lo = hi
            continue
        odd = np.bincount(line * slots + (once & U(slots - 1)).astype(np.intp), minlength=(hi - lo) * slots) & 1
        sketch[lo:hi] = np.packbits(odd.astype(np.uint8).reshape(hi - lo, slots), axis=1).view(np.int64)
        lo = hi
    return many, sketch, least


def fitting(units: pa.BinaryArray, lengths: tuple[tuple[int, int, int | None], ...]) -> np.ndarray:
    """Which ``lengths`` (k, low, high) of runs fit each line (n x lengths): those of which it has as many distinct ones as a
    line of ``low`` to ``high`` units in which none recurs. The heads of lines tell that of most, the others are counted whole."""
    n, out = np.diff(text_bytes(units)[1]) // 2, np.zeros((len(units), len(lengths)), bool)
    for c, (k, low, high) in enumerate(lengths):
        fits = n >= max(low, k)  # a line has no more distinct runs than it has runs
        ask = np.flatnonzero(fits & ~((low <= k) & (n <= (np.inf if high is None else high))))
        if len(ask):
            asked = units.take(pa.array(ask))
            head = int(1.3 * (high or low)) + 16
            size = _sets(pc.binary_slice(asked, 0, 2 * head), k, 0, False)[0] + k - 1
            more = np.flatnonzero((n[ask] > head) & (size <= (low - 1 if high is None else high)))  # the rest of the line can change the answer
            if len(more):
                size[more] = _sets(asked.take(pa.array(more)), k, 0, False)[0] + k - 1
            fits[ask] = (size >= low) & (True if high is None else size <= high)
        out[:, c] = fits
    return out


def band_keys(lines: DataFrame, lengths: tuple[tuple[int, int, int | None, int, int], ...]) -> DataFrame:
    """``lines`` (..., units) -> (..., sets, keys): for the lengths of runs that fit a line, of (k, low, high, bands, rows), its bands
    and its sets (kind, n, ``WIDE``), each with the number of distinct runs and their sketch."""
    names = [c for c in lines.columns if c != "units"]

    def run(batches):
        for batch in batches:
            units, line, of, place, kind, many, words = batch.column("units"), [], [], [], [], [], []
            fits = fitting(units, tuple(x[:3] for x in lengths))
            for c, (k, low, _, bands, rows) in enumerate(lengths):
                mine = np.flatnonzero(fits[:, c])
                if len(mine):
                    fitted = units.take(pa.array(mine))
                    full = low - k + 1 >= FILLED * bands * rows
                    n, sketch, least = _sets(fitted, k, bands * rows if full else 0, True)
                    own = banded(least, k, bands, rows) if full else keys(fitted, k, bands, rows)
                    line.append(np.repeat(mine, bands)), of.append(own.ravel())
                    place.append(mine), kind.append(np.full(len(mine), k, np.int32)), many.append(n), words.append(sketch)
            place, kind, many = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, place), (np.int32, kind), (np.int64, many)))
            words, order = np.concatenate([np.zeros((0, len(WIDE)), np.int64), *words]), np.argsort(place, kind="stable")
            fields = [pa.array(kind[order]), pa.array(many[order]), *[pa.array(np.ascontiguousarray(w[order])) for w in words.T]]
            own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(fits.sum(axis=1))).astype(np.int32)), pa.StructArray.from_arrays(fields, ["kind", "n", *WIDE]))
            line, of = np.concatenate([np.zeros(0, np.int64), *line]), np.concatenate([np.zeros(0, U), *of])
            ends = np.concatenate(([0], np.cumsum(np.bincount(line, minlength=len(batch))))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(of[np.argsort(line, kind="stable")].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], own, lists], [*names, "sets", "keys"])

    each = "kind int, n bigint, " + ", ".join(f"{w} bigint" for w in WIDE)
    schema = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in names)
    return lines.mapInArrow(run, f"{schema}, sets array<struct<{each}>>, keys array<bigint>")


#: 64-bit words of the sketches that tell large sets apart.
WIDEST = 64


def wide_sketches(lines: DataFrame) -> DataFrame:
    """``lines`` (node, kind, units) -> (node, kind, wide): sketches of ``WIDEST`` words of the sets of runs of ``kind`` units, as bytes."""

    def run(batches):
        for batch in batches:
            kind, wide = batch.column("kind").to_numpy(), np.zeros((len(batch), WIDEST), np.int64)
            for k in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == k)
                wide[mine] = _sets(batch.column("units").take(pa.array(mine)), k, 0, True, WIDEST)[1]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("kind"), pa.array([row.tobytes() for row in wide], pa.binary())], ["node", "kind", "wide"])

    return lines.select("node", "kind", "units").mapInArrow(run, "node bigint, kind int, wide binary")


def alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, k, va, vb) whose lines have at least this Jaccard similarity by their runs of ``k`` units."""

    def run(batches):
        for batch in batches:
            keep, last, known = [], None, None
            for a, k, va, vb in zip(*[batch.column(c) for c in ("a", "k", "va", "vb")], strict=True):
                if last != (a.as_py(), k.as_py()):
                    last, known = (a.as_py(), k.as_py()), distinct(va.as_buffer(), k.as_py())
                other = distinct(vb.as_buffer(), k.as_py())
                both = len(known) + len(other) - len(_once(np.concatenate((known, other))))
                keep.append(both >= similarity * (len(known) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "k", "va", "vb").mapInArrow(run, "a bigint, b bigint")
