"""Exact duplicates by a tree merge of sorted digest runs.

Each text is normalised by deleting ``[\\x20\\x09-\\x0D]`` and reduced to its
SHA-256 digest, with a second 64-bit hash and the byte length to verify that
equal digests mean equal texts. Every partition sorts its rows to a run and
folds equal texts to one entry: their number and the row that stays. The
partitions then exchange runs in rounds, as in a binomial tree of radix
``RADIX``: the nodes of a round form groups of RADIX that differ in one digit,
and each entry moves to the node whose digit is that of its digest. A node
merges the sorted runs it receives, for which Spark's external sort stands: it
spills, so no run need fit in memory. It then folds equal texts again, a batch
at a time with the last entry carried over. After the last round each digest
has one entry, and no node ever received more than one entry of a text from
each of the others, however many copies there are. Rows find their text's entry
by ``heavy_join``, so the copies of one text do not meet in one task.

The row that stays has the most code points in its original text, then the
smallest doc_id (null ids last), then the first place among repeated rows.
Null texts count as empty; empty texts are copies of one another. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, materialize, only, shuffle_partitions, steps, text_bytes

RADIX = 4
_SPACES = b" \t\n\x0b\x0c\r"
_ROWS = "doc_id long, row long, digest binary, verify long, n_bytes long, n_chars long"
_RUN = "node int, digest binary, verify long, n_bytes long, n_chars long, doc_id long, row long, n long"


def _digests(batches):
    part, at = TaskContext.get().partitionId(), 0
    for b in steps(batches):
        data, offs = text_bytes(b.column("text"))
        raw = data.tobytes()
        bare = [raw[i:j].translate(None, _SPACES) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array((part << 40) + at + np.arange(len(bare), dtype=np.int64)),
                pa.array([hashlib.sha256(x).digest() for x in bare], pa.binary()),
                pa.array(np.array([xxhash.xxh64_intdigest(x) for x in bare], np.uint64).view(np.int64)),
                pa.array([len(x) for x in bare], pa.int64()),
                pc.utf8_length(b.column("text")).cast(pa.int64()),
            ],
            ["doc_id", "row", "digest", "verify", "n_bytes", "n_chars"],
        )
        at += len(bare)


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, row (its place), digest, verify, n_bytes, n_chars."""
    return only(docs, "doc_id", "text").mapInArrow(_digests, _ROWS)


_NAMES = ["node", "digest", "verify", "n_bytes", "n_chars", "doc_id", "row", "n"]


def _fold(nodes: int, spread: int | None):
    """Fold neighbours with the same text in a sorted stream, and say where each entry goes next.

    ``spread`` is the digit of the node that the next round replaces, None after the last.
    """

    def folded(b: pa.RecordBatch) -> pa.RecordBatch:
        """The entry of each text of a sorted batch whose row stays, with the number of all."""
        digest = np.frombuffer(b"".join(b.column("digest").to_pylist()), np.uint8).reshape(len(b), 32)
        verify, n_bytes, n_chars, row, n = (b.column(c).to_numpy() for c in ("verify", "n_bytes", "n_chars", "row", "n"))
        other = np.ones(len(b), bool)
        other[1:] = (digest[1:] != digest[:-1]).any(axis=1) | (verify[1:] != verify[:-1]) | (n_bytes[1:] != n_bytes[:-1])
        first = np.flatnonzero(other)
        none = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((row, pc.fill_null(b.column("doc_id"), 0).to_numpy(), none, -n_chars, np.cumsum(other)))
        stays = b.take(pa.array(order[first]))
        return stays.set_column(stays.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(n, first)))

    def placed(b: pa.RecordBatch, node: int) -> pa.RecordBatch:
        to = np.full(len(b), node, np.int32)
        if spread is not None and len(b):
            goal = np.array([int.from_bytes(x[:4], "big") for x in b.column("digest").to_pylist()], np.int64) % nodes
            step = RADIX**spread
            to += ((goal // step % RADIX - node // step % RADIX) * step).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(to), *[b.column(c) for c in _NAMES[1:]]], _NAMES)

    def run(batches):
        node, last = TaskContext.get().partitionId() % nodes, None
        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(c) for c in _NAMES[1:]], _NAMES[1:])  # without the stream's marks of what is never null
            if last is not None:
                b = pa.concat_batches([last, b])
            if len(b):
                b = folded(b)
                last = b.slice(len(b) - 1)
                yield placed(b.slice(0, len(b) - 1), node)
        if last is not None:
            yield placed(last, node)

    return run


def merge_runs(rows: DataFrame) -> DataFrame:
    """One entry for each distinct text: digest, verify, n_bytes, and n_chars, doc_id, row of the row that stays, n copies."""
    rounds = 1
    while RADIX**rounds < shuffle_partitions(rows.sparkSession):
        rounds += 1
    nodes, order = RADIX**rounds, ["digest", "verify", "n_bytes"]
    runs = rows.withColumn("n", F.lit(1).cast("long")).sortWithinPartitions(*order).mapInArrow(_fold(nodes, 0), _RUN)
    for k in range(rounds):
        runs = runs.repartitionById(nodes, F.col("node")).sortWithinPartitions(*order)
        runs = runs.mapInArrow(_fold(nodes, k + 1 if k + 1 < rounds else None), _RUN)
    return runs.drop("node")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, digest (of the normalised text)."""
    rows = materialize(digest_rows(docs), "digests")
    kept = merge_runs(rows).select("digest", "verify", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    joined = heavy_join(rows, materialize(kept, "kept-texts"), ["digest", "verify", "n_bytes"], "group_size")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
