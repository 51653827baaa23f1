"""Near duplicates by ProbMinHash on word shingles, weighted and plain.

A text is the set of its runs of ``WORDS`` words, each with the weight
1 + ln(times it occurs). After Ertl, "ProbMinHash" (2020): an element of
weight w sends arrivals of a Poisson process of rate w to registers, taken
without repetition from a permutation of its own, with the rate lowered as
registers are used up. A register keeps the earliest arrival's element. An
element stops as soon as its next arrival is later than the latest register,
so most elements send one arrival. Two texts agree in a register with the
probability of their probability Jaccard similarity.

Registers are cut to ``BANDS`` bands of ``ROWS``. At a similarity of 0.8 some
band agrees with probability 1 - (1 - 0.8**ROWS)**BANDS, over 0.9999. Links are
defined by the plain sets, and repeated shingles can make the probability
Jaccard similarity much less than theirs; so there are as many bands again of
registers with all weights 1, for which the two are the same. Texts with the
same shingles are one node. A bucket of a band is never
expanded to its pairs: its members are compared with leaders, and only what is
then apart is compared further (see ``components``). A pair is a link if the exact Jaccard similarity
of the two sets of shingles is at least ``SIMILARITY``. Groups are the
connected components of the links; the least doc_id of each stays.

Defined cases: null texts are empty; texts without words are copies of one
another; a text of under five words has one shingle of all its words. Rows
with a null doc_id cannot be linked: class_id is null unless a copy has an id,
and they stay. Rows with one doc_id are one document: if their texts differ,
each is compared, and all belong to one group. An empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, heavy_join, materialize, measured, only, steps, text_bytes
from .components import alike, buckets, components, dealt_pairs, group_buckets
from .textvec import U, distinct, mix, shingles, words

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 6


def prob_min_hash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Registers (n x m) of the texts 0..n-1 with the elements ``value`` of ``weight``; 0 where a text has none."""
    when, what, latest = np.full(n * m, np.inf), np.zeros(n * m, U), np.full(n, np.inf)
    coprime = np.array([b for b in range(1, m + 1) if math.gcd(b, m) == 1], np.int64)
    seed = mix(value ^ U(0xA0761D6478BD642F))
    first = (seed % U(m)).astype(np.int64)
    stride = coprime[((seed >> U(32)) % U(len(coprime))).astype(np.int64)]
    time, live = np.zeros(len(value)), np.arange(len(value))
    for k in range(m):
        draw = (mix(value[live] + U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(11)).astype(np.float64)
        time[live] -= np.log((draw + 0.5) * 2.0**-53) * (m / (m - k)) / weight[live]
        live = live[time[live] < latest[doc[live]]]
        if not len(live):
            break
        slot, t = doc[live] * m + (first[live] + k * stride[live]) % m, time[live]
        np.minimum.at(when, slot, t)
        won = when[slot] == t
        what[slot[won]] = value[live[won]]
        touched = np.unique(doc[live])
        latest[touched] = when.reshape(n, m)[touched].max(axis=1)
    return what.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each text."""
    parts = registers.reshape(len(registers), bands, rows)
    total = np.zeros(parts.shape[:2], U) + np.arange(1, bands + 1, dtype=U) * U(0xE7037ED1A0B428DB)
    for r in range(rows):
        total = mix(total + parts[:, :, r]) + U(r + 1)
    return total


def _digests(value: np.ndarray, many: np.ndarray) -> list[pa.Array]:
    """Two sums over each set of shingles that stand for it; ``many`` is the size of each."""
    out, ends = [], np.cumsum(many)
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(value ^ U(salt)), dtype=U)))
        out.append(pa.array((total[ends] - total[ends - many]).view(np.int64)))
    return out


def _shingle_sets(text: pa.StringArray, size: int):
    data, offs = text_bytes(text)
    doc, value, _ = shingles(words(data, offs), size)
    return distinct(doc, value)


def signatures(docs: DataFrame, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each document: doc_id, d1 and d2 (digests of its set of shingles), n (its size), keys (of its bands; null for no words)."""

    def run(batches):
        for b in steps(batches):
            n = len(b)
            doc, value, count = _shingle_sets(b.column("text"), size)
            many = np.bincount(doc, minlength=n)
            weights = 1 + np.log(count), np.ones(len(value))
            both = np.hstack([prob_min_hash(doc, value, w, n, bands * rows) for w in weights])
            keys = band_keys(both, 2 * bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2 * bands), pa.array(keys.ravel()), mask=pa.array(many == 0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_digests(value, many), pa.array(many.astype(np.int64)), lists], ["doc_id", "d1", "d2", "n", "keys"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n long, keys array<long>")


def shingle_sets(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``docs`` (node, d1, d2, n, text): the distinct shingles of those texts that have these digests and size: node, value."""

    def run(batches):
        for b in steps(batches):
            doc, value, _ = _shingle_sets(b.column("text"), size)
            many = np.bincount(doc, minlength=len(b))
            same = np.ones(len(b), bool)
            for name, got in zip(("d1", "d2", "n"), (*_digests(value, many), pa.array(many.astype(np.int64))), strict=True):
                same &= b.column(name).to_numpy() == got.to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), lists], ["node", "value"]).filter(pa.array(same))

    return only(docs, "node", "d1", "d2", "n", "text").mapInArrow(run, "node long, value array<long>")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets of shingles (node, value) have at least this Jaccard similarity."""
    return alike(dealt_pairs(pairs, sets), similarity)


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id of its group), kept, n_shingles."""
    text = ["d1", "d2", "n"]
    signed = materialize(signatures(docs, size, bands, rows), "signed")
    classes = signed.groupBy(*text).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # one row of each text with words, by the least id; a text that no id names is in no link
    named = classes.filter("n > 0 and doc_id is not null").select(*text, "doc_id", "node")
    nodes = signed.join(named, [*text, "doc_id"]).dropDuplicates([*text, "doc_id"])  # dealt by these already
    members = materialize(buckets(nodes.select("node", F.explode("keys").alias("key"))), "members")
    wide, signed = signed, materialize(signed.select("doc_id", *text), "texts")
    drop(wide)
    chosen, wanted = measured(named.join(members.select("node").distinct(), "node", "left_semi"), "chosen", n=F.count("*"))
    # the list of candidates grows with the input: it is never broadcast, at any size
    sets, found = measured(shingle_sets(only(docs, "doc_id", "text").join(chosen.hint("merge"), "doc_id"), size), "sets", n=F.count("*"))
    if found["n"] > wanted["n"]:  # repeated rows
        sets = materialize(sets.dropDuplicates(["node"]), "sets")
    groups = group_buckets(members, lambda pairs: verify(pairs, sets, similarity), lambda nodes: sets.join(nodes.select("node"), "node", "left_semi").withColumn("kind", F.lit(0)), similarity)
    groups = _with_several_texts(signed, classes, groups, text)
    labels = classes.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = materialize(labels.select(*text, "doc_id", "copies", "component"), "labels")
    least = materialize(labels.groupBy("component").agg(F.min("doc_id").alias("class_id")), "least-ids")
    labels = materialize(labels.join(least, "component").select(*text, "copies", "class_id"), "class-ids")
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    return heavy_join(signed.select("doc_id", *text), labels, text, "copies").select("doc_id", "class_id", kept.alias("kept"), F.col("n").alias("n_shingles"))


def _with_several_texts(signed: DataFrame, classes: DataFrame, groups: DataFrame, text: list[str]) -> DataFrame:
    """``groups`` (id, component) with the different texts of one doc_id joined."""
    ends = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*text)).alias("low"), F.max(F.struct(*text)).alias("high"))
    several, found = measured(ends.filter("low <> high").select("doc_id"), "several-texts", n=F.count("*"))
    if not found["n"]:
        return groups
    theirs = signed.join(several, "doc_id").select("doc_id", *text).distinct().join(classes.select(*text, "node"), text)
    links = theirs.join(theirs.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").select(F.col("node").alias("u"), "v")
    return components(links.unionByName(groups.select(F.col("id").alias("u"), F.col("component").alias("v"))))
