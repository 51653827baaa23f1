"""Fuzzy duplicate lines across documents: DataFrame operations, with signatures and comparisons in Arrow batches.

Every line of at least ``least`` characters (without spaces at its ends) is
judged, blank ones never. Equal lines are folded first. A distinct line is the
set of its runs of k characters (UTF-16 units): with k in a line of n, one
changed character leaves a similarity of (n - 2k + 1) / (n + 1) if no run occurs
twice. Which of ``LENGTHS`` a line is compared by depends on how many *distinct*
runs it has, counted as the units of a line in which none recurs; so rulers,
leaders and refrains of any length, whose sets are equal, are compared with each
other. Each line has one length at least (but for lines of one unit), since it
has the less distinct runs the shorter they are, and the ranges overlap by more
than lines of a similarity of 0.8 can differ in size. Two lines are linked if
they are alike by a length that both are compared by. Each run is hashed once
and mixed anew for every register (see ``char_runs``), which keeps the least value. The registers are cut
to bands: at a similarity of 0.8 some band agrees with probability
1 - (1 - 0.8**rows)**bands, over 0.999 for each of ``LENGTHS``. Short runs are
common to unlike lines, so they take more rows in a band. Lines that share a
band are compared by the exact Jaccard similarity of their sets (see
``components``), links of at least ``SIMILARITY`` are joined to components by
distributed union-find, and each component keeps its first line, by doc_id and
place in the text. All other occurrences are to be removed.

Defined cases: a null text has no lines. Documents with a null doc_id are
returned with no line removed, and their lines count for no other document.
Repeated rows with one doc_id are one document. An empty table gives an empty
result. Lines of any length are taken whole. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import char_runs
from .common import drop, materialize, only
from .components import accompanied, close_enough, counted, dealt_pairs, group_buckets

LEAST_CHARS, SIMILARITY = 20, 0.8
#: Characters in a run, the UTF-16 units of the shortest and the longest line (none: any) without recurring runs that is compared by them, bands, and rows of a band.
LENGTHS = ((2, 0, 40, 26, 6), (3, 29, 127, 26, 6), (10, 99, None, 10, 3))


def lines_of(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """The lines that are judged: doc_id, line_no (from 0), line."""
    every = only(docs, "doc_id", "text").filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return every.select("doc_id", "line_no", F.trim("raw").alias("line")).filter((F.char_length("line") >= least) & F.col("line").rlike(r"\S"))


def _same() -> list[Column]:
    """Two hashes that stand for a line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def verify(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose lines have at least this Jaccard similarity by runs of one length.

    ``sketches`` is (node, kind, n, ``char_runs.WIDE``): a row for each length of runs that a line is compared by, with its
    number of distinct runs and their sketch; ``texts`` is (node, units). Only pairs that their sketches do not tell apart have
    their lines fetched.
    """
    words = char_runs.WIDE
    of = lambda end: sketches.select(F.col("node").alias(end), F.col("kind").alias("k"), F.col("n").alias(f"n{end}"), *[F.col(w).alias(f"{end}{w}") for w in words])
    may = close_enough([F.col(f"a{w}") for w in words], [F.col(f"b{w}") for w in words], F.col("na"), F.col("nb"), similarity)
    near = materialize(pairs.join(of("a"), "a").join(of("b"), ["b", "k"]).filter(may).select("a", "b", "k"), "near-lines")
    return char_runs.alike(dealt_pairs(near, texts.select("node", F.col("units").alias("value"))), similarity)


def line_groups(docs: DataFrame, least: int = LEAST_CHARS, lengths: tuple = LENGTHS, bands: int | None = None, rows: int | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """For each distinct line with another occurrence or a similar line: h1, h2, and keep_doc, keep_line of the one that stays.

    ``bands`` and ``rows``, where given, stand for those of all ``lengths``.
    """
    lengths = tuple((k, low, high, bands or b, rows or r) for k, low, high, b, r in lengths)
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    folded = lines_of(docs, least).groupBy(*_same()).agg(first, F.first("line").alias("line"), F.count("*").alias("n"))
    units = F.encode("line", "UTF-16BE").alias("units")
    folded = folded.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first.*", "n", "line", units)
    lines = materialize(char_runs.band_keys(folded.drop("line"), lengths), "lines")
    shared = materialize(counted(lines.select("node", F.explode("keys").alias("key"))).select("node", "key"), "shared-keys")
    single = materialize(lines.drop("keys"), "single-lines")  # the keys, most of the bytes, go
    drop(lines)
    sketches = single.select("node", F.inline("sets"))
    members = materialize(counted(accompanied(shared, sketches, similarity)), "line-members")
    drop(shared)
    wanted = single.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "line_no", "h1", "h2", "sets")
    wanted = materialize(wanted, "wanted-lines")
    sketches = wanted.select("node", F.inline("sets"))
    found = lines_of(docs, least).select("doc_id", "line_no", *_same(), "line").join(wanted.drop("sets"), ["doc_id", "line_no", "h1", "h2"]).dropDuplicates(["doc_id", "line_no", "h1", "h2"])
    texts = materialize(found.select("node", units), "wanted-texts")
    wide = lambda nodes: char_runs.wide_sketches(texts.join(nodes, "node").join(sketches.select("node", "kind"), "node"))
    groups = group_buckets(members, lambda pairs: verify(pairs, sketches, texts, similarity), None, similarity, sketches=sketches, wide=wide).withColumnRenamed("id", "node")
    placed = single.select("node", "h1", "h2", F.struct("doc_id", "line_no").alias("first"), "n")
    grouped = materialize(placed.join(groups, "node").select("h1", "h2", "first", "component"), "grouped-lines")
    kept = materialize(grouped.groupBy("component").agg(F.min("first").alias("keep")), "kept-lines")
    repeated = placed.filter("n > 1").join(groups.select("node"), "node", "left_anti").select("h1", "h2", F.col("first").alias("keep"))
    return grouped.join(kept, "component").select("h1", "h2", "keep").unionByName(repeated).select("h1", "h2", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line"))


def removals(docs: DataFrame, **how) -> DataFrame:
    """Each occurrence that goes: doc_id, line_no, keep_doc, keep_line."""
    groups = materialize(line_groups(docs, **how), "line-groups")
    least = how.get("least", LEAST_CHARS)
    placed = lines_of(docs, least).select("doc_id", "line_no", *_same())
    return placed.join(groups, ["h1", "h2"]).filter("doc_id <> keep_doc or line_no <> keep_line").drop("h1", "h2").distinct()


def line_dedup(docs: DataFrame, **how) -> DataFrame:
    """A row for each document: doc_id, n_lines, removed_lines (numbers from 0), keep_doc_ids (where each of them stays)."""
    gone = F.sort_array(F.collect_list(F.struct("line_no", "keep_doc"))).alias("gone")  # no more than the document has lines
    by_doc = removals(docs, **how).groupBy("doc_id").agg(gone)
    every = only(docs, "doc_id", "text").select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    joined = every.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).join(by_doc, "doc_id", "left")
    empty = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    return joined.select("doc_id", "n_lines", F.coalesce("gone.line_no", empty[0]).alias("removed_lines"), F.coalesce("gone.keep_doc", empty[1]).alias("keep_doc_ids"))


def without_lines(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut from their texts; a null text stays null."""
    cut = verdicts.filter("size(removed_lines) > 0").select(F.col("doc_id").alias("__id"), F.col("removed_lines").alias("__gone")).dropDuplicates(["__id"])
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    joined = docs.join(cut, docs["doc_id"] == cut["__id"], "left")
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)).drop("__id", "__gone")
