"""How far the sources of a language lie apart in their use of terms, by inclusion and exclusion over supports.

A term is a run of letters (all but ASCII signs and digits, capitals A-Z made small). A language keeps the terms that stand
in ``LEAST_DOCS`` of its documents. A group (language, source) gives each of the V kept terms the smoothed share
p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)); z is this share for a count of 0. The distance of two groups,
the sum of abs(p - q) over all kept terms, is not summed term by term. With the supports S and T of the groups (the terms
that occur in each), it is

* the terms of S against z of the other, from S's histogram of counts, and those of T likewise,
* for terms of both, abs(p - q) less the two prices above, from a join of the postings of each term,
* abs(z - z) for each of the V - |S| - |T| + |S and T| terms that neither has.

Only terms that two groups share meet in a join. All arithmetic is of whole numbers. Counts are summed by (language, source,
term) before anything is grouped by less, so neither a large source nor a frequent term makes a large task.

Nulls: null texts, languages and sources are read as empty strings. Rows of one doc_id are documents each, and so are
repeated rows. A group without kept terms has N = 0; where a language keeps none, all its distances are 0 and there are no
rows of terms. An empty table gives an empty result. Texts are counted whole, long ones in blocks. Ties go to the item that
is first in UTF-8. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_join, materialize, only, steps, text_bytes
from .textvec import LOWER, blocks, cut

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that one step counts, and keys over which the rows of one language are dealt.
STEP, SALTS = 8 << 20, 16

_LETTER = np.ones(256, bool)
_LETTER[:0x41] = _LETTER[0x5B:0x61] = _LETTER[0x7B:0x80] = False
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Text number of each term, and the terms."""
    letter = _LETTER[data]
    doc, start, end = cut(letter.view(np.uint8), offs)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    return doc, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(LOWER[data[letter]])).dictionary_encode()


def _tally(doc: np.ndarray, code: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and terms that occur, with their counts of occurrences and documents."""
    pair, n = np.unique(doc * width + code, return_counts=True)
    key = group[pair // width] * width + pair % width
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at] // width, key[at] % width, np.add.reduceat(n, at) if len(at) else n, np.diff(np.append(at, len(key)))


def _count(batches):
    for b in steps(batches, limit=STEP):
        lang, source = (pc.fill_null(b.column(c), "").dictionary_encode() for c in ("lang", "source"))
        data, offs = text_bytes(b.column("text"))
        across = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * across + source.indices.to_numpy()
        seen: set | None = set() if len(b) == 1 and len(data) > 2 * STEP else None
        for lo, hi in blocks(data, ~_LETTER, 2 * STEP) if seen is not None else [(0, len(data))]:
            doc, terms = _terms(data[lo:hi], np.array([0, hi - lo]) if seen is not None else offs)
            g, code, n, docs = _tally(doc, terms.indices.to_numpy().astype(np.int64), group, max(1, len(terms.dictionary)))
            named = terms.dictionary.take(pa.array(code))
            if seen is not None:  # one document in several blocks
                docs = np.array([x not in seen for x in named.to_pylist()], np.int64)
                seen.update(named.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // across)), source.dictionary.take(pa.array(g % across)), named.cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))],
                ["lang", "source", "term", "n", "docs"],
            )


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)) by long division to the base 1000, within 64 bits.

    No count is over its total, so remainders times 1000 fit as long as a language has under 9e15 terms in all.
    """
    whole = F.nullif(total + SMOOTH * terms, F.lit(0))
    rest, digits = count + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        digits = digits * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return digits + 1


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.hash(*by), F.lit(SALTS)))


def _for_each_deal(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Counts of the kept terms: lang, source, term, n, the language's ``total``, and whether the row is the term's first."""
    counts = only(docs, "lang", "source", "text").mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    found = counts.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return found.filter(F.col("docs") >= least).drop("docs")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """All groups with their totals: lang, source, n_group, support, and the language's n_lang and n_terms; z is null if it keeps none."""
    every = only(docs, "lang", "source").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("support"), F.sum(F.col("first").cast("long")).alias("firsts"))
    found = every.join(sums, ["lang", "source"], "left").fillna(0, ["n_group", "support", "firsts"])
    whole = found.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.sum("firsts").alias("n_terms"))
    return found.drop("firsts").join(whole, "lang").withColumn("z", share(F.lit(0).cast("long"), F.col("n_group"), F.col("n_terms")))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ``pair`` or ``term``, item, value, rank."""
    kept = materialize(kept_terms(docs, least), "terms")
    groups = materialize(groups_of(docs, kept), "groups")
    rows = heavy_join(kept, groups, ["lang", "source"], "support")
    p, q = share(F.col("n"), F.col("n_group"), F.col("n_terms")), share(F.col("total"), F.col("n_lang"), F.col("n_terms"))
    postings = materialize(rows.select("lang", "source", "term", p.alias("p"), q.alias("q"), "z"), "postings")

    others = _for_each_deal(groups.select("lang", F.col("source").alias("item"), F.col("z").alias("item_z"), F.col("support").alias("item_support")))
    apart = F.col("source") != F.col("item")
    histogram = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    one_sided = _dealt(histogram, "source", "p").join(others, ["lang", "salt"]).filter(apart)
    one_sided = one_sided.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("item_z"))).alias("value"))
    none = (F.col("n_terms") - F.col("support") - F.col("item_support")) * F.abs(F.col("z") - F.col("item_z"))
    both_zero = _dealt(groups, "source").join(others, ["lang", "salt"]).filter(apart).select("lang", "source", "item", F.coalesce(none, F.lit(0)).alias("value"))
    mine, theirs = (postings.select("lang", "term", *[F.col(a).alias(b) for a, b in zip(("source", "p", "z"), names, strict=True)]) for names in (("source", "p", "z"), ("item", "q", "y")))
    gain = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("y")) - F.abs(F.col("z") - F.col("q")) + F.abs(F.col("z") - F.col("y"))
    overlaps = mine.join(theirs, ["lang", "term"]).filter(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(gain).alias("value"))
    mirrored = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = both_zero.unionByName(mirrored(one_sided)).unionByName(mirrored(overlaps)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = postings.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.withColumns({"part": F.lit(part), "rank": place})
    out = ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
