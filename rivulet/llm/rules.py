"""Quality rules with adaptive cut-offs from mergeable quantile sketches.

Every document is measured once. The measures of the documents that pass the
base rules go into sketches of logarithmic buckets (relative error
``ACCURACY``; after Masson et al., "DDSketch", 2019), one for each language,
source and measure. Two sketches merge by adding the counts of equal buckets,
so the result does not depend on order, partitioning or retries. A cut-off is
a quartile plus or minus ``FENCE`` times the interquartile range, which is
taken as at least the ``least`` spread of the measure. Where a language and
source have fewer than ``LEAST_ROWS`` documents, their sketches are merged to
the language's, and then to that of all documents.

Nulls: a null text has no words and fails the base rules; null languages and
sources are groups like any other; rows with a null doc_id are measured and
returned. Repeated rows are judged each. An empty table gives an empty result.
Texts are measured whole, whatever their length. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only, steps, text_bytes
from .textvec import SPACE, Words, hash_ranges, same_bytes, shingles, sum_by_text, words

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
ACCURACY, FENCE, LEAST_ROWS = 0.01, 3.0, 200
#: Measure -> (its expression, sides that are fenced, least spread).
MEASURES: dict[str, tuple[str, str, float]] = {
    "symbols_per_word": ("n_symbols / n_words", "upper", 0.1),
    "dup_line_share": ("n_dup_lines / n_lines", "upper", 0.1),
    "mean_word_chars": ("word_chars / n_words", "both", 1.0),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_STATS = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _neighbours(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that follow an equal one of the same text in sorted order, and of the ones before them."""
    by = np.lexsort((value, doc))
    equal = (value[by][1:] == value[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    return by[1:][equal], by[:-1][equal]


def _named(pieces: list, doc: np.ndarray) -> np.ndarray:
    """A number for each distinct piece, where its hash does not tell it from another."""
    known: dict = {}
    return np.array([known.setdefault((d, x), len(known)) for d, x in zip(doc.tolist(), pieces, strict=True)], np.uint64)


def measure_texts(text: pa.StringArray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text.

    Lines and windows are found equal by hashes, and the bytes of all that are found so are compared. Should any differ,
    the batch is counted again by the bytes themselves.
    """
    data, offs = text_bytes(text)
    n = len(text)
    w = words(data, offs)
    head = (data & 0xC0) != 0x80  # first bytes of characters
    word_chars = sum_by_text(head & ~SPACE[data], offs)

    # Lines: the pieces between line feeds that hold the start of a word.
    at = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate((offs[:-1], at + 1)))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    stop = np.where((stop > begin) & (data[stop - 1] == 0x0A) if len(data) else False, stop - 1, stop)
    holds = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    begin, stop = begin[holds], stop[holds]
    line_doc = np.searchsorted(offs, begin, "right") - 1
    again, before = _neighbours(line_doc, hash_ranges(data, begin, stop))
    size = stop - begin
    if (size[again] != size[before]).any() or not same_bytes(data, begin[again], begin[before], size[again]):
        again, before = _neighbours(line_doc, _named([data[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], line_doc))

    doc, value, first = shingles(w, WINDOW)
    full = w.count[doc] >= WINDOW
    doc, value, first = doc[full], value[full], first[full]
    later, earlier = _neighbours(doc, value)
    if not _same_windows(data, w, first[later], first[earlier]):
        pieces = [tuple(data[w.start[k] : w.end[k]].tobytes() for k in range(f, f + WINDOW)) for f in first.tolist()]
        later, earlier = _neighbours(doc, _named(pieces, doc))
    twice = np.zeros(len(value), bool)
    twice[later] = True
    twice[earlier] = True
    cover = np.zeros(len(w.doc) + 1, np.int32)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": sum_by_text(_SYMBOL[data], offs),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_dup_lines": np.bincount(line_doc[again], minlength=n),
        "n_repeat_words": np.bincount(w.doc[repeated], minlength=n),
    }


def _same_windows(data: np.ndarray, w: Words, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the windows from words ``a`` and from words ``b`` on have equal words, pair by pair."""
    for k in range(WINDOW):
        size = w.end[a + k] - w.start[a + k]
        if (size != w.end[b + k] - w.start[b + k]).any() or not same_bytes(data, w.start[a + k], w.start[b + k], size):
            return False
    return True


def _measure(batches):
    for b in steps(batches):
        got = measure_texts(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(got[c].astype(np.int64)) for c in _COUNTS], ["doc_id", "lang", "source", *_COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """Counts of every document: doc_id, lang, source and the counts of the base rules."""
    return only(docs, "doc_id", "lang", "source", "text").mapInArrow(_measure, _STATS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
_ZERO = -(1 << 30)


def sketch(stats: DataFrame) -> DataFrame:
    """Sketches by language, source and measure: rows of (lang, source, measure, bucket, n)."""
    long = stats.filter(~base_failed()).select(
        "lang", "source", F.explode(F.create_map(*[x for k, (e, _, _) in MEASURES.items() for x in (F.lit(k), F.expr(e).cast("double"))])).alias("measure", "value")
    )
    bucket = F.when(F.col("value") <= 0, _ZERO).otherwise(F.ceil(F.log("value") / math.log(_GAMMA))).cast("int")
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, and lower and upper quartile, of each measure by ``keys``; the sketches are merged to these keys."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("rows", F.sum("n").over(whole))
    value = F.when(F.col("bucket") == _ZERO, 0.0).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bucket").cast("double")) / (_GAMMA + 1))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"), *[F.min(F.when(F.col("upto") >= q * F.col("rows"), value)).alias(f"q{int(100 * q)}") for q in (0.25, 0.75)]
    )


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row of cut-offs for each language and source that passed the base rules."""
    own = quartiles(sketches, ["lang", "source"])
    lang = quartiles(sketches, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), *[F.col(c).alias(f"l_{c}") for c in ("rows", "q25", "q75")])
    every = quartiles(sketches, []).select(F.col("measure").alias("a_measure"), *[F.col(c).alias(f"a_{c}") for c in ("q25", "q75")])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(every, F.col("measure") == F.col("a_measure"))

    def q(name: str) -> Column:
        return F.when(F.col("rows") >= LEAST_ROWS, F.col(name)).when(F.col("l_rows") >= LEAST_ROWS, F.col(f"l_{name}")).otherwise(F.col(f"a_{name}"))

    least = F.element_at(F.create_map(*[x for k, (_, _, s) in MEASURES.items() for x in (F.lit(k), F.lit(s))]), F.col("measure"))
    fenced = joined.select("lang", "source", "measure", q("q25").alias("lo"), q("q75").alias("hi"), F.greatest(q("q75") - q("q25"), least).alias("spread"))
    cuts = []
    for k, (_, side, _) in MEASURES.items():
        mine = F.col("measure") == k
        cuts.append(F.max(F.when(mine, F.col("hi") + FENCE * F.col("spread"))).alias(f"max_{k}"))
        cuts.append((F.max(F.when(mine, F.col("lo") - FENCE * F.col("spread"))) if side == "both" else F.lit(None).cast("double")).alias(f"min_{k}"))
    return fenced.groupBy("lang", "source").agg(*cuts)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Verdicts on all documents: doc_id, lang, source, counts, base_failed, kept, and the cut-offs used."""
    stats = materialize(measure(docs), "rule-stats")
    cuts = materialize(thresholds(sketch(stats)), "rule-cuts").withColumnsRenamed({"lang": "c_lang", "source": "c_source"})
    joined = stats.join(cuts, stats["lang"].eqNullSafe(cuts["c_lang"]) & stats["source"].eqNullSafe(cuts["c_source"]), "left").drop("c_lang", "c_source")
    within = F.lit(True)
    for k, (e, _, _) in MEASURES.items():
        within = within & F.coalesce(F.expr(e) <= F.col(f"max_{k}"), F.lit(True)) & F.coalesce(F.expr(e) >= F.col(f"min_{k}"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(within))
