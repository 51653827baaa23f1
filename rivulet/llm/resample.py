"""Quality classifier by importance resampling.

After Xie et al., "Data Selection for Language Models via Importance
Resampling" (2023): texts are bags of hashed word n-grams (single tokens and
pairs, in ``BUCKETS`` buckets), and two multinomial models are fitted, one to
target text (labelled good and not toxic) and one to all raw text. A text's
log importance weight is the sum of log p_target - log p_raw over its n-grams.
Documents are drawn without replacement by Gumbel top-k: the k largest of
log weight / ``TEMPERATURE`` plus Gumbel noise stay, which at a temperature of 1
is a draw in proportion to the weights, and nearer to an even one above it.

The raw model counts every document. The target model counts at most
``TARGET_ROWS`` labelled documents (the first by a hash of the id), which
bounds what is broadcast; the models' size is ``BUCKETS`` numbers.

Weights are products over a text's n-grams, so long texts have extreme ones.
Each is taken against a price per n-gram: log weight = sum - price * n-grams.
The labels are halved by a hash of the id: one half makes the target model, and
the price comes from the other, which the model has not seen. It is the mean
per n-gram that all but ``LOST`` of that half's good documents reach (but not
more than the best divide between its good and bad). ``k`` is a parameter; if
none is given it is the number of documents whose log weight is not negative.

Defined cases: a null or empty text has no n-grams and weight 0, and counts as
reaching the price. Rows with a null doc_id are scored without noise. A label
with a null id or quality is left out; documents with several labels are good
if all are. Without labels of both kinds everything is kept. Repeated rows get
the same noise, so all of them stay or go; documents that tie with the k-th
stay. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only, steps, text_bytes
from .textvec import U, cut, hash_ranges, mix

BUCKETS, TARGET_ROWS, LOST, TEMPERATURE, SEED, BINS = 1 << 18, 50_000, 0.002, 1.0, 7, 4096
#: Kinds of bytes: 0 spaces and control characters, 1 parts of words, 2 other signs.
_KIND = np.full(256, 2, np.uint8)
_KIND[:0x21] = 0
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _KIND[_a:_b] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def features(text: pa.StringArray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every token and every pair of neighbouring tokens."""
    data, offs = text_bytes(text)
    data = _LOWER[data]
    doc, start, end = cut(_KIND[data], offs)
    one = hash_ranges(data, start, end)
    pair = doc[1:] == doc[:-1]
    two = mix(one[:-1][pair] * U(0xC2B2AE3D27D4EB4F) + one[1:][pair] * U(0x165667B19E3779F9) + U(1))
    return np.concatenate((doc, doc[1:][pair])), (np.concatenate((one, two)) % U(buckets)).astype(np.int64)


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of the labelled documents of the target model, ``rows`` at most."""
    good = labelled(labels).filter("good and toxic = 0").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled(labels: DataFrame) -> DataFrame:
    """One label for each labelled document: doc_id, good, toxic."""
    known = only(labels, "doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def halves(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels for the target model and those for the price."""
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    kinds = labelled(labels).groupBy(half.alias("half")).agg(F.count_if(F.expr("good and toxic = 0")).alias("target"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    found = {r["half"]: r for r in kinds.collect()}
    if len(found) < 2 or not (found[0]["target"] and found[1]["good"] and found[1]["bad"]):
        return labels, labels
    return labels.filter(half == 0), labels.filter(half == 1)


def count_features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (text, target) -> bucket, raw and target counts over all documents."""

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for b in steps(batches):
            doc, at = features(b.column("text"), buckets)
            total[0] += np.bincount(at, minlength=buckets)
            wanted = np.asarray(b.column("target").to_numpy(zero_copy_only=False), bool)
            total[1] += np.bincount(at[wanted[doc]], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    return docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one count added to each; zeros without a target."""
    got, raw, target = counts.toPandas(), np.ones(buckets), np.ones(buckets)
    raw[got["bucket"]] += got["raw"]
    target[got["bucket"]] += got["target"]
    if target.sum() == buckets:
        return np.zeros(buckets, np.float32)
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams, weight (log importance) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for b in steps(batches):
            doc, at = features(b.column("text"), len(model.value))
            n = np.bincount(doc, minlength=len(b))
            weight = np.bincount(doc, model.value[at], len(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_grams", "weight"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, weight double")


def price_of(scored: DataFrame, labels: DataFrame, lost: float = LOST) -> float | None:
    """The mean weight a document must reach; None without labels of both kinds.

    The labelled means are counted in ``BINS`` equal bins, so the driver gets no more rows than that.
    """
    known = scored.join(labelled(labels), "doc_id").filter("n_grams > 0").select("good", (F.col("weight") / F.col("n_grams")).alias("mean"))
    ends = known.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return None
    lo, step = ends["lo"], (ends["hi"] - ends["lo"]) / BINS
    at = F.least(F.floor((F.col("mean") - lo) / step), F.lit(BINS - 1)).cast("int")
    count = np.zeros((2, BINS))
    for r in known.groupBy("good", at.alias("bin")).agg(F.count("*").alias("n")).collect():
        count[int(r["good"]), r["bin"]] = r["n"]
    if not count.sum(axis=1).all():
        return None
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(count, axis=1)), axis=1)[:, :-1] / count.sum(axis=1, keepdims=True)
    divide = int(np.argmax(below[0] - below[1]))
    allowed = int(np.flatnonzero(below[1] <= lost)[-1])
    return lo + step * min(divide, allowed)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest ``key`` (the least if there are fewer), by counting in ever finer bins; no more than a bin's counts come to the driver."""
    ends = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, k = ends["lo"], ends["hi"], min(k, ends["n"])
    while lo < hi:
        step = (hi - lo) / BINS
        if not step or lo + step == lo:
            break
        at = F.least(F.floor((F.col("key") - lo) / step), F.lit(BINS - 1)).cast("int")
        inside = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi))
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, lost: float = LOST, target_rows: int = TARGET_ROWS, temperature: float = TEMPERATURE, k: int | None = None) -> DataFrame:
    """Verdicts on all documents: doc_id, n_grams, weight, key, kept."""
    model, held_out = halves(only(labels, "doc_id", "quality", "toxic"))
    wanted = F.broadcast(target_ids(model, target_rows).withColumn("target", F.lit(True)))  # target_rows ids at most
    marked = only(docs, "doc_id", "text").join(wanted, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    scored = materialize(score(docs, log_ratios(count_features(marked))), "scores")
    price = price_of(scored, held_out, lost)
    if price is None:
        return scored.select("*", F.col("weight").alias("key"), F.lit(True).alias("kept"))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = F.when(F.col("doc_id").isNull(), 0.0).otherwise(-F.log(-F.log(uniform)))
    keyed = scored.withColumn("key", (F.col("weight") - price * F.col("n_grams")) / temperature + noise)
    if k is None:
        k = scored.filter(f"n_grams = 0 or weight >= {price!r} * n_grams").count()
    least = kth_largest(keyed.select("key"), k) if k else math.inf
    return keyed.withColumn("kept", F.col("key") >= F.lit(least))
