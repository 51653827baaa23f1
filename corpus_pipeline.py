"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a DataFrame: all but the last return the columns of
``documents``. A row with a null doc_id cannot be named in a verdict and
passes the filtering stages; it is packed like any other. Null texts count as
empty. Of rows with one doc_id a filtering stage keeps all if it keeps any; the
two stages of duplicates also keep one of equal rows. Ties are decided as each
operator says. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import materialize
from rivulet.llm.exact_dedup import exact_dedup
from rivulet.llm.near_dedup import near_dedup
from rivulet.llm.queries import packed
from rivulet.llm.resample import resample
from rivulet.llm.rules import quality_rules

#: Sketch-based cut-offs, importance weights and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

_KEY = "__text_key"


def _kept(docs: DataFrame, verdicts: DataFrame, once: bool = False) -> DataFrame:
    """The documents with a verdict to stay; ``once`` leaves one of repeated rows."""
    ids = verdicts.filter("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(ids, "doc_id", "left_semi")
    if once:
        stay = stay.withColumn(_KEY, F.xxhash64("text")).dropDuplicates(["doc_id", _KEY]).drop(_KEY)
    return stay.unionByName(docs.filter("doc_id is null"))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule; texts without words fail."""
    return _kept(docs, quality_rules(docs))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are drawn; all where no labels of both kinds name any of them."""
    return _kept(docs, resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text without spaces: the longest, then the least doc_id."""
    return _kept(docs, exact_dedup(docs), once=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates."""
    return _kept(docs, near_dedup(docs), once=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packed(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
