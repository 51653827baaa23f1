"""The queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, divergence, exact_dedup, layout, licenses, line_dedup, near_dedup, packing, phrases, quotes, resample, rules, subwords
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with their slots, and a checksum for the tokens of each."""
    from .common import materialize

    pieces = packing.tokenize(docs).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return packing.assign(materialize(pieces, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = subwords.encode_decode(_table(spark, sf_dir, "documents"))
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agreed")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return got.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.quality_rules(_table(spark, sf_dir, "documents"))
    return got.drop(*[c for c in got.columns if c.startswith(("max_", "min_"))])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), least=1)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_chats(_table(spark, sf_dir, "conversations"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op10_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extract(_table(spark, sf_dir, "pages"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = credentials.secret_spans(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return got.select("doc_id", *[of(k) for k in credentials.KINDS], F.sha2(digest(base), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_sentencepiece,
        op3_exact_dedup,
        op4_quality_classifier,
        op5_quality_rules,
        op6_line_dedup,
        op7_near_dedup,
        op8_chat_quotes,
        op9_license_scan,
        op10_html_layout,
        op11_secret_scan,
        op12_phrases,
        op13_source_divergence,
    )
}
