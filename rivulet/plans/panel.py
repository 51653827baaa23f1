"""The daily panel that the queries on ``events`` share, in DataFrame form and as SQL.

One sequence per user, one channel per type of event. The channels are dense,
so thresholds that count days are parameters here and much lower than the
defaults of the operators, which are meant for records of months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cut
from ..operators.sequence import densify, ordered, relative_day, rising, run_id

MENSES_TOTAL, GAP, FOLD, MUCUS_DAYS, TEMP_DAYS = 80.0, 2, -5, 2, 3
MUCUS_BREAKS, MUCUS_LABELS = [-1.0, 13.3, 28.5, 47.6, 79.8, 1e9], ["none", "creamy", "fertile", "very_fertile", "sticky"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(x: Column | str) -> Column:
    """Two-decimal doubles as decimals, whose sums do not depend on order."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")


def mean(x: Column) -> Column:
    """Mean of two-decimal values by an exact sum."""
    return F.sum(exact(x)).cast("double") / F.nullif(F.count(x), F.lit(0))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seq_id"), F.to_date("ts").alias("d")).agg(
        F.sum(exact(of("purchase"))).cast("double").alias("bleeding_total"), mean(of("view")).alias("temp"), mean(of("click")).alias("mucus_mean"),
        F.max(of("signup")).alias("lh_value"), F.max(of("error")).alias("preg_value"), F.count(F.lit(1)).alias("n_events"),
    )


DAILY = """
daily AS (
    SELECT user_id AS seq_id, CAST(ts AS DATE) AS d,
        CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase') AS DOUBLE) AS bleeding_total,
        CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'view') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'view'), 0) AS temp,
        CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'click'), 0) AS mucus_mean,
        max(value) FILTER (event_type = 'signup') AS lh_value, max(value) FILTER (event_type = 'error') AS preg_value, count(*) AS n_events
    FROM events GROUP BY 1, 2)"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_day(densify(daily(spark, sf_dir))).withColumn("t", F.col("t").cast("long"))


DENSE = (
    DAILY
    + """,
dense AS (
    SELECT s.seq_id, s.d, date_diff('day', s.a, s.d) + 1 AS t, bleeding_total, temp, mucus_mean, lh_value, preg_value, n_events
    FROM (SELECT seq_id, min(d) AS a, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY seq_id) s
    LEFT JOIN daily x ON x.seq_id = s.seq_id AND x.d = s.d)"""
)


def menses() -> Column:
    return F.coalesce(F.col("bleeding_total") >= MENSES_TOTAL, F.lit(False))


def cycled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel with menses, day 1 of a cycle, and cycle number; 0 before the first cycle."""
    df = dense(spark, sf_dir).withColumn("menses", menses())
    df = df.withColumn("day1", rising(F.col("menses"), ordered("seq_id")))
    return df.withColumn("cycle", run_id(F.col("day1"), "seq_id"))


CYCLED = (
    DENSE
    + f""",
marked AS (SELECT *, coalesce(bleeding_total >= {MENSES_TOTAL}, false) AS menses FROM dense),
edged AS (SELECT *, menses AND NOT coalesce(lag(menses) OVER w, false) AS day1 FROM marked WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
cycled AS (SELECT *, CAST(sum(CAST(day1 AS INT)) OVER (PARTITION BY seq_id ORDER BY t) AS BIGINT) AS cycle FROM edged)"""
)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycled panel with categorical channels: mucus, LH, preg."""
    df = cycled(spark, sf_dir)
    label = lambda x, at: F.when(F.col(x) > at, "pos").when(F.col(x).isNotNull(), "neg")
    return df.withColumns({"mucus": cut("mucus_mean", MUCUS_BREAKS, MUCUS_LABELS), "LH": label("lh_value", 45.0), "preg": label("preg_value", 45.0)})


OBSERVED = (
    CYCLED
    + """,
observed AS (
    SELECT *, CASE """
    + " ".join(f"WHEN mucus_mean > {a} AND mucus_mean <= {b} THEN '{m}'" for a, b, m in zip(MUCUS_BREAKS, MUCUS_BREAKS[1:], MUCUS_LABELS))
    + """ END AS mucus,
        CASE WHEN lh_value > 45 THEN 'pos' WHEN lh_value IS NOT NULL THEN 'neg' END AS LH,
        CASE WHEN preg_value > 45 THEN 'pos' WHEN preg_value IS NOT NULL THEN 'neg' END AS preg
    FROM cycled)"""
)


class Registry:
    """Queries by name, each with the SQL that gives the same rows where there is one."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return register
