"""Queries on the daily panel: windows, runs, rolling aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators.rolling import hold, isolated, range_roll, roll
from ..operators.scan import scanned
from ..operators.sequence import average_overlaps, ends, folded, gap_runs, locf, longest_runs, ordered, places, runs, top
from .panel import CYCLED, DAILY, DENSE, FOLD, GAP, Registry, cycled, daily, dense, exact, table

SEQUENCES = Registry()
add = SEQUENCES.add


@add(f"WITH {DAILY} SELECT * FROM daily")
def daily_panel(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf)


@add(f"WITH {DENSE} SELECT seq_id, d, n_events, n_events IS NULL AS added FROM dense")
def densified(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).select("seq_id", "d", "n_events", F.col("n_events").isNull().alias("added"))


@add(f"WITH {DENSE} SELECT seq_id, d, t FROM dense WHERE n_events IS NOT NULL")
def rel_day(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).filter("n_events is not null").select("seq_id", "d", "t")


@add(f"""WITH {DENSE} SELECT seq_id, t, last_value(temp IGNORE NULLS) OVER w AS temp_locf, last_value(mucus_mean IGNORE NULLS) OVER w AS mucus_locf
    FROM dense WINDOW w AS (PARTITION BY seq_id ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def locf_channels(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).select("seq_id", "t", locf("temp", "seq_id").alias("temp_locf"), locf("mucus_mean", "seq_id").alias("mucus_locf"))


@add(f"""WITH {DENSE} SELECT seq_id, t, lag(n_events, 6) OVER w AS before6, lag(n_events, 13) OVER w AS before13, lead(n_events) OVER w AS after1
    FROM dense WINDOW w AS (PARTITION BY seq_id ORDER BY t)""")
def lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    w = ordered("seq_id")
    return dense(spark, sf).select("seq_id", "t", F.lag("n_events", 6).over(w).alias("before6"), F.lag("n_events", 13).over(w).alias("before13"), F.lead("n_events").over(w).alias("after1"))


@add(f"WITH {CYCLED} SELECT seq_id, t, menses, day1, cycle FROM cycled")
def rising_edge_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return cycled(spark, sf).select("seq_id", "t", "menses", "day1", "cycle")


_RUNS = """
started AS (SELECT *, coalesce(menses <> lag(menses) OVER w, true) AS new FROM marked WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
numbered AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY seq_id ORDER BY t) AS BIGINT) AS run FROM started)"""


@add(f"WITH {CYCLED}, {_RUNS} SELECT seq_id, run, menses AS value, min(t) AS first, max(t) AS last, count(*) AS length FROM numbered GROUP BY seq_id, run, menses")
def run_islands(spark: SparkSession, sf: str) -> DataFrame:
    return runs(cycled(spark, sf), "menses")


@add(f"""WITH {DENSE}, m AS (SELECT seq_id, t, n_events IS NULL AS missing FROM dense),
    e AS (SELECT *, missing AND NOT coalesce(lag(missing) OVER (PARTITION BY seq_id ORDER BY t), false) AS up FROM m),
    r AS (SELECT *, CAST(sum(CAST(up AS INT)) OVER (PARTITION BY seq_id ORDER BY t) AS BIGINT) AS run FROM e)
    SELECT seq_id, t, CASE WHEN missing THEN run END AS gap_id, CASE WHEN missing THEN count(*) OVER (PARTITION BY seq_id, run, missing) END AS gap_length,
        missing AND count(*) OVER (PARTITION BY seq_id, run, missing) >= {GAP} AS gap FROM r""")
def gap_runs_flag(spark: SparkSession, sf: str) -> DataFrame:
    return gap_runs(dense(spark, sf), F.col("n_events").isNull(), GAP).select("seq_id", "t", "gap_id", "gap_length", "gap")


@add(f"""WITH {DENSE}, m AS (SELECT seq_id, t, n_events IS NOT NULL AS tracked FROM dense),
    e AS (SELECT *, coalesce(tracked <> lag(tracked) OVER (PARTITION BY seq_id ORDER BY t), true) AS new FROM m),
    r AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY seq_id ORDER BY t) AS run FROM e),
    n AS (SELECT seq_id, run, tracked, count(*) AS length FROM r GROUP BY ALL)
    SELECT seq_id, tracked AS value, max(length) AS longest FROM n GROUP BY ALL""")
def longest_run(spark: SparkSession, sf: str) -> DataFrame:
    return longest_runs(dense(spark, sf).withColumn("tracked", F.col("n_events").isNotNull()), "tracked")


@add(f"""WITH {CYCLED}, p AS (SELECT seq_id, cycle, t, row_number() OVER w AS day, row_number() OVER w - count(*) OVER (PARTITION BY seq_id, cycle) - 1 AS day_back
        FROM cycled WINDOW w AS (PARTITION BY seq_id, cycle ORDER BY t))
    SELECT *, CASE WHEN day_back >= {FOLD} THEN day_back ELSE day END AS folded FROM p""")
def cycle_day_folded(spark: SparkSession, sf: str) -> DataFrame:
    df = places(cycled(spark, sf).select("seq_id", "cycle", "t"), ["seq_id", "cycle"])
    df = df.withColumns({"day": F.col("day").cast("long"), "day_back": F.col("day_back").cast("long")})
    return df.withColumn("folded", folded("day", "day_back", FOLD))


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).withColumn("x", F.col("n_events"))


@add(f"""WITH {DENSE} SELECT seq_id, t, CASE WHEN count(*) OVER w = 7 THEN round(avg(n_events) OVER w, 9) END AS mean7
    FROM dense WINDOW w AS (PARTITION BY seq_id ORDER BY t ROWS 6 PRECEDING)""")
def roll_mean_right(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).select("seq_id", "t", F.round(roll("x", F.avg, 7, ordered("seq_id")), 9).alias("mean7"))


@add(f"""WITH {DENSE} SELECT seq_id, t, CASE WHEN count(*) OVER w = 5 THEN round(avg(n_events) OVER w, 9) ELSE 0 END AS mean5
    FROM dense WINDOW w AS (PARTITION BY seq_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def roll_mean_center_fill0(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).select("seq_id", "t", F.round(roll("x", F.avg, 5, ordered("seq_id"), "center", 0.0), 9).alias("mean5"))


@add(f"""WITH {CYCLED} SELECT seq_id, t, CASE WHEN count(*) OVER w = 5 THEN sum(CAST(n_events > 1 AS INT)) OVER w = 5 END AS all5
    FROM cycled WINDOW w AS (PARTITION BY seq_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def roll_sum_left_eq(spark: SparkSession, sf: str) -> DataFrame:
    df = cycled(spark, sf).withColumn("many", (F.col("n_events") > 1).cast("int"))
    return df.select("seq_id", "t", (roll("many", F.sum, 5, ordered("seq_id"), "left") == 5).alias("all5"))


@add(f"""WITH {DENSE}, s AS (SELECT seq_id, t, abs(lead(n_events) OVER (PARTITION BY seq_id ORDER BY t) - n_events) AS step FROM dense)
    SELECT seq_id, t, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(step) OVER w AS BIGINT) END AS moved
    FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)""")
def roll_absdiff_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = ordered("seq_id")
    df = dense(spark, sf).withColumn("step", F.abs(F.lead("n_events").over(w) - F.col("n_events")))
    return df.select("seq_id", "t", roll("step", F.sum, 4, w, "left").alias("moved"))


@add(f"""WITH {DENSE} SELECT seq_id, t, CASE WHEN count(*) OVER w = 7 THEN round(stddev_samp(n_events) OVER w, 6) END AS sd7
    FROM dense WINDOW w AS (PARTITION BY seq_id ORDER BY t ROWS 6 PRECEDING)""")
def roll_sd(spark: SparkSession, sf: str) -> DataFrame:
    one = F.count("x").over(ordered("seq_id").rowsBetween(-6, 0)) > 1  # the deviation of a single value is missing
    return _rolled(spark, sf).select("seq_id", "t", F.when(one, F.round(roll("x", F.stddev_samp, 7, ordered("seq_id")), 6)).alias("sd7"))


@add("""WITH o AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
    n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN CURRENT ROW AND 179 FOLLOWING) AS n FROM o)
    SELECT o_custkey, max(n) AS most, max(n) >= 3 AS dense FROM n GROUP BY o_custkey""")
def range_window_180d(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.observe import tracking_density

    days = table(spark, sf, "orders").select("o_custkey", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("rel_date"))
    return tracking_density(days, "o_custkey", least=3)


@add(f"""WITH {DAILY}, x AS (SELECT seq_id, date_diff('day', DATE '2000-01-01', d) AS day, n_events FROM daily)
    SELECT seq_id, day, CAST(sum(n_events) OVER (w RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS BIGINT) AS week_before,
        CAST(sum(n_events) OVER (w RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS BIGINT) AS two_days
    FROM x WINDOW w AS (PARTITION BY seq_id ORDER BY day)""")
def calendar_lag_sums(spark: SparkSession, sf: str) -> DataFrame:
    df = daily(spark, sf).withColumn("day", F.datediff("d", F.lit("2000-01-01").cast("date")).cast("long"))
    return df.select("seq_id", "day", range_roll("n_events", F.sum, -7, -1, ["seq_id"], "day").alias("week_before"), range_roll("n_events", F.sum, 0, 1, ["seq_id"], "day").alias("two_days"))


@add(f"""WITH {CYCLED} SELECT seq_id, t, max(CAST(day1 AS INT)) OVER (PARTITION BY seq_id ORDER BY t ROWS 6 PRECEDING) AS held FROM cycled""")
def box_filter_hold(spark: SparkSession, sf: str) -> DataFrame:
    return cycled(spark, sf).select("seq_id", "t", hold(F.col("day1").cast("int"), 7, ordered("seq_id")).alias("held"))


@add(f"""WITH {CYCLED} SELECT seq_id, t, CASE WHEN menses AND sum(CAST(menses AS INT)) OVER (PARTITION BY seq_id ORDER BY t ROWS 4 PRECEDING) = 1 THEN 1 ELSE 0 END AS alone FROM cycled""")
def isolated_trigger(spark: SparkSession, sf: str) -> DataFrame:
    return cycled(spark, sf).withColumn("m", F.col("menses").cast("int")).select("seq_id", "t", isolated("m", 5, ordered("seq_id")).alias("alone"))


@add("""SELECT user_id, arg_min(event_type, event_id) AS first_event_type, arg_max(event_type, event_id) AS last_event_type,
    arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id""")
def first_last_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return ends(table(spark, sf, "events"), ["user_id"], "event_id", ["event_type", "value"])


@add("""SELECT o_custkey, o_orderkey, o_totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) WHERE p = 1""")
def top1_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return top(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def topn_total_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "o_totalprice")


_PROBS = """kinds AS (SELECT user_id AS seq_id, CAST(ts AS DATE) AS d, event_type AS state, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM events GROUP BY ALL),
    probs AS (SELECT *, weight / CAST(sum(CAST(weight AS DECIMAL(18,2))) OVER (PARTITION BY seq_id, d) AS DOUBLE) AS prob FROM kinds)"""


def _probs(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "events").groupBy(F.col("user_id").alias("seq_id"), F.to_date("ts").alias("d"), F.col("event_type").alias("state")).agg(F.sum(exact("value")).cast("double").alias("weight"))
    total = F.sum(exact("weight")).over(Window.partitionBy("seq_id", "d")).cast("double")
    return kinds.withColumn("total", total).withColumn("prob", ratio("weight", "total"))  # a day's values can all be 0


@add(f"""WITH {_PROBS} SELECT seq_id, d, state, prob FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, d ORDER BY prob DESC, state) AS p FROM probs) WHERE p = 1""")
def argmax_by_prob(spark: SparkSession, sf: str) -> DataFrame:
    return top(_probs(spark, sf), ["seq_id", "d"], [F.desc("prob"), F.asc_nulls_last("state")]).select("seq_id", "d", "state", "prob")


@add("""WITH o AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, CAST(value AS DECIMAL(18,2)) AS v FROM events)
    SELECT user_id, d, event_type, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS value, count(*) > 1 AS overlap FROM o GROUP BY ALL""")
def dup_overlap_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("d"), "event_type", exact("value").alias("value"))
    got = average_overlaps(df.withColumn("value", F.col("value").cast("double")), ["user_id", "d", "event_type"], "value")
    return got.withColumn("value", F.round("value", 6))


@add(f"""WITH {DAILY}, k AS (SELECT *, date_diff('day', DATE '2000-01-01', d) AS t FROM daily), b AS (SELECT *, lag(n_events) OVER w AS before, lag(n_events > 1) OVER w AS was FROM k WINDOW w AS (PARTITION BY seq_id ORDER BY t))
    SELECT seq_id, t, CAST(sum(n_events) OVER w AS BIGINT) AS events_so_far, last_value(lh_value IGNORE NULLS) OVER w AS lh_last, before AS events_before, CAST(sum(CAST(coalesce((n_events > 1) <> was, true) AS INT)) OVER w AS BIGINT) AS run
    FROM b WINDOW w AS (PARTITION BY seq_id ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def blocked_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Running sum, last known value, row before and run id of the recorded days, in blocks of a week that carry over."""
    days = daily(spark, sf).withColumn("t", F.datediff("d", F.lit("2000-01-01")))
    got = scanned(days, {"events_so_far": "n_events"}, {"lh_last": "lh_value"}, {"events_before": "n_events"}, {"run": F.col("n_events") > 1}, size=7)
    return got.select("seq_id", F.col("t").cast("long").alias("t"), "events_so_far", "lh_last", "events_before", "run")
