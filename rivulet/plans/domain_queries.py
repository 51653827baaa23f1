"""Queries of the domain operators on the daily panel."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..hsmm.cycle_model import cycle_model, dedicated
from ..hsmm.model import FLOOR
from ..operators import cycles as C
from ..operators import evaluate as E
from ..operators import likelihood, observe, predict, stitching, tracking
from ..operators.sequence import ordered, rising, windows_of
from .panel import CYCLED, FOLD, MUCUS_DAYS, OBSERVED, TEMP_DAYS, Registry, cycled, observed, table

DOMAIN = Registry()
add = DOMAIN.add
CHANNELS = ["bleeding_total", "mucus", "temp", "LH", "preg"]

_CLASS = f"""classes AS (SELECT seq_id, cycle, count(mucus) AS n_mucus, count(temp) AS n_temp, count(LH) AS n_LH, count(preg) AS n_preg, 1 AS n_cycles,
        CASE WHEN count(mucus) >= {MUCUS_DAYS} AND count(temp) >= {TEMP_DAYS} THEN 'BTM' WHEN count(mucus) >= {MUCUS_DAYS} THEN 'BM' WHEN count(temp) >= {TEMP_DAYS} THEN 'BT'
            WHEN count(LH) >= 1 THEN 'BLH' WHEN count(preg) >= 1 THEN 'BP' ELSE 'B' END AS tracking_behavior FROM observed GROUP BY seq_id, cycle)"""


@add(f"WITH {OBSERVED}, {_CLASS} SELECT seq_id, cycle, n_mucus, n_temp, n_LH, n_preg, CAST(n_cycles AS BIGINT) AS n_cycles, tracking_behavior FROM classes")
def tracking_class(spark: SparkSession, sf: str) -> DataFrame:
    got = tracking.tracking_class(observed(spark, sf), ["seq_id", "cycle"], mucus=MUCUS_DAYS, temp=TEMP_DAYS)
    return got.withColumn("n_cycles", F.col("n_cycles").cast("long"))


_STRETCHES = f"""{_CLASS},
    firsts AS (SELECT seq_id, cycle, t, menses, coalesce(lag(menses) OVER (PARTITION BY seq_id, cycle ORDER BY t) <> menses, true) AS new FROM observed),
    runs AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY seq_id, cycle ORDER BY t) AS run FROM firsts),
    spans AS (SELECT seq_id, cycle, min(t) AS start, max(t) AS stop, CAST(sum(CAST(run = 1 AND menses AS INT)) AS BIGINT) AS period FROM runs GROUP BY seq_id, cycle),
    named AS (SELECT s.*, tracking_behavior, coalesce(tracking_behavior <> lag(tracking_behavior) OVER (PARTITION BY s.seq_id ORDER BY s.cycle), true) AS new FROM spans s JOIN classes c ON c.seq_id = s.seq_id AND c.cycle = s.cycle),
    numbered AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY seq_id ORDER BY cycle) AS BIGINT) AS stretch_number FROM named),
    whole AS (SELECT seq_id, stretch_number, min(tracking_behavior) AS tracking_behavior, min(start) AS start, max(stop) AS stop, arg_min(period, cycle) AS period FROM numbered GROUP BY seq_id, stretch_number),
    longer AS (SELECT seq_id, stretch_number, tracking_behavior, start, stop + coalesce(lead(period) OVER (PARTITION BY seq_id ORDER BY stretch_number), 0) AS "end" FROM whole)"""


@add(f'WITH {OBSERVED}, {_STRETCHES} SELECT *, "end" - start AS length FROM longer WHERE "end" > start')
def tracking_stretches(spark: SparkSession, sf: str) -> DataFrame:
    return tracking.stretches(observed(spark, sf), MUCUS_DAYS, TEMP_DAYS)


#: A decoding that SQL can follow: the state from thresholds of the panel, and a probability from the day's events.
_DECODED = f"""{OBSERVED}, decoded AS (SELECT seq_id, t, CASE WHEN menses THEN 1 WHEN coalesce(lh_value, 0) > 100 THEN 5 WHEN coalesce(preg_value, 0) > 150 THEN 12 WHEN coalesce(preg_value, 0) > 120 THEN 17
        WHEN temp > 40 THEN 7 ELSE 3 END AS state, (1 + coalesce(n_events, 0)) / (2.0 + coalesce(n_events, 0))::DOUBLE AS prob FROM observed)"""


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    lh, preg = F.coalesce("lh_value", F.lit(0.0)), F.coalesce("preg_value", F.lit(0.0))
    n = F.coalesce("n_events", F.lit(0))
    state = F.when(F.col("menses"), 1).when(lh > 100, 5).when(preg > 150, 12).when(preg > 120, 17).when(F.col("temp") > 40, 7).otherwise(3)
    return observed(spark, sf).select("seq_id", "t", state.alias("state"), ((n + 1) / (n + 2.0)).alias("prob"))


_CYCLES = f"""{_DECODED}, starts AS (SELECT *, state = 1 AND coalesce(lag(state) OVER (PARTITION BY seq_id ORDER BY t) <> 1, true) AS start FROM decoded),
    numbered AS (SELECT *, CAST(sum(CAST(start AS INT)) OVER (PARTITION BY seq_id ORDER BY t) AS BIGINT) AS cycle_number FROM starts),
    cycles AS (SELECT seq_id, cycle_number, count(*) AS cycle_length, min(t) AS cycle_start, max(t) AS cycle_end, min(prob) AS min_prob, max(prob) AS max_prob, max(prob) FILTER (state = 5) AS ovu_prob,
        count(*) FILTER (state = 5) AS n_ovu, bool_and(state BETWEEN 1 AND 7) AND count(*) FILTER (state = 5) > 0 AS ovulatory_cycle FROM numbered GROUP BY seq_id, cycle_number)"""


@add(f"WITH {_CYCLES} SELECT * FROM cycles")
def cycle_table(spark: SparkSession, sf: str) -> DataFrame:
    return C.identify_cycles(_decoded(spark, sf))


@add(f"""WITH {_CYCLES} SELECT seq_id, count(*) AS n_cycles, quantile_cont(cycle_length, 0.5) AS median_length, round(stddev_samp(cycle_length), 6) AS sd_length,
    count(*) FILTER (cycle_length < 15) AS n_short, quantile_cont(cycle_length, 0.5) FILTER (cycle_length < 15) AS median_short, round(stddev_samp(cycle_length) FILTER (cycle_length < 15), 6) AS sd_short FROM cycles GROUP BY seq_id""")
def cycle_stats_per_user(spark: SparkSession, sf: str) -> DataFrame:
    got = C.cycle_characteristics(C.identify_cycles(_decoded(spark, sf)), 15)
    return got.withColumns({c: F.round(c, 6) for c in ("sd_length", "sd_short")})


@add(f"""WITH {_CYCLES}, good AS (SELECT seq_id, cycle_number, cycle_length, CAST(min_prob >= 0.3 AS INT) AS g, abs(lead(cycle_length) OVER w - cycle_length) AS step FROM cycles WHERE cycle_number > 0 WINDOW w AS (PARTITION BY seq_id ORDER BY cycle_number)),
    rolled AS (SELECT *, CASE WHEN count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 THEN sum(g) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 END AS fine,
        CASE WHEN count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 2 THEN sum(step) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) END AS moved FROM good WINDOW w AS (PARTITION BY seq_id ORDER BY cycle_number)),
    picked AS (SELECT seq_id, cycle_number AS first_cycle, row_number() OVER (PARTITION BY seq_id ORDER BY cycle_number) AS nth FROM rolled WHERE fine AND moved >= 2),
    wanted AS (SELECT seq_id, first_cycle, first_cycle + k AS cycle_number, k + 1 AS nth_cycle FROM picked CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE nth IN (1, 2, 3))
    SELECT seq_id, first_cycle, cycle_number, CAST(nth_cycle AS INT) AS nth_cycle, cycle_length FROM wanted JOIN cycles USING (seq_id, cycle_number)""")
def qualifying_cycles(spark: SparkSession, sf: str) -> DataFrame:
    got = C.identify_cycles(_decoded(spark, sf)).withColumns({"ovulatory_cycle": F.lit(True), "ovu_prob": F.lit(1.0)})
    return C.qualifying_cycles(got, 3, most=2, keep=(1, 2, 3)).select("seq_id", "first_cycle", "cycle_number", "nth_cycle", "cycle_length")


@add(f"""WITH {_DECODED}, ev AS (SELECT * FROM decoded WHERE state IN (1, 12, 17) AND prob >= 0.7), n AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY seq_id ORDER BY t) <> t - 1, true) AS new FROM ev),
    s AS (SELECT seq_id, t, state, t - lag(t) OVER w AS duration, lag(state) OVER w AS previous FROM n WHERE new WINDOW w AS (PARTITION BY seq_id ORDER BY t))
    SELECT seq_id, t, state, duration, previous, CASE WHEN previous = 1 AND state = 1 THEN 'cycle' WHEN previous = 17 AND state = 1 THEN 'post-partum' WHEN previous = 12 AND state = 1 THEN 'post-loss'
        WHEN state = 17 THEN 'pregnancy with birth' WHEN state = 12 THEN 'pregnancy with loss' ELSE 'undefined' END AS type FROM s WHERE duration IS NOT NULL""")
def event_pair_durations(spark: SparkSession, sf: str) -> DataFrame:
    return C.event_durations(_decoded(spark, sf)).select("seq_id", "t", "state", "duration", "previous", "type")


_LEVELS = "CASE WHEN bleeding_total IS NULL THEN NULL WHEN bleeding_total >= 100 THEN 'heavy' WHEN bleeding_total >= 80 THEN 'medium' WHEN bleeding_total >= 40 THEN 'light' WHEN bleeding_total >= 20 THEN 'spotting' ELSE 'none' END"


def raw_days(spark: SparkSession, sf: str) -> DataFrame:
    """Formatted days from the panel's days that have events."""
    b = F.col("bleeding_total")
    score = F.when(b >= 100, 3.0).when(b >= 80, 2.0).when(b >= 40, 1.0).when(b >= 20, 0.5).when(b.isNotNull(), 0.0)
    sign = lambda x: F.when(F.col(x) == "pos", 1).when(F.col(x) == "neg", -1)
    kind = F.when(F.col("mucus") == "creamy", "creamy_medium").when(F.col("mucus") == "sticky", "sticky_little").when(F.col("mucus") == "fertile", "eggwhite_little").when(F.col("mucus") == "very_fertile", "eggwhite_lots").when(F.col("mucus") == "none", "none")
    return observed(spark, sf).filter("n_events is not null").select(
        F.col("seq_id").alias("user_id"), F.col("t").alias("rel_date"), score.alias("bleeding"), F.col("day1").alias("first_day"), kind.alias("mucus_type"), F.col("temp").alias("temperature"),
        (F.col("n_events") > 6).alias("questionable_temp"), sign("LH").alias("LH"), sign("preg").alias("preg_test"),
    )


_PREPARED = f"""{OBSERVED}, d AS (SELECT *, {_LEVELS} AS level, CASE WHEN n_events > 6 THEN NULL ELSE temp END AS plain FROM observed),
    c AS (SELECT seq_id, temp, count(*) AS n FROM observed WHERE temp IS NOT NULL GROUP BY ALL),
    o AS (SELECT seq_id, temp AS odd FROM (SELECT *, row_number() OVER w AS p, lead(n) OVER w AS next FROM c WINDOW w AS (PARTITION BY seq_id ORDER BY n DESC, temp)) WHERE p = 1 AND (next IS NULL OR n > 5 * next)),
    k AS (SELECT d.*, CASE WHEN plain = odd THEN NULL ELSE plain END AS kept FROM d LEFT JOIN o USING (seq_id)),
    prepared AS (SELECT seq_id, CAST(t AS INT) AS t, CASE WHEN n_events IS NULL THEN NULL WHEN day1 AND coalesce(level, 'none') IN ('none', 'spotting') THEN 'medium' ELSE coalesce(level, 'none') END AS bleeding, mucus,
        CASE WHEN kept IS NULL THEN NULL ELSE round(greatest(-1.5, least(1.5, kept - quantile_cont(kept, 0.5) OVER (PARTITION BY seq_id))), 6) END AS temp, LH, preg FROM k)"""


@add(f"WITH {_PREPARED} SELECT * FROM prepared")
def prepare_obs(spark: SparkSession, sf: str) -> DataFrame:
    return observe.prepare_obs(raw_days(spark, sf)).withColumn("temp", F.round("temp", 6))


_MISS = f"""{OBSERVED}, freq AS (SELECT seq_id, avg(CAST(bleeding_total IS NOT NULL AS DOUBLE)) AS bleeding_total, avg(CAST(mucus IS NOT NULL AS DOUBLE)) AS mucus, avg(CAST(temp IS NOT NULL AS DOUBLE)) AS temp,
        avg(CAST(LH IS NOT NULL AS DOUBLE)) AS LH, avg(CAST(preg IS NOT NULL AS DOUBLE)) AS preg FROM observed GROUP BY seq_id)"""


@add(f"""WITH {_MISS}, long AS (UNPIVOT freq ON bleeding_total, mucus, temp, LH, preg INTO NAME channel VALUE f)
    SELECT channel, round(avg(f), 9) AS mean, round(quantile_cont(f, 0.5), 9) AS median, round(min(f), 9) AS min, round(quantile_cont(f, 0.05), 9) AS p05, round(quantile_cont(f, 0.95), 9) AS p95, round(max(f), 9) AS max FROM long GROUP BY channel""")
def missingness_summary(spark: SparkSession, sf: str) -> DataFrame:
    got = tracking.missingness(observed(spark, sf), CHANNELS)
    return got.select("channel", *[F.round(c, 9).alias(c) for c in ("mean", "median", "min", "p05", "p95", "max")])


@add(f"""WITH {OBSERVED}, n AS (SELECT seq_id, CAST(bleeding_total IS NOT NULL AS INT) + CAST(mucus IS NOT NULL AS INT) + CAST(temp IS NOT NULL AS INT) + CAST(LH IS NOT NULL AS INT) + CAST(preg IS NOT NULL AS INT) AS k FROM observed)
    SELECT seq_id, round(sum(k) / (5.0 * count(*)), 9) AS filled, round(avg(CAST(k > 0 AS DOUBLE)), 9) AS any_log FROM n GROUP BY seq_id""")
def tracking_frequency(spark: SparkSession, sf: str) -> DataFrame:
    got = tracking.tracking_frequency(observed(spark, sf), CHANNELS)
    return got.select("seq_id", F.round("filled", 9).alias("filled"), F.round("any_log", 9).alias("any_log"))


@add(f"""WITH {_CYCLES} SELECT seq_id, cycle_number, cycle_length, round(avg(cycle_length) OVER w, 9) AS predicted, CASE WHEN count(*) OVER w > 1 THEN round(stddev_samp(cycle_length) OVER w, 6) END AS predicted_sd
    FROM cycles WINDOW w AS (PARTITION BY seq_id ORDER BY cycle_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def baseline_cycle_length(spark: SparkSession, sf: str) -> DataFrame:
    got = predict.baseline_length(C.identify_cycles(_decoded(spark, sf)).select("seq_id", "cycle_number", "cycle_length"))
    return got.withColumns({"predicted": F.round("predicted", 9), "predicted_sd": F.round("predicted_sd", 6)}).drop("days_before", "cycles_before")


@add(f"""WITH {OBSERVED}, p AS (SELECT seq_id, cycle, t, mucus, LH, row_number() OVER w AS day, row_number() OVER w - count(*) OVER (PARTITION BY seq_id, cycle) - 1 AS back FROM observed WINDOW w AS (PARTITION BY seq_id, cycle ORDER BY t)),
    n AS (SELECT seq_id, cycle, max(day) AS length FROM p GROUP BY ALL),
    e AS (SELECT seq_id, cycle, CAST(round_even(avg(length) OVER (PARTITION BY seq_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS expected FROM n),
    k AS (SELECT *, CASE WHEN back >= {FOLD} THEN back ELSE day END AS slot FROM p),
    a AS (SELECT p.seq_id, p.cycle, t, least(day, expected) AS d, expected FROM p JOIN e ON e.seq_id = p.seq_id AND e.cycle = p.cycle WHERE expected IS NOT NULL),
    w AS (SELECT *, CASE WHEN d - expected - 1 >= {FOLD} THEN d - expected - 1 ELSE d END AS slot FROM a)
    SELECT w.seq_id, w.cycle, w.t, arg_max(k.mucus, k.cycle) FILTER (k.mucus IS NOT NULL) AS forecast_mucus, arg_max(k.LH, k.cycle) FILTER (k.LH IS NOT NULL) AS forecast_LH
    FROM w LEFT JOIN k ON k.seq_id = w.seq_id AND k.slot = w.slot AND k.cycle < w.cycle GROUP BY ALL""")
def observation_replay_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return predict.replay_baseline(observed(spark, sf), ["mucus", "LH"], FOLD)


@add(f"""WITH {_DECODED}, a AS (SELECT DISTINCT seq_id, state, t AS true_t FROM decoded WHERE state IN (5, 12)), f AS (SELECT DISTINCT seq_id, state, t + 2 AS found_t FROM decoded WHERE state IN (5, 12) AND t % 3 <> 0),
    n AS (SELECT a.*, found_t - true_t AS d FROM a LEFT JOIN f ON f.seq_id = a.seq_id AND f.state = a.state AND abs(found_t - true_t) <= 4)
    SELECT seq_id, state, true_t, arg_min(d, abs(d) * 100 + d) AS "offset" FROM n GROUP BY ALL""")
def event_timing(spark: SparkSession, sf: str) -> DataFrame:
    df = _decoded(spark, sf).filter("state in (5, 12)")
    return E.nearest_events(df, df.filter("t % 3 <> 0").withColumn("t", F.col("t") + 2), 4)


@add(f"""WITH {OBSERVED}, x AS (SELECT seq_id, t, menses AND NOT coalesce(lag(menses) OVER (PARTITION BY seq_id ORDER BY t), false) AS up, n_events FROM observed)
    SELECT seq_id, t, coalesce(n_events, 0) / pow(2.0, CAST(sum(CAST(up AS INT)) OVER (PARTITION BY seq_id ORDER BY t) AS DOUBLE)) AS halved FROM x""")
def exponential_decay(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.rolling import halved

    w = ordered("seq_id")
    return cycled(spark, sf).select("seq_id", "t", halved(F.coalesce("n_events", F.lit(0)).cast("double"), rising(F.col("menses"), w), w).alias("halved"))


@add("""SELECT o_custkey, o_orderkey, sum(CAST(o_orderstatus = 'F' AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS closed_so_far FROM orders""")
def running_count(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.sum((F.col("o_orderstatus") == "F").cast("int")).over(w).alias("closed_so_far"))


@add(f"""WITH {_DECODED},
    m AS (SELECT d.seq_id, d.t, state, mucus, state = 1 AND NOT coalesce(lag(state) OVER w = 1, false) AS up, state = 5 AND NOT coalesce(lag(state) OVER w = 5, false) AS o FROM decoded d JOIN observed b ON b.seq_id = d.seq_id AND b.t = d.t WINDOW w AS (PARTITION BY d.seq_id ORDER BY d.t)),
    c AS (SELECT *, sum(CAST(up AS INT)) OVER w AS cycle, t - max(CASE WHEN state = 5 THEN t END) OVER w AS since, max(CASE WHEN up THEN t END) OVER w AS start FROM m WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
    p AS (SELECT *, CASE WHEN since > 0 AND t - since >= start THEN 'luteal' ELSE 'follicular' END AS phase FROM c),
    d AS (SELECT *, row_number() OVER w AS day, row_number() OVER w - count(*) OVER (PARTITION BY seq_id, cycle, phase) - 1 AS back FROM p WINDOW w AS (PARTITION BY seq_id, cycle, phase ORDER BY t)),
    n AS (SELECT seq_id, phase, CAST(round_even(avg(n), 0) AS BIGINT) AS length FROM (SELECT seq_id, cycle, phase, count(*) AS n FROM d WHERE cycle > 0 GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT d.seq_id, d.phase, mucus, CASE WHEN d.phase = 'luteal' THEN CASE WHEN day <= 5 THEN day WHEN length + back + 1 > 5 THEN length + back + 1 END ELSE CASE WHEN back >= -3 THEN length + back + 1 WHEN day <= length - 4 THEN day END END AS phase_day
        FROM d JOIN n ON n.seq_id = d.seq_id AND n.phase = d.phase WHERE cycle > 0)
    SELECT seq_id, phase, CAST(phase_day AS BIGINT) AS phase_day, count(*) AS n_days, round(avg(CAST(mucus IS NULL AS DOUBLE)), 9) AS p_missing_mucus FROM a WHERE phase_day IS NOT NULL GROUP BY ALL""")
def phase_observations(spark: SparkSession, sf: str) -> DataFrame:
    """How often what is reported on each day of the mean phases."""
    phases = predict.phase_table(_decoded(spark, sf))
    days = predict.aligned(phases).join(observed(spark, sf).select("seq_id", "t", "mucus"), ["seq_id", "t"])
    got = days.groupBy("seq_id", "phase", F.col("phase_day").cast("long").alias("phase_day"))
    return got.agg(F.count(F.lit(1)).alias("n_days"), F.round(F.avg(F.col("mucus").isNull().cast("double")), 9).alias("p_missing_mucus"))


@add(f"""WITH {_CYCLES}, b AS (SELECT cycle_length, sum(cycle_length) OVER w AS total, count(*) OVER w AS k FROM cycles WINDOW w AS (PARTITION BY seq_id ORDER BY cycle_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    terms AS (SELECT k, CAST(sum((total - cycle_length * k) ** 2) AS DOUBLE) / (k * k) AS squares, CAST(sum(abs(total - cycle_length * k)) AS DOUBLE) / k AS sizes, count(*) AS n, sum(CAST(total <> cycle_length * k AS INT)) AS wrong FROM b WHERE k > 0 GROUP BY k),
    added AS (SELECT list_reduce(list(squares ORDER BY k), lambda a, e: a + e) / sum(n) AS mse, list_reduce(list(sizes ORDER BY k), lambda a, e: a + e) / sum(n) AS mae, sum(wrong) / sum(n) AS missed FROM terms)
    SELECT round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(missed, 9) AS missed FROM added""")
def forecast_error(spark: SparkSession, sf: str) -> DataFrame:
    got = E.ratio_forecast_errors(predict.baseline_length(C.identify_cycles(_decoded(spark, sf))), "days_before", "cycles_before", "cycle_length")
    return got.select(*[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae")], F.round("missed", 9).alias("missed"))


@add(f"""WITH {CYCLED}, n AS (SELECT seq_id, count(*) AS n FROM cycled GROUP BY seq_id) SELECT seq_id, n AS n_days, n - CAST(round_even(0.3 * n, 0) AS BIGINT) AS n_left FROM n""")
def added_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Days of each sequence, and those that still have a value after three tenths are blanked."""
    from ..operators.users import add_missing

    got = add_missing(cycled(spark, sf).select("seq_id", "t", F.lit(1).alias("x")), ["x"], 0.3)
    return got.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_days"), F.count("x").alias("n_left"))


@add(f"""WITH {_DECODED}, s AS (SELECT *, state = 1 AND coalesce(lag(state) OVER (PARTITION BY seq_id ORDER BY t) <> 1, true) AS start FROM decoded), c AS (SELECT *, CAST(sum(CAST(start AS INT)) OVER (PARTITION BY seq_id ORDER BY t) AS BIGINT) AS n FROM s),
    g AS (SELECT seq_id || '-' || n AS cycle_id, CASE state WHEN 1 THEN 'M' WHEN 7 THEN 'Lut' ELSE 'lE' END AS hsmm_states, count(*) AS n_days FROM c GROUP BY ALL)
    SELECT * FROM g WHERE cycle_id NOT IN (SELECT cycle_id FROM g WHERE hsmm_states = 'Lut' AND n_days = 2)""")
def state_duration_days(spark: SparkSession, sf: str) -> DataFrame:
    w = ordered("seq_id")
    df = _decoded(spark, sf).withColumn("start", rising(F.col("state") == 1, w))
    df = df.withColumn("n", F.sum(F.col("start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    named = F.when(F.col("state") == 1, F.when(F.col("t") % 2 == 0, "hM").otherwise("lM")).when(F.col("state") == 7, F.when(F.col("t") % 2 == 0, "Ep").otherwise("Rise")).otherwise("lE")
    return observe.state_durations(df.select(F.concat_ws("-", "seq_id", "n").alias("cycle_id"), named.alias("states")))


@add(f"""WITH {OBSERVED}, d AS (SELECT *, {_LEVELS} AS level FROM observed)
    SELECT seq_id, CAST(t AS INT) AS t, CASE WHEN n_events IS NULL THEN 'none' WHEN day1 AND coalesce(level, 'none') IN ('none', 'spotting') THEN 'medium' ELSE coalesce(level, 'none') END AS bleeding,
        coalesce(mucus, 'missing') AS mucus, coalesce(LH, 'missing') AS LH, coalesce(preg, 'missing') AS preg FROM d""")
def observations_with_missing_level(spark: SparkSession, sf: str) -> DataFrame:
    return observe.prepare_obs(raw_days(spark, sf), missing_level=True).drop("temp")


@lru_cache(1)
def _model():
    return dedicated(cycle_model())


def _values(name: str, rows) -> str:
    """A relation of a model as SQL, of the sojourns no more than any sequence of the tables can have."""
    shown = lambda x: "'" + x + "'" if isinstance(x, str) else repr(float(x)) if isinstance(x, float) else str(int(x))
    rows = rows[rows["days"] <= 60] if "days" in rows else rows
    columns = ", ".join('"' + c + '"' for c in rows.columns)
    return f"m_{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(shown(x) for x in r) + ")" for r in rows.itertuples(index=False)) + ")"


def _path_sql(spread: bool) -> str:
    tables = likelihood.model_tables(_model())
    channels = [k for k in _model().emission if k != "temp"]
    said = {k: f"v_{k}.f IS NOT NULL" for k in channels} | {"temp": "temp IS NOT NULL"}
    total = "spoken" + "".join(f" + CASE WHEN {said[k]} THEN known_{k} + " + (f"v_{k}.f" if k != "temp" else f"greatest(peak_temp - 0.5 * (((temp - mean_temp) / sd_temp) * ((temp - mean_temp) / sd_temp)), {FLOOR})") + f" ELSE unknown_{k} END" for k in _model().emission)
    if spread:
        init, move, stay, share = "first_run", "NOT first_run", "NOT first_run AND NOT last_run", "length"
    else:
        init, move, stay, share = "p = 1", "place = 1 AND p > 1", "place = length AND p > 1 AND p < size", "1"
    return f"""WITH {_DECODED}, {_PREPARED.removeprefix(OBSERVED + ", ")}, {", ".join(_values(k, t) for k, t in tables.items())},
    path AS (SELECT seq_id, CAST(d.t AS INT) AS t, state, bleeding, mucus, temp, LH, preg FROM decoded d JOIN prepared x USING (seq_id, t)),
    path_edges AS (SELECT *, coalesce(lag(state) OVER w <> state, true) AS new, lag(state) OVER w AS previous, row_number() OVER w AS p, count(*) OVER (PARTITION BY seq_id) AS size FROM path WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
    path_runs AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY seq_id ORDER BY t) AS run FROM path_edges),
    placed AS (SELECT *, row_number() OVER (PARTITION BY seq_id, run ORDER BY t) AS place, count(*) OVER (PARTITION BY seq_id, run) AS length, first_value(previous) OVER (PARTITION BY seq_id, run ORDER BY t) AS came,
        run = 1 AS first_run, run = max(run) OVER (PARTITION BY seq_id) AS last_run FROM path_runs),
    terms AS (SELECT p.seq_id, p.t, p.state, coalesce(CASE WHEN {init} THEN i.init END / {share}, 0) AS init, coalesce(CASE WHEN {move} THEN s.transition END / {share}, 0) AS transition, coalesce(CASE WHEN {stay} THEN o.sojourn END / {share}, 0) AS sojourn,
            CASE WHEN {" OR ".join(said.values())} THEN greatest({total}, {FLOOR}) ELSE silent END AS emission
        FROM placed p JOIN m_initial i ON i.state = p.state LEFT JOIN m_transition s ON s.state = p.state AND s."before" = p.came LEFT JOIN m_sojourn o ON o.state = p.state AND o.days = p.length JOIN m_report r ON r.state = p.state
            {" ".join(f"LEFT JOIN m_value v_{k} ON v_{k}.channel = '{k}' AND v_{k}.state = p.state AND v_{k}.value = p.{k}" for k in channels)})
    SELECT seq_id, t, state, round(init, 6) AS init, round(transition, 6) AS transition, round(sojourn, 6) AS sojourn, round(emission, 6) AS emission, round(init + transition + sojourn + emission, 6) AS loglik FROM terms"""


def _path(spark: SparkSession, sf: str, spread: bool) -> DataFrame:
    days = _decoded(spark, sf).select("seq_id", F.col("t").cast("int").alias("t"), "state").join(prepare_obs(spark, sf), ["seq_id", "t"])
    got = likelihood.path_likelihood(days, _model(), spread)
    return got.withColumns({c: F.round(c, 6) for c in (*likelihood.TERMS, "loglik")})


@add(_path_sql(False))
def path_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the log likelihood of the decoded days, each where it happens."""
    return _path(spark, sf, False)


@add(_path_sql(True))
def path_likelihood_spread(spark: SparkSession, sf: str) -> DataFrame:
    """The same, spread over the days of each run."""
    return _path(spark, sf, True)


#: Given decodings of the stretches: the day's state and two others, where odd days of odd stretches see another one first.
_PARTS = f"""{_DECODED}, {_STRETCHES},
    spans_of AS (SELECT * FROM longer WHERE "end" > start),
    seen AS (SELECT d.seq_id, CAST(stretch_number AS DOUBLE) AS stretch_number, tracking_behavior, CAST(t AS INT) AS t, state AS first, prob, t % 2 = 1 AND stretch_number % 2 = 1 AS turned, CASE WHEN state = 3 THEN 2 ELSE 3 END AS second FROM decoded d JOIN spans_of s ON s.seq_id = d.seq_id AND t BETWEEN start AND "end"),
    parts AS (SELECT seq_id, stretch_number, tracking_behavior, t, first AS state, CASE WHEN turned THEN 1 - prob ELSE prob END AS prob, NOT turned AS on_path FROM seen
        UNION ALL SELECT seq_id, stretch_number, tracking_behavior, t, second, CASE WHEN turned THEN prob ELSE 1 - prob END, turned FROM seen),
    by_state AS (SELECT seq_id, t, state, avg(prob) AS prob, bool_or(on_path) AS on_path, count(*) AS n, avg(stretch_number) AS stretch_number, array_to_string([x FOR x, i IN list(tracking_behavior ORDER BY stretch_number) IF i = 1 OR x <> list(tracking_behavior ORDER BY stretch_number)[i - 1]], '-') AS tracking_behavior FROM parts GROUP BY ALL),
    met AS (SELECT *, max(n) OVER (PARTITION BY seq_id, t) > 1 AS seam, row_number() OVER (PARTITION BY seq_id, t ORDER BY prob DESC, state) AS place FROM by_state),
    path AS (SELECT seq_id, t, state, prob, stretch_number, tracking_behavior FROM met WHERE CASE WHEN seam THEN place = 1 ELSE on_path END)"""


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    spans = tracking_stretches(spark, sf).select("seq_id", F.col("stretch_number").cast("double").alias("stretch_number"), "tracking_behavior", "start", "end")
    rows = windows_of(_decoded(spark, sf), spans).withColumns({"turned": (F.col("t") % 2 == 1) & (F.col("stretch_number") % 2 == 1), "second": F.when(F.col("state") == 3, 2).otherwise(3)})
    mine = F.struct("state", F.when(F.col("turned"), 1 - F.col("prob")).otherwise(F.col("prob")).alias("prob"), (~F.col("turned")).alias("on_path"))
    other = F.struct(F.col("second").alias("state"), F.when(F.col("turned"), F.col("prob")).otherwise(1 - F.col("prob")).alias("prob"), F.col("turned").alias("on_path"))
    return rows.select("seq_id", "stretch_number", "tracking_behavior", F.col("t").cast("int").alias("t"), F.explode(F.array(mine, other)).alias("of")).select("seq_id", "stretch_number", "tracking_behavior", "t", "of.*")


@add(f"WITH {_PARTS} SELECT seq_id, t, state, round(prob, 9) AS prob, stretch_number, tracking_behavior FROM path")
def stitched_path(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded stretches put together: one state a day, by mean probability where stretches overlap."""
    return stitching.stitched(_parts(spark, sf)).withColumn("prob", F.round("prob", 9))


@add(f"""WITH {_PARTS},
    sides AS (SELECT seq_id, seam, stretch_number, bool_or(state = 1) AS known, min(t) AS low, max(t) AS high FROM (SELECT *, avg(stretch_number) OVER w AS seam, min(stretch_number) OVER w < max(stretch_number) OVER w AS meet FROM parts WHERE on_path WINDOW w AS (PARTITION BY seq_id, t)) WHERE meet GROUP BY ALL),
    broken AS (SELECT seq_id, seam, min(low) AS low, max(high) AS high FROM sides GROUP BY ALL HAVING NOT bool_and(known)),
    sure AS (SELECT seq_id, t FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY seq_id ORDER BY t) <> 1, true) AS new FROM path) WHERE state = 1 AND new AND prob > 0.75),
    ends AS (SELECT seq_id, min(t) AS a, max(t) AS z FROM path GROUP BY seq_id),
    wide AS (SELECT b.seq_id, seam, coalesce((SELECT max(t) FROM sure s WHERE s.seq_id = b.seq_id AND s.t < low), a) AS start, least(coalesce((SELECT min(t) FROM sure s WHERE s.seq_id = b.seq_id AND s.t > high) + 5, z), z) AS stop FROM broken b JOIN ends USING (seq_id)),
    cuts AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY seq_id ORDER BY start, stop, seam ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM wide),
    unions AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY seq_id ORDER BY start, stop, seam ROWS UNBOUNDED PRECEDING) AS u FROM cuts)
    SELECT seq_id, min(start) AS start, max(stop) AS "end", min(seam) AS stretch_number FROM unions GROUP BY seq_id, u""")
def stitch_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of days to decode again, around the seams where a stretch knows no menses."""
    parts = _parts(spark, sf)
    return stitching.repairs(stitching.stitched(parts), stitching.seams(parts))


@add(f"""WITH {OBSERVED}, n AS (SELECT seq_id, CAST(t AS INT) AS t, CASE LH WHEN 'pos' THEN 1.0 WHEN 'neg' THEN 0.0 END::DOUBLE AS LH, CASE preg WHEN 'pos' THEN 1.0 WHEN 'neg' THEN 0.0 END::DOUBLE AS preg, coalesce(bleeding_total >= 100, false) AS heavy,
        CASE mucus WHEN 'creamy' THEN 0.2 WHEN 'sticky' THEN 0.0 WHEN 'fertile' THEN 0.5 WHEN 'very_fertile' THEN 1.0 WHEN 'none' THEN 0.0 END::DOUBLE AS score, CASE WHEN n_events <= 6 THEN temp END AS sure FROM observed WHERE n_events IS NOT NULL),
    c AS (SELECT seq_id, sure, count(*) AS n FROM n WHERE sure IS NOT NULL GROUP BY ALL),
    o AS (SELECT seq_id, sure AS odd FROM (SELECT *, row_number() OVER w AS p, lead(n) OVER w AS next FROM c WINDOW w AS (PARTITION BY seq_id ORDER BY n DESC, sure)) WHERE p = 1 AND (next IS NULL OR n > 5 * next)),
    k AS (SELECT n.* REPLACE (CASE WHEN sure BETWEEN 10 AND 90 AND coalesce(sure <> odd, true) THEN sure END AS sure), CASE WHEN heavy THEN 0 ELSE score END AS mucus FROM n LEFT JOIN o USING (seq_id))
    SELECT seq_id, t, LH, preg, mucus, CASE WHEN NOT heavy THEN round(greatest(-1.5, least(1.5, sure - quantile_cont(sure, 0.5) OVER (PARTITION BY seq_id))) + CASE WHEN sure IS NULL THEN NULL ELSE 0 END, 6) END AS temp,
        CASE WHEN count(*) OVER w = 3 AND coalesce(max(mucus) OVER w >= 0.5, false) THEN 1 ELSE 0 END AS fmucus FROM k WINDOW w AS (PARTITION BY seq_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def numeric_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations as numbers, with the panel's own bounds of what is plausible."""
    return observe.numeric_observations(raw_days(spark, sf), plausible=(10.0, 90.0)).withColumn("temp", F.round("temp", 6))
