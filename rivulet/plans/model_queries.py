"""Queries that run the semi-Markov library over the panel."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hsmm.cycle_model import bleeding_model, cycle_model, dedicated
from ..hsmm.model import Categorical
from ..operators import decode, features, predict, rules, scan
from .domain_queries import _PREPARED, prepare_obs, raw_days
from .panel import CYCLED, OBSERVED, Registry, cycled

MODELS = Registry()
add = MODELS.add


@lru_cache(1)
def model():
    return dedicated(cycle_model())


OVULATORY = ["M", "lE", "hE", "preO", "O", "postO", "Lut"]
#: Integer costs of the two-state path: staying, changing, and a menses day in the other state.
STAY, CHANGE, WRONG = 1, 4, 3


@add(f"""WITH RECURSIVE {CYCLED},
    x AS (SELECT seq_id, t, CAST(menses AS INT) AS m FROM cycled),
    v AS (
        SELECT seq_id, t, m, m * {WRONG} AS c0, (1 - m) * {WRONG} AS c1 FROM x WHERE t = 1
        UNION ALL
        SELECT x.seq_id, x.t, x.m, least(v.c0 + {STAY}, v.c1 + {CHANGE}) + x.m * {WRONG}, least(v.c1 + {STAY}, v.c0 + {CHANGE}) + (1 - x.m) * {WRONG}
        FROM v JOIN x ON x.seq_id = v.seq_id AND x.t = v.t + 1)
    SELECT seq_id, t, CAST(c0 AS BIGINT) AS cost0, CAST(c1 AS BIGINT) AS cost1 FROM v""")
def hmm_viterbi_int(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of the best path to each day and state, as running products of the days' matrices."""
    days = cycled(spark, sf).select("seq_id", "t", F.col("menses").cast("int").alias("m"))
    got = scan.path_costs(days, [[STAY, CHANGE], [CHANGE, STAY]], [F.col("m") * WRONG, (1 - F.col("m")) * WRONG], F.col("t") == 1)
    return got.select("seq_id", "t", "cost0", "cost1")


@add()
def hsmm_decode(spark: SparkSession, sf: str) -> DataFrame:
    return decode.decode_panel(prepare_obs(spark, sf), model(), bleeding_model(model()), adaptive=False)


@add()
def hierarchical_decode(spark: SparkSession, sf: str) -> DataFrame:
    return decode.decode_panel(prepare_obs(spark, sf), model(), bleeding_model(model()))


@add()
def hsmm_posteriors(spark: SparkSession, sf: str) -> DataFrame:
    return decode.posterior_panel(prepare_obs(spark, sf), model())


@add()
def hsmm_simulate(spark: SparkSession, sf: str) -> DataFrame:
    return decode.simulate_panel(spark, model(), 20, 30)


@add()
def hsmm_fit_loglik(spark: SparkSession, sf: str) -> DataFrame:
    part = model().subset(OVULATORY)
    return decode.fit_panel(prepare_obs(spark, sf), part, models=False, lock_transition=True, weight_emission=100)


@add()
def joint_fit(spark: SparkSession, sf: str) -> DataFrame:
    """What one model learns from all sequences: for each variable and state, how often it is missing and its values or mean and deviation."""
    got = decode.fit_jointly(prepare_obs(spark, sf), model().subset(OVULATORY), lock_transition=True, weight_emission=100, relative=1e-5)
    rows = []
    for j, state in enumerate(got.model.names):
        rows.append((state, None, "p", float(got.model.p[j])))
        for k, f in got.model.emission.items():
            learned = {"q": got.model.q[k][j]} | (dict(zip(f.values, f.probs[:, j])) if isinstance(f, Categorical) else {"mean": f.mean[j], "sd": f.sd[j]})
            rows += [(state, k, name, float(x)) for name, x in learned.items()]
    return spark.createDataFrame(rows, "state string, variable string, parameter string, value double").withColumn("value", F.round("value", 6))


_PUTS = (  # label, first day, last day, when: later ones lie over earlier ones
    ("postO", "b + 14", "b + 16", "kind IS NOT NULL"), ("O", "b + 13", "b + 13", "kind IS NOT NULL"), ("PL", "b + 17", "e - 1", "kind = 'loss'"), ("L", "e", "e + 4", "kind = 'loss'"),
    ("PB1", "greatest(b + 1, b + 17)", "least(b + 84, till)", "kind <> 'loss'"), ("PB2", "greatest(b + 85, b + 17)", "least(b + 168, till)", "kind <> 'loss'"), ("PB3", "greatest(b + 169, b + 17)", "till", "kind <> 'loss'"),
    ("B", "birth", "birth + 3", "birth IS NOT NULL"), ("BF", "birth + 4", "e - 1", "kind = 'undefined' AND length > 322"), ("PP", "birth + 4", "e - 1", "kind = 'undefined' AND length <= 322"),
    ("BF", "b + 4", "e - 1", "kind IS NULL AND born AND (s IS NULL OR s - b > 56)"), ("PP", "b + 4", "e - 1", "kind IS NULL AND born AND s - b <= 56"),
    ("lE", "pe + 1", "s - 20", "kind IS NULL AND NOT born"), ("hE", "greatest(pe + 1, s - 19)", "s - 16", "kind IS NULL AND NOT born"),
    ("preO", "s - 15", "s - 15", "kind IS NULL AND NOT born AND s - 14 > pe + 1"), ("O", "s - 14", "s - 14", "kind IS NULL AND NOT born AND s - 14 > pe + 1"),
    ("postO", "s - 13", "s - 12", "kind IS NULL AND NOT born AND s - 14 > pe + 1"), ("Lut", "s - 11", "s - 1", "kind IS NULL AND NOT born AND s - 14 > pe + 1"),
    ("Ano", "pe + 1", "s - 1", "kind IS NULL AND NOT born AND s - 14 <= pe + 1"), ("M", "b", "pe", "true"),
)

_RULES = f"""WITH RECURSIVE {OBSERVED},
    rec AS (SELECT seq_id, CAST(t AS INT) AS t, CASE WHEN bleeding_total >= 100 THEN 3 WHEN bleeding_total >= 80 THEN 2 WHEN bleeding_total >= 20 THEN 1 ELSE 0 END AS m, day1 AS first,
        CASE preg WHEN 'pos' THEN 1 WHEN 'neg' THEN -1 ELSE 0 END AS test FROM observed WHERE n_events IS NOT NULL),
    days AS (SELECT *, coalesce(sum(m) OVER (w RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS week, sum(m) OVER (w RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS two, row_number() OVER w AS i, max(t) OVER (PARTITION BY seq_id) AS last_day FROM rec WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
    known AS (
        SELECT DISTINCT seq_id, CAST(0 AS BIGINT) AS i, CAST([] AS INT[]) AS starts, CAST([] AS BOOL[]) AS marks, -29 AS last, CAST(29 AS DOUBLE) AS usual, CAST(NULL AS INT) AS positive, 0 AS event, '' AS kind FROM rec
        UNION ALL
        SELECT seq_id, i, starts, marks, last, CASE WHEN len(places) > 4 AND len(gaps) > 0 THEN list_aggregate(gaps, 'median') ELSE usual END, positive, event, kind FROM (
        SELECT *, [four[j + 1] - four[j] FOR j IN range(1, 4) IF four[j] IS NOT NULL AND four[j + 1] IS NOT NULL] AS gaps FROM (
        SELECT *, [starts[x] FOR x IN list_slice(places, -4, NULL)] AS four FROM (
        SELECT *, [x FOR x IN range(1, len(marks) + 1) IF NOT marks[x]] AS places FROM (
        SELECT * REPLACE (CASE WHEN ends THEN list_append(starts, event) ELSE starts END AS starts, CASE WHEN ends THEN list_append(marks, true) ELSE marks END AS marks, CASE WHEN ends THEN event ELSE last END AS last,
            CASE WHEN NOT ends THEN positive END AS positive, CASE WHEN ends OR second AND test = 1 THEN '' ELSE kind END AS kind) FROM (
        SELECT *, second AND kind = 'period' AND (first OR test = -1) AS ends FROM (
        SELECT * REPLACE (CASE WHEN over AND apart THEN list_concat(starts, [event, t]) WHEN over THEN list_append(starts, t) ELSE starts END AS starts, CASE WHEN over AND apart THEN list_concat(marks, [true, false]) WHEN over THEN list_append(marks, true) ELSE marks END AS marks,
            CASE WHEN over THEN t ELSE last END AS last, CASE WHEN NOT over THEN positive END AS positive) FROM (
        SELECT *, second AND period AS over, t - event BETWEEN least(21, round_even(1.75 * usual, 0)) AND greatest(21, round_even(1.75 * usual, 0)) AS apart FROM (
        SELECT * REPLACE (CASE WHEN late THEN list_append(starts, t) ELSE starts END AS starts, CASE WHEN late THEN list_append(marks, true) ELSE marks END AS marks, CASE WHEN sign <> '' THEN t ELSE event END AS event,
            CASE WHEN late THEN '' WHEN sign <> '' THEN sign ELSE kind END AS kind, CASE WHEN late THEN t ELSE last END AS last, CASE WHEN NOT late THEN positive END AS positive) FROM (
        SELECT *, sign <> '' AND coalesce(t - positive >= 2 * usual OR length >= 3 * usual, false) AS late FROM (
        SELECT *, CASE WHEN positive IS NULL OR kind <> '' THEN '' WHEN first THEN 'first day' WHEN test = -1 THEN 'negative test' WHEN period THEN 'period' ELSE '' END AS sign, positive IS NOT NULL AND kind <> '' AND event <> t AS second FROM (
        SELECT * REPLACE (CASE WHEN starts_cycle THEN list_append(starts, t) WHEN back THEN list_slice(starts, 1, len(starts) - 1) ELSE starts END AS starts, CASE WHEN starts_cycle THEN list_append(marks, false) ELSE marks END AS marks,
            CASE WHEN starts_cycle THEN t WHEN back THEN coalesce(starts[len(starts) - 1], -29) ELSE last END AS last, CASE WHEN conceived THEN t ELSE positive END AS positive) FROM (
        SELECT *, positive IS NULL AND test = 1 AS conceived, positive IS NULL AND test = 1 AND length < least(23, usual - 6) AND len(starts) > 0 AS back, positive IS NULL AND test <> 1 AND (period OR declared) AS starts_cycle FROM (
        SELECT k.* REPLACE (d.i AS i), t, first, test, t - last AS length, m > 0 AND two > 1 AND week <= 1 AND t - last >= least(0.6 * usual, 12) AS period, first AND t - last >= 21 AND week <= 2 AS declared
        FROM known k JOIN days d ON d.seq_id = k.seq_id AND d.i = k.i + 1)))))))))))))),
    begun AS (SELECT DISTINCT seq_id, unnest(starts) AS t, true AS start FROM (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY i DESC) = 1)),
    fresh AS (SELECT *, CASE WHEN m > 0.5 THEN t END AS h, CAST(m > 0.5 AND coalesce(t - max(CASE WHEN m > 0.5 THEN t END) OVER (PARTITION BY seq_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2, true) AS INT) AS new,
        max(CAST(m > 0 AS INT)) OVER (PARTITION BY seq_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS some FROM days),
    bled AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY t) AS run FROM fresh),
    stops AS (SELECT seq_id, run, max(h) AS stop FROM bled GROUP BY ALL),
    after AS (SELECT b.*, min(h) OVER (PARTITION BY b.seq_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h1 FROM bled b),
    ended AS (SELECT a.seq_id, a.t, a.test, a.last_day, CASE WHEN a.some = 0 THEN a.t + 4 WHEN a.h1 - a.t <= 2 THEN s.stop ELSE a.t END AS pe FROM after a LEFT JOIN bled n ON n.seq_id = a.seq_id AND n.t = a.h1 LEFT JOIN stops s ON s.seq_id = n.seq_id AND s.run = n.run),
    counted AS (SELECT e.*, count(start) OVER (PARTITION BY seq_id ORDER BY t) AS number FROM ended e LEFT JOIN begun USING (seq_id, t)),
    spans AS (SELECT seq_id, number, min(t) AS b, arg_min(pe, t) AS pe, max(last_day) AS last_day, min(t) FILTER (test > 0) AS positive FROM counted WHERE number > 0 GROUP BY ALL),
    followed AS (SELECT *, lead(b) OVER (PARTITION BY seq_id ORDER BY number) AS s, coalesce(s, last_day + 1) AS e, coalesce(s, last_day + 1) - b AS length FROM spans),
    kinds AS (SELECT *, CASE WHEN positive IS NULL THEN NULL WHEN s IS NULL AND length < 210 THEN 'ongoing' WHEN length BETWEEN 210 AND 273 THEN 'birth' WHEN length < 210 THEN 'loss' ELSE 'undefined' END AS kind FROM followed),
    born AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY seq_id ORDER BY number) = 'birth', false) AS born, CASE kind WHEN 'undefined' THEN b + 252 WHEN 'birth' THEN e END AS birth, coalesce(CASE kind WHEN 'undefined' THEN b + 252 WHEN 'birth' THEN e END, e) - 1 AS till FROM kinds),
    puts AS ({" UNION ALL ".join(f"SELECT seq_id, number, {k} AS place, '{name}' AS label, {low} AS low, {high} AS high FROM born WHERE {when}" for k, (name, low, high, when) in enumerate(_PUTS))}),
    named AS (SELECT r.seq_id, r.t, arg_max(label, number * 100 + place) AS label FROM rec r JOIN puts p ON p.seq_id = r.seq_id AND r.t BETWEEN low AND high GROUP BY ALL)
    SELECT seq_id, t, coalesce(label, '') AS label FROM rec LEFT JOIN named USING (seq_id, t)"""


@add(_RULES)
def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    days = raw_days(spark, sf).select(F.col("user_id").alias("seq_id"), F.col("rel_date").cast("int").alias("t"), F.ceil("bleeding").cast("int").alias("menstruation"), "first_day", "preg_test")
    return rules.rule_based_labels(days)


#: Cycles to learn from before the one that is forecast: the operator's own number is 4, but ``events`` covers 30 days.
TRAINING = 2


def _stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of complete cycles in a row, by the panel's own cycle numbers."""
    numbered = prepare_obs(spark, sf).join(cycled(spark, sf).select("seq_id", F.col("t").cast("int").alias("t"), "cycle"), ["seq_id", "t"])
    return predict.training_stretches(numbered, TRAINING)


@add()
def predict_cycle_length(spark: SparkSession, sf: str) -> DataFrame:
    return predict.predict_lengths(_stretches(spark, sf), model().subset(OVULATORY), TRAINING)


@add()
def predict_next_day(spark: SparkSession, sf: str) -> DataFrame:
    return predict.predict_observations(_stretches(spark, sf), model().subset(OVULATORY), TRAINING)


_BY, _FRAME = "PARTITION BY seq_id ORDER BY t", "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW"

_FEATURES = f"""WITH {_PREPARED},
    scored AS (SELECT *, coalesce(CASE bleeding WHEN 'none' THEN 0.0 WHEN 'spotting' THEN 0.25 WHEN 'light' THEN 0.5 WHEN 'medium' THEN 0.75 WHEN 'heavy' THEN 1.0 END, 0)::DOUBLE AS bleeding_score FROM prepared),
    rolled AS (SELECT *, CASE WHEN count(*) OVER week = 7 THEN avg(temp) OVER week END AS m7, CASE WHEN count(*) OVER week = 7 THEN stddev_samp(temp) OVER week END AS s7,
        CASE WHEN count(*) OVER week = 7 THEN avg(CAST(bleeding_score > 0 AS DOUBLE)) OVER week ELSE 0 END AS f_bleeding_last_week,
        CASE WHEN count(*) OVER five = 5 THEN avg(bleeding_score) OVER five ELSE 0 END AS bleeding_density_5d,
        bleeding_score >= CASE WHEN quantile_cont(CASE WHEN bleeding_score > 0 THEN bleeding_score END, 0.8) OVER (PARTITION BY seq_id) > 0.5 THEN 0.5 ELSE 0.25 END AS bled,
        quantile_cont(temp, 0.2) OVER (PARTITION BY seq_id) AS low20, quantile_cont(temp, 0.8) OVER (PARTITION BY seq_id) AS high80, count(*) OVER days22 AS n22, list(temp) OVER days22 AS temps22,
        t - last_value(CASE WHEN temp IS NOT NULL THEN t END IGNORE NULLS) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since, coalesce(bleeding, mucus, LH, preg, CAST(temp AS VARCHAR)) IS NOT NULL AS tracking
        FROM scored WINDOW week AS ({_BY} {_FRAME}), five AS ({_BY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), days22 AS ({_BY} ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)),
    lagged AS (SELECT *, m7 - lag(m7, 13) OVER w AS d13, asinh((m7 - coalesce(lag(m7, 6) OVER w, -0.25)) / greatest(coalesce(lag(s7, 6) OVER w, 0.2), 0.1)) AS change, NOT bled AND coalesce(lead(bled) OVER w, false) AS opens,
        max(CASE WHEN temp IS NOT NULL THEN since END) OVER ({_BY} ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS widest FROM rolled WINDOW w AS ({_BY})),
    opened AS (SELECT *, CAST(sum(CAST(opens AS INT)) OVER ({_BY}) AS BIGINT) AS interbleeding_id,
        CAST(coalesce(n22 = 22 AND coalesce(widest, 99) <= 3 AND list_unique(temps22) >= 4 AND list_aggregate(list_filter(temps22, lambda x: x IS NOT NULL), 'quantile_cont', 0.25) >= low20 + 0.7 * (high80 - low20)
            AND abs(list_aggregate(list_filter(temps22, lambda x: x IS NOT NULL), 'quantile_cont', 0.85) - list_aggregate(list_filter(temps22, lambda x: x IS NOT NULL), 'quantile_cont', 0.15)) <= 0.5 * (high80 - low20), false) AS INT) AS long_high_temp FROM lagged),
    placed AS (SELECT *, row_number() OVER g AS place, count(*) OVER (PARTITION BY seq_id, interbleeding_id) - row_number() OVER g AS back FROM opened WINDOW g AS (PARTITION BY seq_id, interbleeding_id ORDER BY t)),
    judged AS (SELECT *, bleeding_score <= 0.25 AND place > 5 AS used FROM placed),
    summed AS (SELECT seq_id, interbleeding_id, count(*) AS n, avg(1 / (1 + exp(-10.0 * (-temp)))) FILTER (used AND back < 10) AS low, coalesce(avg(CAST(bleeding_score > 0 AS DOUBLE)) FILTER (used), 0) AS light, coalesce(sum(CAST(temp > 0.3 AS INT)) FILTER (used), 0) AS high_days, count(*) FILTER (used) AS n_used FROM judged GROUP BY ALL),
    usual AS (SELECT *, abs(n - quantile_cont(CASE WHEN n BETWEEN 15 AND 100 THEN n END, 0.5) OVER (PARTITION BY seq_id)) / quantile_cont(CASE WHEN n BETWEEN 15 AND 100 THEN n END, 0.5) OVER (PARTITION BY seq_id) AS away FROM summed),
    back AS (SELECT *, CAST(coalesce(away <= 0.5 AND away + coalesce(lead(away) OVER (PARTITION BY seq_id ORDER BY interbleeding_id), 0) <= 0.5, false) AS INT) AS m_return,
        greatest(0, least(1, greatest(low, light) * CAST(n_used >= 3 AS INT) * CAST(high_days <= 10 AS INT))) AS susp_ano FROM usual),
    joined AS (SELECT j.*, susp_ano, m_return, CAST(coalesce(preg = 'pos', false) OR long_high_temp = 1 AS INT) AS hit FROM judged j JOIN back b ON b.seq_id = j.seq_id AND b.interbleeding_id = j.interbleeding_id),
    fired AS (SELECT *, hit = 1 AND sum(hit) OVER ({_BY} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = 1 AS fire FROM joined),
    numbered_hints AS (SELECT *, sum(CAST(fire AS INT)) OVER ({_BY}) AS hint FROM fired),
    dayed AS (SELECT *, CASE WHEN hint > 0 THEN row_number() OVER h - 1 END AS day, bleeding_density_5d >= 0.5 AND NOT coalesce(lag(bleeding_density_5d >= 0.5) OVER h, false) AS risen FROM numbered_hints WINDOW h AS (PARTITION BY seq_id, hint ORDER BY t)),
    doubted AS (SELECT *, max(CAST(coalesce((m_return = 1 OR LH = 'pos' AND day > 273) AND day > 0, false) AS INT)) OVER h AS ended, sum(CAST(coalesce(preg = 'neg', false) OR coalesce(risen AND day > 0, false) AS INT)) OVER h AS doubts FROM dayed WINDOW h AS (PARTITION BY seq_id, hint ORDER BY t ROWS UNBOUNDED PRECEDING))
    SELECT seq_id, t, bleeding_score, CASE WHEN d13 IS NULL THEN 'missing' WHEN d13 >= 0.5 THEN 'increase' WHEN d13 <= -0.5 THEN 'decrease' ELSE 'no_change' END AS dtemp, round(coalesce(change, 0), 6) AS dtemp_continuous, round(f_bleeding_last_week, 6) AS f_bleeding_last_week,
        round(bleeding_density_5d, 6) AS bleeding_density_5d, interbleeding_id, round(coalesce(susp_ano, 0), 6) AS susp_ano, long_high_temp, m_return,
        CASE WHEN day IS NULL OR day >= 560 OR ended = 1 OR bleeding_score >= 0.5 AND day <= 14 THEN 0.0 WHEN day = 0 THEN 1.2 ELSE round(1 / pow(2.0, doubts), 6) END AS preg_hint, tracking FROM doubted"""


@add(_FEATURES)
def day_features(spark: SparkSession, sf: str) -> DataFrame:
    names = [n for n in features.FEATURES if n != "gap_70d"]
    got = features.augment(prepare_obs(spark, sf), names)
    rounded = lambda n: F.round(f"`{n}`", 6) if dict(got.dtypes)[n] == "double" else F.col(f"`{n}`")
    return got.select("seq_id", "t", *[rounded(n).alias(n.replace(".", "_")) for n in names])
