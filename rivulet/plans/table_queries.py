"""Queries on the star schema: joins, set operations, reshaping, aggregates, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_position, clamp, cut, distinct_with_missing, level, lookup, midpoints, rescale, sentence, sigmoid, strict, to_step, weighted_mean
from ..operators.sequence import neighbours, top, windows_of
from ..operators.tables import all_levels, dominant, full_join_all, longer, share_within, union_all, wider
from .panel import Registry, exact, table

TABLES = Registry()
add = TABLES.add


@add("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left_join(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, o.o_custkey == c.c_custkey, "left").select("c_custkey", "o_orderkey", "o_totalprice")


@add("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1)
    SELECT k, n_customers, n_suppliers FROM a FULL JOIN b USING (k)""")
def full_outer_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, ["k"], "full")


@add("""SELECT n_name, o_orderpriority, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL""")
def inner_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    df = li.join(o, li.l_orderkey == o.o_orderkey).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return df.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(exact("l_extendedprice")).cast("double").alias("price"))


@add("SELECT r_name, model, concat_ws('_', r_name, model) AS file_name FROM region CROSS JOIN (VALUES ('hmm'), ('hsmm'), ('weak')) m(model)")
def cross_join(spark: SparkSession, sf: str) -> DataFrame:
    models = spark.createDataFrame([("hmm",), ("hsmm",), ("weak",)], "model string")
    return table(spark, sf, "region").select("r_name").crossJoin(models).withColumn("file_name", F.concat_ws("_", "r_name", "model"))


@add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, ["c_custkey"], "left_semi").select("c_custkey", "c_name")


@add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    some = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(some, ["c_custkey"], "left_anti").select("c_custkey", "c_name")


@add("""WITH spans AS (SELECT user_id AS seq_id, CAST(ts AS DATE) AS start, CAST(ts AS DATE) + 3 AS stop FROM events WHERE event_type = 'signup' AND value > 150)
    SELECT e.event_id, s.start, count(*) AS n FROM events e JOIN spans s ON s.seq_id = e.user_id AND CAST(e.ts AS DATE) BETWEEN s.start AND s.stop GROUP BY ALL""")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    spans = e.filter("event_type = 'signup' and value > 150").select("user_id", F.col("d").alias("start"), F.date_add("d", 3).alias("stop"))
    got = windows_of(e.select("event_id", "user_id", "d"), spans, "user_id", "d", "start", "stop")
    return got.groupBy("event_id", "start").agg(F.count(F.lit(1)).alias("n"))


@add("""WITH m AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS mark FROM orders WHERE o_orderstatus = 'F'),
    o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS t FROM orders)
    SELECT o_orderkey, (SELECT max(mark) FROM m WHERE m.o_custkey = o.o_custkey AND mark <= t) AS previous_mark, (SELECT min(mark) FROM m WHERE m.o_custkey = o.o_custkey AND mark > t) AS next_mark FROM o""")
def asof_prev_next(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("t"), "o_orderstatus")
    marks = o.filter("o_orderstatus = 'F'").select("o_custkey", F.col("t").alias("mark")).distinct()
    return neighbours(o.drop("o_orderstatus"), marks, "o_custkey").select("o_orderkey", "previous_mark", "next_mark")


@add("""SELECT k, a.n AS n_F, b.n AS n_O, c.n AS n_P FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (k) FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) c USING (k)""")
def nway_full_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    each = {s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")) for s in ("F", "O", "P")}
    return full_join_all(each, ["k"])


@add("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL AS acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return union_all(c, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")))


@add("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@add("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@add("""WITH f AS (SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS p FROM customer)
    SELECT c_custkey, min(type) AS type FROM (SELECT c_custkey, c_mktsegment AS type FROM f WHERE p <= 30 UNION ALL
        SELECT c_custkey, 'low' FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 30)) GROUP BY c_custkey""")
def stratified_top(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    per = top(c, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 30).select("c_custkey", F.col("c_mktsegment").alias("type"))
    low = c.orderBy("c_acctbal", "c_custkey").limit(30).select("c_custkey", F.lit("low").alias("type"))
    return union_all(per, low).groupBy("c_custkey").agg(F.min("type").alias("type"))


@add("SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS v_quantity, l_discount AS v_discount, l_tax AS v_tax FROM lineitem) UNPIVOT (value FOR name IN (v_quantity AS 'quantity', v_discount AS 'discount', v_tax AS 'tax'))")
def unpivot_long(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(f"l_{c}").alias(f"v_{c}") for c in ("quantity", "discount", "tax")])
    return longer(df, ["l_orderkey", "l_linenumber"], ["v_quantity", "v_discount", "v_tax"], prefix="v_")


@add("""SELECT l_returnflag, CAST(sum(l_quantity) FILTER (l_linestatus = 'F') AS DOUBLE) AS q_F, CAST(sum(l_quantity) FILTER (l_linestatus = 'O') AS DOUBLE) AS q_O FROM lineitem GROUP BY 1""")
def pivot_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wider(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], "l_quantity", "q_", F.sum)


@add("SELECT event_id, CASE event_type WHEN 'view' THEN 'temp' WHEN 'purchase' THEN 'bleeding' WHEN 'click' THEN 'mucus' END AS channel FROM events")
def dict_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", lookup("event_type", {"view": "temp", "purchase": "bleeding", "click": "mucus"}).alias("channel"))


@add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'big closed' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice > 200000 THEN 'big' ELSE 'other' END AS kind,
    CASE l WHEN 0 THEN NULL ELSE l END AS priority_level, ['one','two','three','four','five'][l] AS priority_name
    FROM (SELECT *, coalesce(list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], o_orderpriority), 0) AS l FROM orders)""")
def format_codes_case(spark: SparkSession, sf: str) -> DataFrame:
    big, closed = F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "F"
    place = level("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    kind = F.when(closed & big, "big closed").when(closed, "closed").when(big, "big").otherwise("other")
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), place.cast("int").alias("priority_level"), by_position(place, ["one", "two", "three", "four", "five"]).alias("priority_name"))


@add("""WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS p, lead(n) OVER w AS next FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity))
    SELECT l_suppkey, CASE WHEN next IS NULL OR n > 1.2 * next THEN l_quantity END AS odd FROM r WHERE p = 1""")
def weird_value_mode(spark: SparkSession, sf: str) -> DataFrame:
    return dominant(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", 1.2)


@add("""SELECT event_id, round(greatest(-20, least(20, value - quantile_cont(value, 0.5) OVER (PARTITION BY user_id))), 6) AS centred FROM events""")
def clamp_center_median(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    middle = F.percentile("value", 0.5).over(Window.partitionBy("user_id"))
    return table(spark, sf, "events").select("event_id", F.round(clamp(F.col("value") - middle, -20, 20), 6).alias("centred"))


@add("SELECT event_id, CASE WHEN value <= 15 THEN 'rare' WHEN value <= 30 THEN 'occasional' WHEN value <= 60 THEN 'expected' WHEN value > 60 THEN 'diligent' END AS bin FROM events")
def cut_bins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", cut("value", midpoints([10, 20, 40, 80]), ["rare", "occasional", "expected", "diligent"]).alias("bin"))


_PAIRS = "pairs AS (SELECT doc_id, quality AS truth, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS state, (n_chars % 100) / 100.0::DOUBLE AS prob FROM labels JOIN documents USING (doc_id))"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"])
    return df.select("doc_id", F.col("quality").alias("truth"), (F.col("n_chars") > 1500).cast("int").alias("state"), ((F.col("n_chars") % 100) / 100.0).alias("prob"))


@add(f"WITH {_PAIRS} SELECT avg(CAST(state = truth AS DOUBLE)) AS accuracy, count(*) AS n FROM pairs")
def accuracy_overall(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluate import accuracy

    return accuracy(_pairs(spark, sf)).select("accuracy", "n")


@add(f"WITH {_PAIRS} SELECT round(sum(CASE WHEN state = truth THEN prob ELSE 0 END) / sum(prob), 9) AS weighted_accuracy FROM pairs")
def weighted_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    hit = (F.col("state") == F.col("truth")).cast("double")
    return _pairs(spark, sf).agg(F.round(weighted_mean(hit, "prob"), 9).alias("weighted_accuracy"))


@add(f"WITH {_PAIRS} SELECT truth, avg(CAST(state = truth AS DOUBLE)) AS accuracy, count(*) AS n FROM pairs GROUP BY truth")
def accuracy_per_state(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluate import accuracy_by_state

    return accuracy_by_state(_pairs(spark, sf)).select("truth", "accuracy", "n")


@add(f"""WITH {_PAIRS}, c AS (SELECT truth, state, count(*) AS n FROM pairs GROUP BY ALL),
    g AS (SELECT t.truth, s.state FROM (VALUES (0), (1), (2)) t(truth) CROSS JOIN (VALUES (0), (1), (2)) s(state))
    SELECT truth, state, coalesce(n, 0) AS n, coalesce(n / sum(n) OVER (PARTITION BY truth), 0) AS share FROM g LEFT JOIN c USING (truth, state)""")
def confusion_share(spark: SparkSession, sf: str) -> DataFrame:
    got = share_within(_pairs(spark, sf), ["truth", "state"], ["truth"])
    got = all_levels(got.withColumns({"truth": F.col("truth").cast("int")}), {"truth": [0, 1, 2], "state": [0, 1, 2]}, "n").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return got.select(F.col("truth").cast("int").alias("truth"), F.col("state").cast("int").alias("state"), "n", "share")


@add("""SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS p05, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50,
    quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.95) AS p95 FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS l_extendedprice FROM lineitem) GROUP BY 1""")
def quantile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.percentile("l_quantity", q).alias(f"p{int(100 * q):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)])


@add("""SELECT o_custkey, count(*) AS n, CASE WHEN count(*) = count(nullif(o_orderstatus, 'P')) THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS total_if_settled,
    count(DISTINCT nullif(o_orderstatus, 'P')) + max(CAST(o_orderstatus = 'P' AS INT)) AS n_status, max(o_totalprice) FILTER (o_orderstatus = 'F') AS max_closed,
    bool_or(o_orderstatus = 'P') AS any_pending, bool_and(o_orderstatus = 'F') AS all_closed FROM orders GROUP BY 1""")
def conditional_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), strict(F.sum(exact("o_totalprice")).cast("double"), status).alias("total_if_settled"), distinct_with_missing(status).alias("n_status"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("max_closed"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_closed"),
    )


@add("""SELECT p_partkey, concat_ws('-', p_brand, p_type) AS joined, CAST(regexp_matches(p_type, '^[A-M]') AS BOOLEAN) AS early, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked,
    regexp_extract(p_name, '(\\w+)', 1) AS word, split_part(p_brand, '#', 1) AS part, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS sentence FROM part""")
def string_family(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("-", "p_brand", "p_type").alias("joined"), F.col("p_type").rlike("^[A-M]").alias("early"), F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"),
        F.regexp_extract("p_name", r"(\w+)", 1).alias("word"), F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("part"), sentence("p_name").alias("sentence"),
    )


@add("""SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, min(CAST(o_orderdate AS DATE)) AS first, max(year(o_orderdate)) AS last_year,
    date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS span, CAST(min(CAST(o_orderdate AS DATE)) + 6 AS DATE) AS seventh FROM orders GROUP BY 1""")
def date_family(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.min(d).alias("first"), F.max(F.year("o_orderdate")).cast("long").alias("last_year"),
        F.datediff(F.max(d), F.min(d)).cast("long").alias("span"), F.date_add(F.min(d), 6).alias("seventh"),
    )


@add("""SELECT event_id, round(1 / (1 + exp(-0.1 * (value - 40))), 9) AS sig, round(asinh(value), 9) AS ash, round(sqrt(value) + ln(value + 1), 9) AS sl, round_even(value / 20, 0) * 20 AS step,
    CAST(floor(value / 7) AS BIGINT) AS div7, round(CASE WHEN value = 0 THEN NULL ELSE 100 / value END, 6) AS inv, round(value / 200, 9) AS scaled FROM events""")
def math_family(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(sigmoid(v, 0.1, 40), 9).alias("sig"), F.round(F.asinh(v), 9).alias("ash"), F.round(F.sqrt(v) + F.log1p(v), 9).alias("sl"), to_step(v, 20.0).alias("step"),
        F.floor(v / 7).alias("div7"), F.round(F.try_divide(F.lit(100.0), v), 6).alias("inv"), F.round(rescale(v, F.lit(0.0), F.lit(200.0)), 9).alias("scaled"),
    )


@add("""WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w AS forecast FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT o_custkey, round(avg((forecast - o_totalprice) ** 2) / 1e6, 6) AS mse, round(sqrt(avg((forecast - o_totalprice) ** 2)), 4) AS rmse, round(avg(abs(forecast - o_totalprice)), 4) AS mae FROM m GROUP BY 1""")
def forecast_error_mse(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    from ..operators.evaluate import forecast_errors

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    df = table(spark, sf, "orders").withColumn("forecast", F.sum(exact("o_totalprice")).over(w).cast("double") / F.nullif(F.count("o_totalprice").over(w), F.lit(0)))
    got = forecast_errors(df, "forecast", "o_totalprice", ("o_custkey",))
    return got.select("o_custkey", F.round(F.col("mse") / 1e6, 6).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@add("""WITH b AS (SELECT event_type, round_even(value / 10, 0) * 10 AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, bin, n, n / max(n) OVER (PARTITION BY event_type) AS relative FROM b""")
def histogram_relative(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluate import share_of_group_max

    return share_of_group_max(table(spark, sf, "events"), ["event_type"], "value", 10.0)


@add("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
    round(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(exact("l_quantity")).cast("double").alias("sum_qty"), F.sum(exact("l_extendedprice")).cast("double").alias("sum_price"), F.round(F.sum(exact("l_discount")).cast("double") / F.count("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@add("""SELECT rank, a.s_suppkey, b.s_suppkey AS by_balance, b.s_acctbal FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS rank, s_suppkey FROM supplier) a
    FULL JOIN (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rank, s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0) b USING (rank)""")
def bind_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.tables import bind_columns

    s = table(spark, sf, "supplier")
    other = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("by_balance"), "s_acctbal")
    return bind_columns(s.select("s_suppkey"), other, ["s_suppkey"], ["s_acctbal", "by_balance"])


@add(f"WITH {_PAIRS} SELECT round(avg(accuracy), 9) AS mean_accuracy FROM (SELECT avg(CAST(state = truth AS DOUBLE)) AS accuracy FROM pairs WHERE truth IS NOT NULL GROUP BY truth)")
def mean_of_state_accuracies(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluate import mean_of_states

    return mean_of_states(_pairs(spark, sf)).select(F.round("mean_accuracy", 9).alias("mean_accuracy"))


@add(f"""WITH {_PAIRS}, p AS (SELECT pairs.*, lang, source FROM pairs JOIN documents USING (doc_id)), l AS (SELECT 'lang' AS "group", lang AS value, state = truth AS hit, prob FROM p UNION ALL SELECT 'source', source, state = truth, prob FROM p)
    SELECT "group", value, avg(CAST(hit AS DOUBLE)) AS accuracy, round(sum(CASE WHEN hit THEN prob ELSE 0 END) / nullif(sum(prob), 0), 9) AS weighted_accuracy, count(*) AS n FROM l GROUP BY ALL""")
def accuracy_by_columns(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluate import accuracy_by_groups

    known = _pairs(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return accuracy_by_groups(known, ["lang", "source"]).withColumn("weighted_accuracy", F.round("weighted_accuracy", 9))


RANK_ERROR, RANKS = 0.01, [0.05, 0.25, 0.5, 0.75, 0.95]


@add(f"""WITH q AS (SELECT CAST(unnest({RANKS}) AS DOUBLE) AS p), g AS (SELECT l_returnflag, count(l_extendedprice) AS n FROM lineitem GROUP BY 1)
    SELECT l_returnflag, p, n, true AS within FROM g CROSS JOIN q""")
def sketched_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of prices from sketches by day of shipping, merged to the flag: how many values they saw, and whether each is within the stated error in rank of the exact one."""
    from ..functions import sketches as S

    li = table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    daily = S.sketch_table(li, ["l_returnflag", "day"], ["l_extendedprice"], RANK_ERROR)
    found = S.read_out(S.coarser(daily, ["l_returnflag"]), RANKS)
    errors = S.rank_errors(li, found, ["l_returnflag"], "l_extendedprice")
    return errors.join(found, ["l_returnflag", "p"]).select("l_returnflag", "p", "n", (F.col("error") <= RANK_ERROR).alias("within"))
