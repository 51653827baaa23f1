import pytest

import __spark_entry__ as entry

from .oracle import differences

OWN = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}
PLAIN = sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline")


@pytest.mark.parametrize("name", sorted(OWN))
def test_against_oracle(spark, sf, name):
    assert differences(spark, sf, entry.queries()[name], OWN[name]) is None


@pytest.mark.parametrize("name", PLAIN)
def test_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_relational_queries_run_no_python(spark, sf):
    for name in OWN:
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "Pandas" not in plan and "ArrowEvalPython" not in plan and "MapInArrow" not in plan, name


def test_panel_needs_two_exchanges(spark, sf):
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("densified", "rising_edge_cycles", "cycle_table", "prepare_obs", "observation_replay_baseline"):
            plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"\bExchange (?:hash|range|single|Round)", plan)) == 2 and plan.count("FileScan") == 1 and "Join" not in plan, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_argmax_where_a_day_has_only_zeros(spark, tmp_path):
    rows = [(1, "a", 0.0), (1, "b", 0.0), (2, "a", 5.0), (2, "b", -5.0), (3, None, 1.0), (3, "b", 1.0), (4, "a", None), (5, "a", 0.0), (5, "b", 2.0)]
    events = spark.createDataFrame([(k, u, s, v) for k, (u, s, v) in enumerate(rows)], "event_id long, user_id long, event_type string, value double")
    events.selectExpr("event_id", "timestamp'2024-01-01 10:00:00' as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert differences(spark, str(tmp_path), entry.queries()["argmax_by_prob"], OWN["argmax_by_prob"]) is None
