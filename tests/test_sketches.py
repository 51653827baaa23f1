import random

import pytest
from pyspark.sql import functions as F

from rivulet.functions import sketches as S


def test_error_after_merges_and_a_stored_table(spark, tmp_path):
    r = random.Random(6)
    rows = [("hot" if k % 2 else f"k{k % 5}", k % 40, r.choice([r.gauss(0, 1), r.expovariate(0.01), 7.0, None]), float(k)) for k in range(60000)]
    df = spark.createDataFrame(rows, "key string, day int, x double, y double").repartition(7)
    S.sketch_table(df, ["key", "day"], ["x", "y"], 0.01).write.parquet(f"{tmp_path}/s")
    found = S.read_out(S.coarser(spark.read.parquet(f"{tmp_path}/s"), ["key"]), [0.0, 0.01, 0.3, 0.5, 0.99, 1.0])
    for c in ("x", "y"):
        errors = S.rank_errors(df, found.filter(F.col("channel") == c), ["key"], c).collect()
        assert len(errors) == 6 * df.select("key").distinct().count() and all(e.error <= 0.01 for e in errors)
    counts = {(x.key, x.channel): x.n for x in found.select("key", "channel", "n").distinct().collect()}
    exact = {(k, c): sum(1 for row in rows if row[0] == k and row[2 if c == "x" else 3] is not None) for k in {x[0] for x in rows} for c in "xy"}
    assert counts == exact


def test_missing_values_and_small_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", None), ("c", 1.0), ("c", 3.0)], "key string, x double")
    table = S.sketch_table(df, ["key"], ["x"])
    assert {x.key: x.s for x in table.select("key", S.seen("sketch").alias("s")).collect()} == {"a": 0, "b": 1, "c": 2}
    got = {(x.key, x.p): x.value for x in S.read_out(table, [0.0, 1.0]).collect()}
    assert got == {("b", 0.0): 2.0, ("b", 1.0): 2.0, ("c", 0.0): 1.0, ("c", 1.0): 3.0}
    assert S.read_out(S.coarser(table.filter("key = 'none'"), ["key"]), [0.5]).collect() == []


def test_sizes():
    assert S.size_for(0.01) > S.size_for(0.02) > S.size_for(0.5) >= 8
    for bad in (0, 1, 1e-9):
        with pytest.raises(ValueError):
            S.size_for(bad)
