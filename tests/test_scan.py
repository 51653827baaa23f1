"""Blocked scans give what windows over whole sequences give, and deal a long sequence over many tasks."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.operators import scan

SCHEMA = "seq_id string, t long, x long, y string"


def table(spark, seed=1):
    r, rows = random.Random(seed), []
    for s, n in (("hot", 400), ("a", 60), ("b", 1), ("c", 90)):
        t = r.randint(-30, 30)
        for _ in range(n):
            t += r.choice([1, 1, 1, 1, 2, 40])
            rows.append((s, t, r.choice([None, 0, 1, 5]), r.choice([None, None, "p", "q"])))
    rows += [(None, 3, 1, "p"), ("a", None, 1, "p")]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("size", [1, 3, 16, 100000])
def test_scans(spark, size):
    df = table(spark)
    got = scan.scanned(df, {"total": "x", "negative": -F.col("x")}, {"last": "y"}, {"past": "y", "past_x": "x"}, {"run": "y", "flag": F.col("x") > 0}, size=size)
    w = Window.partitionBy("seq_id").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.filter("seq_id is not null and t is not null").withColumns({"total": F.sum("x").over(upto), "negative": F.sum(-F.col("x")).over(upto), "last": F.last("y", True).over(upto), "past": F.lag("y").over(w), "past_x": F.lag("x").over(w)})
    for name, c in (("run", F.col("y")), ("flag", F.col("x") > 0)):
        want = want.withColumn("__c", F.struct(c.alias("v"))).withColumn("__new", (F.lag("__c").over(w).isNull() | ~F.col("__c").eqNullSafe(F.lag("__c").over(w))).cast("long")).withColumn(name, F.sum("__new").over(upto)).drop("__c", "__new")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


@pytest.mark.parametrize("size", [6, 64, 4096])
def test_compositions_keep_their_order(spark, size):
    """Strings put together: an operation that is associative but not commutative."""
    df = table(spark).withColumn("s", F.concat_ws(":", "t", "x"))
    got = scan.composed(df, [F.col("s")], lambda a, b: [F.concat(a[0], F.lit("|"), b[0])], size=size, names=["path"])
    want = {}
    for r in sorted(df.filter("seq_id is not null and t is not null").collect(), key=lambda r: r.t):
        want[r.seq_id, r.t] = r.s
    seen = {}
    for (s, t), v in want.items():
        seen[s] = f"{seen[s]}|{v}" if s in seen else v
        want[s, t] = seen[s]
    rows = got.collect()
    assert len(rows) == len(want) and all(r.path == want[r.seq_id, r.t] for r in rows)
    assert scan.composed(df.limit(0), [F.col("s")], None, names=["path"]).collect() == []


def test_one_long_sequence_over_many_tasks(spark):
    """10**6 days of one sequence beside as many rows of others: same costs, no task with more than its share."""
    n, size = 10**6, 256
    days = spark.range(1, n + 1).select(F.lit("hot").alias("seq_id"), F.col("id").alias("t"), (F.hash("id") % 3 == 0).cast("int").alias("m"))
    other = spark.range(1, 1001).select(F.concat(F.lit("s"), F.col("id") % 100).alias("seq_id"), F.floor((F.col("id") + 99) / 100).alias("t"), F.lit(1).alias("m"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = scan.path_costs(days.unionByName(other), [[1, 4], [4, 1]], [F.col("m") * 3, (1 - F.col("m")) * 3], F.col("t") == 1, size=size)
        spread = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(spread) == n + 1000 and max(spread) < 0.1 * n
        specs = re.findall(r"windowspecdefinition\(([^)]*?) ASC", got._jdf.queryExecution().executedPlan().toString())
        assert specs and all("block" in x or "__at" in x for x in specs)
        m = [r.m for r in days.orderBy("t").select("m").toLocalIterator()]
        c0, c1, want = 0, 0, {}
        for k, x in enumerate(m):
            a, b = (c0, c1) if not k else (min(c0 + 1, c1 + 4), min(c1 + 1, c0 + 4))
            c0, c1 = a + 3 * x, b + 3 * (1 - x)
            if k % 9973 == 0 or k == n - 1:
                want[k + 1] = (c0, c1)
        found = {r.t: (r.cost0, r.cost1) for r in got.filter(F.col("seq_id") == "hot").filter(F.col("t").isin(list(want))).collect()}
        assert found == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
