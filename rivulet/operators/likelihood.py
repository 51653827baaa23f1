"""The log likelihood of labelled days under a semi-Markov model, as joins of a panel with the model's tables.

A model is five small relations of logarithms: where a sequence may begin, which state follows which, how long a state
lasts, what is reported at all in a state, and how probable each value is in it. Their size is that of the model (states x
longest sojourn at most), never that of the panel, so each is broadcast. A panel needs one sort by sequence and day for its
runs of one state; all else is joined to days or to the edges of runs. There is no recursion, and no sequence is collected.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..hsmm.model import FLOOR, Categorical, Model, log
from .sequence import ordered

TERMS = ("init", "transition", "sojourn", "emission")


def model_tables(model: Model) -> dict[str, pd.DataFrame]:
    """The relations of a model: initial, transition, sojourn, report (one row by state), value (one by channel, state and value).

    States are numbered from 1. What cannot be has ``FLOOR`` for its logarithm. A day without any report in state j has
    ``silent``; any other has ``spoken`` and, for each channel, ``known`` and the logarithm of the value's probability or
    ``unknown``. A channel of numbers has a normal density: ``peak`` less half the squared distance from ``mean`` in ``sd``.
    """
    J = range(1, model.J + 1)
    table = lambda rows, names: pd.DataFrame(rows, columns=names)
    init, step, stay = log(model.init), log(model.transition), log(model.sojourn)
    silent = model.p + (1 - model.p) * math.prod((model.q[k] for k in model.emission), start=1.0)
    report = {"state": list(J), "silent": log(silent + 0 * model.p).tolist(), "spoken": log(1 - model.p).tolist()}
    values = []
    for k, f in model.emission.items():
        report |= {f"known_{k}": log(1 - model.q[k]).tolist(), f"unknown_{k}": log(model.q[k]).tolist()}
        if isinstance(f, Categorical):
            logs = log(f.probs)
            values += [(k, j, v, float(logs[n, j - 1])) for j in J for n, v in enumerate(f.values)]
        else:
            report |= {f"mean_{k}": f.mean.tolist(), f"sd_{k}": f.sd.tolist(), f"peak_{k}": [-math.log(s * math.sqrt(2 * math.pi)) for s in f.sd]}
    return {
        "initial": table([(j, float(init[j - 1])) for j in J], ["state", "init"]),
        "transition": table([(i, j, float(step[i - 1, j - 1])) for i in J for j in J], ["before", "state", "transition"]),
        "sojourn": table([(j, n + 1, float(x)) for j in J for n, x in enumerate(stay[:, j - 1])], ["state", "days", "sojourn"]),
        "report": pd.DataFrame(report),
        "value": table(values, ["channel", "state", "value", "f"]),
    }


def _broadcast(spark: SparkSession, rows: pd.DataFrame, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema)) if len(rows) else spark.createDataFrame([], schema)


def path_likelihood(path: DataFrame, model: Model, spread: bool = False, key: str = "seq_id") -> DataFrame:
    """``path`` (key, t, state, channels) with the terms of its log likelihood by day, and their sum ``loglik``.

    The first state counts on a sequence's first day, a transition on the first day of the new state, a sojourn on the
    state's last day; a sojourn that falls on a sequence's first or last day is cut off by it and counts nothing. With
    ``spread`` each is dealt evenly over the days of its run, and the first and last runs' sojourns count nothing. A
    sojourn longer than the model's longest has FLOOR. Unknown categories count as not reported. A day without a known
    state, and the sum on it, has no emission; it is a run of its own to which no term is joined. Rows of one day follow
    each other in no fixed order, so days should be distinct.
    """
    spark, tables = path.sparkSession, model_tables(model)
    by = ordered(key)
    upto, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    before, later = F.lag(F.struct("state")).over(by), F.lead(F.struct("state")).over(by)
    df = path.select(key, "t", "state", *[k for k in model.emission if k in path.columns])
    df = df.withColumns({"__n": F.row_number().over(by), "__new": before.isNull() | ~before.eqNullSafe(F.struct("state")), "__end": later.isNull() | ~later.eqNullSafe(F.struct("state")), "__before": before["state"], "__first": before.isNull(), "__last": later.isNull()})
    df = df.withColumn("__begin", F.last(F.when(F.col("__new"), F.struct("__n", "__first", "__before")), True).over(upto))
    df = df.withColumn("__stop", F.first(F.when(F.col("__end"), F.struct("__n", "__last")), True).over(after))
    length = F.col("__stop")["__n"] - F.col("__begin")["__n"] + 1
    open_, cut = F.col("__begin")["__first"], F.col("__stop")["__last"]
    if spread:
        inits, moves, stays, share = open_, ~open_, ~open_ & ~cut, length
    else:
        inits, moves, stays, share = F.col("__first"), F.col("__new") & ~F.col("__first"), F.col("__end") & ~F.col("__first") & ~F.col("__last"), F.lit(1)
    known = F.col("state").isNotNull()
    df = df.select(
        key, "t", "state", *[k for k in model.emission if k in path.columns], share.alias("__share"),
        F.when(inits & known, F.col("state")).alias("__init"), F.when(moves & known, F.col("__begin")["__before"]).alias("__from"), F.when(stays & known, length).alias("__days"),
    )
    of = lambda name, schema, on: _broadcast(spark, tables[name], schema).withColumnsRenamed(on)
    df = df.join(of("initial", "state int, init double", {"state": "__init"}), "__init", "left")
    df = df.join(of("transition", "before int, state int, transition double", {"before": "__from"}), ["__from", "state"], "left")
    df = df.join(of("sojourn", "state int, days int, sojourn double", {"days": "__days"}), ["state", "__days"], "left")
    df = df.withColumn("sojourn", F.when(F.col("__days") > len(model.sojourn), FLOOR).otherwise(F.col("sojourn")))
    for term in TERMS[:3]:
        df = df.withColumn(term, F.coalesce(F.col(term) / F.col("__share"), F.lit(0.0)))

    numbers = "".join(f", {c} double" for c in tables["report"].columns[1:])
    df = df.join(of("report", f"state int{numbers}", {}), "state", "left")
    value = tables["value"]
    spoken, total = F.lit(False), F.col("spoken")
    for k, f in model.emission.items():
        if k not in path.columns:
            total = total + F.col(f"unknown_{k}")
        elif isinstance(f, Categorical):
            mine = _broadcast(spark, value[value["channel"] == k].drop(columns="channel"), "state int, value string, f double")
            df = df.join(mine.withColumnsRenamed({"value": k, "f": f"__f_{k}"}), ["state", k], "left")
            said = F.coalesce(F.col(k).isin(f.values), F.lit(False))
            spoken, total = spoken | said, total + F.when(said, F.col(f"known_{k}") + F.col(f"__f_{k}")).otherwise(F.col(f"unknown_{k}"))
        else:
            far = (F.col(k) - F.col(f"mean_{k}")) / F.col(f"sd_{k}")
            density = F.greatest(F.col(f"peak_{k}") - F.lit(0.5) * (far * far), F.lit(FLOOR))
            spoken, total = spoken | F.col(k).isNotNull(), total + F.when(F.col(k).isNotNull(), F.col(f"known_{k}") + density).otherwise(F.col(f"unknown_{k}"))
    df = df.withColumn("emission", F.when(F.col("silent").isNotNull(), F.when(spoken, F.greatest(total, F.lit(FLOOR))).otherwise(F.col("silent"))))
    return df.select(key, "t", "state", *TERMS, (F.col("init") + F.col("transition") + F.col("sojourn") + F.col("emission")).alias("loglik"))
