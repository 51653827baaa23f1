"""Tab-separated files without a known schema: inferred once over all files, stored, and then held to.

The first pass counts, for each column of each file, how many of its values each type can hold, and merges the counts over
files; the narrowest type that holds all values is the column's. The schema is stored, so that later files are read with the
same types whatever they contain. Rows that do not fit it are not lost and do not stop a job: they come as a second table
with their file, the byte at which they begin and what is wrong. Files may have their columns in another order, or lack some.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What stands for a missing value, and the types that are tried, narrowest first; what none of them holds is a string.
MISSING = ("", "NA")
TYPES = ("boolean", "bigint", "double", "date", "timestamp")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, offset (the byte at which the line begins), line; empty lines are left out.

    A file is read in blocks. Lines are placed by running sums within a block, and blocks by those of the blocks before.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"))
    raw = raw.withColumns({"__at": F.monotonically_increasing_id(), "__bytes": F.octet_length("value") + 1})
    order = Window.partitionBy("file", "__block").orderBy("__at")
    raw = raw.withColumn("__inside", F.coalesce(F.sum("__bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = raw.groupBy("file", "__block").agg(F.max(F.col("__inside") + F.col("__bytes")).alias("__all"))
    before = F.coalesce(F.sum("__all").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(blocks.select("file", "__block", before.alias("__before")), ["file", "__block"])
    line = F.regexp_replace("value", "\r$", "")
    return placed.select("file", (F.col("__before") + F.col("__inside")).cast("long").alias("offset"), line.alias("line")).filter("line <> ''")


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file's header and their own fields."""
    every = lines(spark, path)
    header = every.filter("offset = 0").select("file", F.split("line", "\t", -1).alias("header"))
    return every.filter("offset > 0").join(header, "file").withColumn("fields", F.split("line", "\t", -1))


def _value(x: Column) -> Column:
    return F.when(~F.trim(x).isin(*MISSING), F.trim(x))


def _cast(x: Column, kind: str) -> Column:
    """The value in this type, or missing if it does not hold it; whole numbers are no truth values, days no timestamps."""
    if kind == "boolean":
        return F.when(F.lower(x).isin("true", "t"), True).when(F.lower(x).isin("false", "f"), False)
    if kind == "bigint":
        return F.when(x.rlike(r"^[+-]?\d{1,18}$"), x.try_cast("bigint"))
    if kind == "double":
        return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double"))
    if kind == "date":
        return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))
    if kind == "timestamp":
        return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), x.try_cast("timestamp_ntz"))
    return x.try_cast(kind)


def inferred(spark: SparkSession, path: str | list[str]) -> StructType:
    """The schema of all files together, columns by name; a column without values is a string. Lines with a wrong number of fields do not count."""
    records = _records(spark, path)
    headers = records.select("header").distinct()
    bad = headers.filter(F.size("header") != F.size(F.array_distinct("header"))).first()
    if bad:
        raise ValueError(f"columns of one name: {bad.header}")
    whole = records.filter(F.size("fields") == F.size("header")).select(F.explode(F.arrays_zip("header", "fields")).alias("of"))
    value = _value(F.col("of.fields"))
    counts = whole.groupBy(F.col("of.header").alias("name")).agg(F.count(value).alias("n"), *[F.count(_cast(value, k)).alias(k) for k in TYPES])
    found = {r["name"]: r for r in counts.collect()}
    kind = lambda name: next((k for k in TYPES if found[name]["n"] and found[name][k] == found[name]["n"]), "string") if name in found else "string"
    names = sorted({n for r in headers.collect() for n in r.header})
    stored = lambda n: "timestamp_ntz" if kind(n) == "timestamp" else kind(n)
    return StructType.fromDDL(", ".join(f"`{n.replace('`', '``')}` {stored(n)}" for n in names))


def pinned(spark: SparkSession, path: str | list[str], store: str) -> StructType:
    """The schema in the file ``store``; if there is none, it is inferred and stored there first."""
    from .io import exists

    if not exists(spark, store):
        spark.createDataFrame([(inferred(spark, path).json(),)], "schema string").coalesce(1).write.text(store)
    return StructType.fromJson(json.loads(spark.read.text(store).first().value))


def read(spark: SparkSession, path: str | list[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows by the schema, and the rejects: file, offset, line, reason. Columns that the schema does not name are left out."""
    records = _records(spark, path)
    right = F.size("fields") == F.size("header")
    of = F.when(right, F.map_from_arrays("header", "fields"))
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    text = {n: _value(F.try_element_at(F.col("__of"), F.lit(n))) for n in kinds}
    value = {n: _cast(text[n], "timestamp" if k.startswith("timestamp") else k) if k != "string" else text[n] for n, k in kinds.items()}
    wrong = F.filter(F.array(*[F.when(text[n].isNotNull() & value[n].isNull(), F.lit(f"{n} is no {k}")) for n, k in kinds.items()]), lambda x: x.isNotNull())
    reason = F.when(F.col("__of").isNull(), F.concat(F.size("fields").cast("string"), F.lit(" fields, not "), F.size("header").cast("string"))).when(F.size(wrong) > 0, F.array_join(wrong, ", "))
    judged = records.withColumn("__of", of).withColumn("reason", reason)
    rows = judged.filter("reason is null").select(*[value[n].cast(k).alias(n) for n, k in kinds.items()])
    return rows, judged.filter("reason is not null").select("file", "offset", "line", "reason")
