"""Shared plumbing of the corpus operators: scratch tables and Arrow batches.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which all
executors and the driver share, so a job whose executors are lost reads them
again instead of recomputing or failing. An operator drops those that nothing
reads any more as it goes on; ``cleanup`` drops the rest of a session's when the
caller has written what it wants from the results, which are lazy and read them.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rivulet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _root(spark: SparkSession) -> str:
    """The scratch folder of this application."""
    return f"{shared_dir(spark)}/rivulet/{spark.sparkContext.applicationId}"


#: With this setting Spark deletes a query's shuffle files when it ends; else when the driver's memory is next cleared.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    return measured(df, name)[0]


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates of the rows that are taken in the same pass."""
    spark, schema = df.sparkSession, df.schema
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation(f"rivulet-{uuid.uuid4().hex}") if measures else None
    if seen:
        df = df.observe(seen, *[c.alias(k) for k, c in measures.items()])
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(schema).parquet(path)
    table.scratch_path = path
    return table, seen.get if seen else {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        if table is not None:
            _delete(table.sparkSession, table.scratch_path)


def cleanup(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once nothing lazy that reads them is needed."""
    _delete(spark, _root(spark))


#: A key with more than this part of all rows is heavy; there are fewer such keys than that.
HEAVY = 1024


def heavy_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``table``, a written table with each of their keys once and the number of its rows as ``count``.

    Rows of heavy keys meet their entry by a broadcast, of fewer than ``HEAVY`` entries whatever the input; all others
    by a shuffle, where no key has more than that part of the rows. The columns of ``keys`` must not be null.
    """
    total = table.agg(F.sum(count).alias("n")).first()["n"] or 0
    heavy = F.col(count) * HEAVY > total
    often = F.broadcast(table.filter(heavy))
    seldom = rows.join(often.select(*keys), keys, "left_anti").join(table.filter(~heavy), keys)
    return rows.join(often, keys).unionByName(seldom)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so that no further column can clash with the operator's own."""
    return df.select(*[df[f"`{n}`"] for n in names])


def steps(batches, column: str = "text", limit: int = STEP_BYTES):
    """Cut Arrow batches into slices of about ``limit`` bytes of ``column``, nulls made empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.string()), "")
        batch = batch.set_column(at, pa.field(column, pa.string()), text)
        ends = offsets(text)[1:]
        lo = 0
        while lo < len(batch):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def offsets(text: pa.StringArray) -> np.ndarray:
    """Byte offsets of the texts, from 0."""
    if not len(text):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    return raw.astype(np.int64) - raw[0]


def text_bytes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (and the last ends)."""
    offs = offsets(text)
    if not offs[-1]:
        return np.zeros(0, np.uint8), offs
    first = int(np.frombuffer(text.buffers()[1], np.int32)[text.offset])
    return np.frombuffer(text.buffers()[2], np.uint8)[first : first + int(offs[-1])], offs
