"""Readers with fixed schemas, batched layouts, tables computed once, and stored models."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of raw day records; skipped columns are read by no name.
RAW_DAYS = (
    "id string, date string, first_day boolean, conception boolean, temperature double, temp_time string, temp_source int, questionable_temp boolean, no_fluid boolean, "
    "fluid_sticky int, fluid_creamy int, fluid_eggwhite int, fluid_watery int, cervix_height int, cervix_openness int, cervix_firmness int, opk int, preg_test int, "
    "menstruation int, spotting boolean, sex int, custom string, moods string, symptoms string"
)
ACCOUNTS = "id string, objective string, birth_day timestamp, average_cycle double, average_luteal double, average_period double"
CYCLES = "id string, start date, end date, pregnancy boolean"


def read_tsv(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None, file_column: str | None = None) -> DataFrame:
    """Tab-separated files of one schema; only ``columns`` are parsed if given; ``file_column`` gets each row's file."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).option("nullValue", "NA").csv(path)
    if file_column:
        df = df.withColumn(file_column, F.input_file_name())
    return df.select(*columns, *([file_column] if file_column else [])) if columns else df


def read_days(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw days with user_id and a date (the time of day is dropped)."""
    df = read_tsv(spark, path, RAW_DAYS)
    return df.withColumnRenamed("id", "user_id").withColumn("date", F.to_date("date", "yyyy-MM-dd HH:mm:ss"))


def batch_of_file(df: DataFrame, first: int = 5, length: int = 2, name: str = "batch") -> DataFrame:
    """The batch number that stands at a fixed place of the file's name."""
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumn(name, F.substring(file, first, length))


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """Repeated rows go; each batch is a folder that later reads can skip."""
    df.dropDuplicates().repartition(batch).write.mode("overwrite").partitionBy(batch).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds something at this path, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made and written only if its write has not been finished before."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def registry(spark: SparkSession, models: list[str], approaches: list[str], fitted: tuple = (False, True)) -> DataFrame:
    """All combinations of model, approach and fit, with the name of the file of their results."""
    m = spark.createDataFrame([(x,) for x in models], "model string")
    a = spark.createDataFrame([(x,) for x in approaches], "approach string")
    f = spark.createDataFrame([(x,) for x in fitted], "fit_model boolean")
    name = F.concat_ws("_", "model", "approach", F.when(F.col("fit_model"), "fitted").otherwise("specified"))
    return m.crossJoin(a).crossJoin(f).withColumn("file_name", F.concat(name, F.lit(".parquet")))


def save_models(spark: SparkSession, models: dict, path: str) -> None:
    """Models by name, as rows of JSON."""
    spark.createDataFrame([(k, m.to_json()) for k, m in models.items()], "name string, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, name: str):
    from ..hsmm.model import Model

    row = spark.read.parquet(path).filter(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    return Model.from_json(row["model"])


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that driver and executors share, and its lineage cut.

    The folder is that of ``spark.checkpoint.dir``; where none is set, as in tests, a local master takes a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="rivulet-"))
    return df.checkpoint()
