"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are parted by space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Whether Spark removes a query's shuffle files when it ends, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: str | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    global _own_dir
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cuelake/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of executors.

    What is written stays, since later plans read it; once their results are stored, `cuelake` in that folder may go.
    Shuffle files of the write go as soon as it ends, since nothing but the table is read of it again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; of null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def keep_rows(docs: DataFrame, leads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that leads (id, text_hash) names, columns unchanged; an id may be null. Of rows that share id and text, one."""
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    wanted = leads.select(F.col("id").alias("__id"), F.col("text_hash").alias("__wanted"))
    order = Window.partitionBy(id_col, "__hash").orderBy(F.xxhash64(*docs.columns))
    kept = docs.withColumn("__hash", text_hash).join(wanted, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__wanted")), "left_semi")
    return kept.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").select(*docs.columns)
