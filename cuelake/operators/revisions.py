"""Optimistic revisions: what may be written, and what is in conflict, as two results; and their commit, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_revisions(current: DataFrame, incoming: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """current: id, rev. incoming: id, order, base_rev, force and more. Accepted rows with rev, the new one, and conflicts with rev, the one they met.

    Writes of one id are judged in their order: one is accepted if its base_rev is the revision by then, or if it is
    forced, and raises it by one. An id that isn't there has revision 0; a null base_rev is none. Ids are folded apart from
    each other and from what they carry: only numbers move into the fold.
    """
    at = F.struct(order, F.coalesce("base_rev", F.lit(-1)).cast("long").alias("base"), F.coalesce("force", F.lit(False)).alias("force"))
    log = incoming.groupBy("id").agg(F.array_sort(F.collect_list(at)).alias("log"))
    known = log.join(current.groupBy("id").agg(F.max("rev").cast("long").alias("rev")), "id", "left")

    def step(acc: Column, x: Column) -> Column:
        rev = acc["rev"]
        fits = x["force"] | (x["base"] == rev)
        done = F.struct(x[order].alias(order), fits.alias("accepted"), (rev + fits.cast("long")).alias("rev"))
        return F.struct((rev + fits.cast("long")).alias("rev"), F.concat(acc["out"], F.array(done)).alias("out"))

    kind = incoming.schema[order].dataType.simpleString()
    none = F.struct(F.coalesce("rev", F.lit(0)).cast("long").alias("rev"), F.array().cast(f"array<struct<{order}:{kind},accepted:boolean,rev:bigint>>").alias("out"))
    judged = known.select("id", F.explode(F.aggregate("log", none, step)["out"]).alias("x")).select("id", f"x.{order}", F.col("x.accepted").alias("__accepted"), F.col("x.rev").alias("rev"))
    rows = incoming.drop("rev").join(judged, ["id", order])
    return rows.filter("__accepted").drop("__accepted"), rows.filter("NOT __accepted").drop("__accepted")


def commit_batch(incoming: DataFrame, batch_id: int, folder: str, order: str = "seq") -> None:
    """Judge a batch against all that earlier batches had accepted, and write accepted and conflicts under folder, by batch.

    A batch that is replayed is judged against the same revisions and replaces its own two tables: nothing else changes.
    """
    spark = incoming.sparkSession
    id_kind = incoming.schema["id"].dataType.simpleString()
    accepted, conflicts = split_revisions(_before(spark, folder, batch_id, id_kind), incoming, order)
    for name, rows in (("conflicts", conflicts), ("accepted", accepted)):  # accepted last: what it lists is committed
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")


def _before(spark: SparkSession, folder: str, batch_id: int, id_kind: str) -> DataFrame:
    return _table(spark, f"{folder}/accepted", f"id {id_kind}, rev long, batch long").filter(F.col("batch") < batch_id).select("id", "rev")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def committed(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """accepted or conflicts, of all batches, with batch."""
    return _table(spark, f"{folder}/{name}", f"{schema}, batch long")


def committer(folder: str, order: str = "seq") -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch()."""
    return lambda rows, batch_id: commit_batch(rows, batch_id, folder, order)
