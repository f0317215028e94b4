"""The given tables as timed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id (user), frame_ix, p, value, ts, event_id: each user's events as a frame series."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("media_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_ix"), F.least(F.lit(1.0), F.col("value") / 150).alias("p"), "value", "ts", "event_id", "event_type")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id (conversation), ix (turn), start, end, src, role: turns spoken at 15 visible characters a second."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    length = T.visible_length(F.coalesce("text", F.lit("")))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("src"), length.alias("n"))
    done = F.sum("n").over(order)
    return rows.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ix"), ((done - F.col("n")) / 15).alias("start"), (done / 15).alias("end"), "src", "role")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id (document), words: its text, cut where a word begins. Whole texts are shuffled, before they become words."""
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.coalesce("text", F.lit("")).alias("text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "media_id")
    return texts.select("media_id", F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0)).alias("words"))


def _spoken(text: Column) -> tuple[Column, Column]:
    """How long a word is said and what silence follows: 0.05 s a character, and 1.5 s after a newline."""
    return F.length(text) * 0.05, F.when(F.contains(text, F.lit("\n")), 1.5).otherwise(0.0)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, words: an array of text, said and silent. The words of a document as one row."""

    def word(text: Column) -> Column:
        said, silent = _spoken(text)
        return F.struct(text.alias("text"), said.alias("said"), silent.alias("silent"))

    return _texts(spark, sf_dir).withColumn("words", F.transform("words", word))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, ix, text, s, e: the same words as rows, timed."""
    rows = _texts(spark, sf_dir).select("media_id", F.posexplode("words").alias("ix", "text")).withColumn("ix", F.col("ix").cast("long"))
    spoken, pause = _spoken(F.col("text"))
    before = Window.partitionBy("media_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(spoken + pause).over(before), F.lit(0.0))
    return rows.select("media_id", "ix", "text", start.alias("s"), (start + spoken).alias("e"))


FRAMES_SQL = "SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_ix, least(1.0, value / 150) AS p, value, ts, event_id, event_type FROM events"
CUES_SQL = r"""SELECT conv_id AS media_id, turn AS ix, (sum(n) OVER w - n) / 15 AS "start", (sum(n) OVER w) / 15 AS "end", src, role
FROM (SELECT *, coalesce(text, '') AS src, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n FROM conversations)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""
