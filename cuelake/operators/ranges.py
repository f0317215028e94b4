"""Interval operators: bucketed equi-joins in place of nested loops, as-of lookups by windows, interval unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_at(points: DataFrame, cues: DataFrame) -> DataFrame:
    """points: media_id, t. cues: media_id, ix, start, end, disjoint. Adds ix, the cue whose [start, end) holds t, else null.

    One union and one window per item: the last cue that starts at or before the point.
    """
    marks = cues.select("media_id", F.col("start").alias("t"), F.lit(0).alias("kind"), F.struct("ix", "end").alias("cue"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"))
    asked = points.select("media_id", "t", F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["cue"].dataType).alias("cue"), "point_id")
    by = Window.partitionBy("media_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("last", F.last("cue", ignorenulls=True).over(by)).filter("kind = 1")
    return found.select("media_id", "point_id", "t", F.when(F.col("t") < F.col("last.end"), F.col("last.ix")).alias("ix"))


def neighbours(points: DataFrame, cues: DataFrame) -> DataFrame:
    """For each point the next cue that starts after t + 0.01, and the last one that starts before t - 0.3."""
    kind = points.schema["point_id"].dataType
    starts = cues.select("media_id", F.col("start").alias("t"), F.lit(0).alias("kind"), "ix", F.lit(None).cast(kind).alias("point_id"))
    none = F.lit(None).cast(cues.schema["ix"].dataType).alias("ix")
    after = points.select("media_id", (F.col("t") + 0.01).alias("t"), F.lit(1).alias("kind"), none, "point_id")
    before = points.select("media_id", (F.col("t") - 0.3).alias("t"), F.lit(-1).alias("kind"), none, "point_id")
    order = Window.partitionBy("media_id").orderBy("t", "kind")
    rows = starts.unionByName(after).unionByName(before)
    rows = rows.withColumns({"next": F.first("ix", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), "prev": F.last("ix", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.filter("kind <> 0").groupBy("media_id", "point_id").agg(F.max(F.when(F.col("kind") == 1, F.col("next"))).alias("next_ix"), F.max(F.when(F.col("kind") == -1, F.col("prev"))).alias("prev_ix"))


#: A level of buckets is so many times as coarse as the one before; there are LEVELS of them.
COARSER, LEVELS = 64, 3


def overlaps(a: DataFrame, b: DataFrame, bucket: float = 20.0) -> DataFrame:
    """a: media_id, a_ix, s, e. b: media_id, b_ix, s, e. One row per overlapping pair (e > s and s < e), clipped to the overlap.

    An interval has the level of the first buckets that are as long as itself, so it touches two of them, and is listed
    there and at the coarser levels. A pair meets at the coarser of its two levels, in the bucket where its overlap begins:
    no pair is made twice, no join is without an equality, and a long interval is a few rows. The finest bucket is about
    the usual interval's length.
    """

    def placed(of: DataFrame, ix: str, side: str) -> DataFrame:
        length = F.col("e") - F.col("s")
        own = sum(((length > bucket * COARSER**k).cast("int") for k in range(LEVELS - 1)), F.lit(0))
        rows = of.select("media_id", ix, F.col("s").alias(f"{side}_s"), F.col("e").alias(f"{side}_e"), own.alias(f"{side}_level"))
        rows = rows.withColumn("level", F.explode(F.sequence(F.col(f"{side}_level"), F.lit(LEVELS - 1))))
        at = lambda c: F.floor(F.col(c) / (bucket * F.pow(F.lit(float(COARSER)), F.col("level")))).cast("long")
        return rows.withColumn("bucket", F.explode(F.sequence(at(f"{side}_s"), at(f"{side}_e"))))

    pairs = placed(a, "a_ix", "a").join(placed(b, "b_ix", "b"), ["media_id", "level", "bucket"]).filter("a_e > b_s AND a_s < b_e AND greatest(a_level, b_level) = level")
    first = F.floor(F.greatest("a_s", "b_s") / (bucket * F.pow(F.lit(float(COARSER)), F.col("level")))) == F.col("bucket")
    return pairs.filter(first).select("media_id", "a_ix", "b_ix", F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))


def windows_of_chunks(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Membership of windows in half-open index ranges: the last chunk that begins at or before the window."""
    each = chunks.select("media_id", "chunk_ix", F.explode(F.sequence("w_from", F.col("w_to") - 1)).alias("win_ix"))
    return windows.join(each, ["media_id", "win_ix"])


def union_intervals(intervals: DataFrame, slack: float = 0.0, key: str = "media_id") -> DataFrame:
    """key, island, s, e, n: intervals joined where the next begins by the end so far plus slack."""
    by = Window.partitionBy(key).orderBy("s", "e")
    reached = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("opens", F.coalesce(F.col("s") > reached + slack, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


def clip_or_whole(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """Speech inside each window; a window without any is its own region."""
    inside = overlaps(windows.withColumnRenamed("win_ix", "a_ix"), regions.withColumnRenamed("region_ix", "b_ix")).withColumnRenamed("a_ix", "win_ix")
    found = windows.select("media_id", "win_ix", F.col("s").alias("w_s"), F.col("e").alias("w_e")).join(inside, ["media_id", "win_ix"], "left")
    return found.select("media_id", "win_ix", F.coalesce("s", "w_s").alias("s"), F.coalesce("e", "w_e").alias("e"))
