"""Two-level scans give what one window over the whole item gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators import scan, signal


def frames(spark, seed=4):
    rnd = random.Random(seed)
    rows = []
    for media, n in (("a", 1), ("b", 7), ("c", 64), ("d", 500), ("e", 1300)):
        level = 0.0
        for i in range(n):
            if rnd.random() < 0.08:
                level = rnd.choice([0.0, 0.1, 0.35, 0.5, 0.9])
            rows.append((media, i, level if rnd.random() < 0.9 else rnd.random(), rnd.choice([None, 1, 2])))
    return spark.createDataFrame(rows, "media_id string, frame_ix long, p double, mark int").repartition(4)


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("block", [1, 3, 64, 5000])
def test_running_values(spark, block):
    f = frames(spark).withColumn("n", F.when(F.col("mark") == 1, 1))
    by = Window.partitionBy("media_id").orderBy("frame_ix")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    names = ["media_id", "frame_ix", "was", "known", "count", "top"]
    wanted = f.withColumns({"was": F.lag("mark").over(by), "known": F.last("mark", ignorenulls=True).over(upto), "count": F.sum("n").over(upto), "top": F.max("p").over(upto)})
    got = scan.running(f, "frame_ix", block, before={"was": F.col("mark")}, last={"known": F.col("mark")}, total={"count": F.col("n")}, most={"top": F.col("p")})
    key = lambda df: sorted(map(repr, rows_of(df.select(*names))))
    assert key(got) == key(wanted)


@pytest.mark.parametrize("block", [5, 50])
def test_signal_in_blocks(spark, block):
    f = frames(spark).select("media_id", "frame_ix", "p")
    assert rows_of(signal.speech_regions(f, block=block)) == rows_of(signal.speech_regions(f))
    assert rows_of(signal.runs(f, F.col("p") >= 0.4, block)) == rows_of(signal.runs(f, F.col("p") >= 0.4))
    assert rows_of(signal.envelope_release(f, block=block)) == rows_of(signal.envelope_release(f))
    assert rows_of(signal.smooth(f, block=block)) == rows_of(signal.smooth(f))
    assert rows_of(signal.pause_cuts(f, 0.1, block=block)) == rows_of(signal.pause_cuts(f, 0.1))


def test_a_long_item_is_many_tasks(spark):
    """One item of a million frames: window partitions hold a block each, and what is carried makes the results exact."""
    n, block = 1_000_000, 50_000
    f = spark.range(n).select(F.lit("x").alias("media_id"), F.col("id").alias("frame_ix"), ((F.col("id") % 1000) / 1000.0).alias("p"))
    regions = signal.speech_regions(f, block=block).agg(F.count("*").alias("n"), F.max("region_ix").alias("last"), F.sum("n_frames").alias("frames"), F.max("e").alias("end")).first()
    assert (regions.n, regions.last, regions.frames) == (1000, 1000, 550_000)
    held = signal.runs(f, F.lit(True), block).collect()
    assert [(r.first, r.last, r.n) for r in held] == [(0, n - 1, n)]


def test_reach_beyond_a_block(spark):
    with pytest.raises(ValueError, match="longer than the reach"):
        signal.smooth(frames(spark), 5, block=2)


@pytest.mark.parametrize("share", [0.0, 0.15, 0.5, 0.993, 1.0])
def test_percentile_by_histograms(spark, share):
    rnd = random.Random(9)
    rows = [(m, v) for m in range(5) for v in ([rnd.gauss(0, 1) ** 9 for _ in range(400)] if m == 0 else [rnd.choice([1.0, 2.0, 2.0, 5.5]) for _ in range(m * m * m)])] + [(7, None), (8, 3.25), (9, -1e300), (9, 1e300)]
    df = spark.createDataFrame(rows, "media_id long, v double")
    wanted = {r[0]: r[1] for r in df.groupBy("media_id").agg(F.percentile("v", F.lit(share))).collect() if r[1] is not None}
    for rounds, buckets in ((2, 1024), (1, 3), (3, 2)):
        got = {r.media_id: r.q for r in scan.percentile(df, "v", share, "q", rounds=rounds, buckets=buckets).collect()}
        assert got == pytest.approx(wanted)
