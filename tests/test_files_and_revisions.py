"""Files that appear all or none, and revisions that are committed once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import revisions
from cuelake.sources import files


def names_in(folder):
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_subtitle_files(spark, tmp_path):
    cues = spark.createDataFrame([(m, i, float(i), i + 0.5, f"line {i}", "") for m in range(4) for i in range(3)] + [(9, 0, 0.0, 1.0, " ", "")], "media_id long, ix long, start double, end double, src string, tgt string")
    names = spark.createDataFrame([(0, "a/b"), (1, "a:b"), (2, None), (3, "ü"), (9, "empty")], "media_id long, name string")
    files.write_subtitles(cues, names, f"{tmp_path}/out", "srt", content="src")
    assert names_in(tmp_path / "out") == ["a_b (2).srt", "a_b.srt", "untitled.srt", "ü.srt"]
    assert (tmp_path / "out" / "ü.srt").read_text().startswith("1\n00:00:00,000 --> 00:00:00,500\nline 0\n")
    with pytest.raises(Exception, match="taken"):
        files.write_subtitles(cues.filter("media_id = 3"), names, f"{tmp_path}/out", "srt", content="src")
    files.write_subtitles(cues.filter("media_id = 3").withColumn("src", F.lit("new")), names, f"file://{tmp_path}/out", "srt", "overwrite", content="src")
    assert "new" in (tmp_path / "out" / "ü.srt").read_text() and len(names_in(tmp_path / "out")) == 4


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(files.DocumentFiles)
    rows = spark.range(8).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name"), F.when(F.col("id") < 7, "text").alias("document"))
    with pytest.raises(Exception, match="no file can be made"):
        rows.write.format("document_files").mode("append").save(f"{tmp_path}/out")
    assert names_in(tmp_path / "out") == []
    with pytest.raises(Exception, match="one name"):
        rows.select(F.lit("same").alias("file_name"), F.lit("x").alias("document")).write.format("document_files").mode("append").save(f"{tmp_path}/out")
    assert names_in(tmp_path / "out") == []
    with pytest.raises(Exception, match="no file can be made"):
        rows.select(F.lit("../x").alias("file_name"), F.lit("x").alias("document")).write.format("document_files").mode("append").save(f"{tmp_path}/out")
    assert names_in(tmp_path) == ["out"] and names_in(tmp_path / "out") == []


SCHEMA = "id string, seq long, base_rev long, force boolean, body string"


def some_writes(rnd, n):
    return [(rnd.choice("abc"), k, rnd.choice([None, 0, 1, 2, 3, 4, 5, 6]), rnd.choice([None, False, False, True]), f"body {k}") for k in range(n)]


def test_revisions_in_order(spark):
    rnd = random.Random(5)
    writes, now = some_writes(rnd, 60), {"a": 2}
    accepted, conflicts = revisions.split_revisions(spark.createDataFrame([("a", 1), ("a", 2)], "id string, rev long"), spark.createDataFrame(writes, SCHEMA))
    got = {r.seq: (r.rev, True) for r in accepted.collect()} | {r.seq: (r.rev, False) for r in conflicts.collect()}
    for key, seq, base, force, _ in writes:
        fits = bool(force) or base == now.get(key, 0)
        now[key] = now.get(key, 0) + fits
        assert got[seq] == (now[key], fits), seq
    assert accepted.columns == ["id", "seq", "base_rev", "force", "body", "rev"] and 0 < conflicts.count() < 60


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rnd = random.Random(6)
    batches = [spark.createDataFrame(some_writes(rnd, 20), SCHEMA) for _ in range(3)]
    commit = revisions.committer(str(tmp_path))
    table = lambda name: sorted(map(tuple, revisions.committed(spark, str(tmp_path), name, f"{SCHEMA}, rev long").collect()), key=repr)
    for k, rows in enumerate(batches):
        commit(rows, k)
    before = table("accepted"), table("conflicts")
    for k in (2, 0, 1, 2):
        commit(batches[k], k)
    assert (table("accepted"), table("conflicts")) == before and before[0] and before[1]
    assert len({(r[0], r[5]) for r in before[0]}) == len(before[0])  # no revision is given twice


def test_commit_of_a_stream(spark, tmp_path):
    for k, rows in enumerate(([("a", 0, 0, False, "x")], [("a", 1, 0, False, "y"), ("a", 2, 1, False, "z")])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in").writeStream.foreachBatch(revisions.committer(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = {r.seq: r.rev for r in revisions.committed(spark, f"{tmp_path}/out", "accepted", f"{SCHEMA}, rev long").collect()}
    assert got == {0: 1, 2: 2}
