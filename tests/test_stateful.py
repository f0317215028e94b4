"""transformWithState operators against their batch twins: order, late rows, timeouts; and the stream-stream guard."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuelake.operators import signal
from cuelake.streaming import stateful


@pytest.fixture(autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stateful.prepare(spark)
    yield
    spark.conf.set(key, before)


def at(seconds):
    return datetime(2024, 5, 6, 7) + timedelta(seconds=seconds)


@pytest.fixture
def no_idle_batches(spark):
    """State with a time to live asks for a batch without data whenever there is none, so a run to the end would have none."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def run(spark, tmp_path, batches, schema, query, mode="append"):
    """Rows of a query over tables that grow batch by batch: batches hold a list of rows for each table."""
    out = []
    for k, tables in enumerate(batches):
        sources = []
        for name, kind in schema.items():
            if tables.get(name) or k == 0:
                spark.createDataFrame(tables.get(name, []), kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            sources.append(spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}"))
        live = query(*sources).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert live.awaitTermination(120)
    return out


FRAMES = "media_id long, frame_ix long, p double, ts timestamp"


def test_regions_in_any_order_within_the_delay(spark, tmp_path):
    rng = random.Random(1)
    rows = [(m, i, rng.choice([0.1, 0.1, 0.4, 0.9]) if i < 80 else 0.0) for m in range(3) for i in range(100)]
    timed = [(m, i, p, at(i * 0.032)) for m, i, p in rows]
    rng.shuffle(timed)  # all of it lies within ten seconds
    clock = [{"f": [(9, 0, 0.0, at(60))]}, {"f": [(9, 1, 0.0, at(200))]}]
    got = run(spark, tmp_path, [{"f": timed[:90]}, {"f": timed[90:]}, *clock], {"f": FRAMES}, stateful.regions)
    want = signal.speech_regions(spark.createDataFrame(rows, "media_id long, frame_ix long, p double")).collect()
    short = lambda r: (r.media_id, round(r.s, 6), round(r.e, 6), r.n_frames)
    assert sorted(map(short, got)) == sorted(map(short, want)) and len(want) > 3


def test_late_frames_go_and_silent_keys_end(spark, tmp_path):
    speech = [(1, i, 0.9, at(i * 0.032)) for i in range(20)]  # never followed by silence
    late = [(1, i, 0.9, at(i * 0.032)) for i in range(20, 40)]
    batches = [{"f": speech}, {"f": [(9, 0, 0.0, at(100))]}, {"f": late}, {"f": [(9, 1, 0.0, at(300))]}, {"f": [(9, 2, 0.0, at(500))]}]
    got = run(spark, tmp_path, batches, {"f": FRAMES}, lambda f: stateful.regions(f, idle_ms=120_000))
    assert [(r.media_id, round(r.s, 3), round(r.e, 3), r.n_frames) for r in got] == [(1, 0.0, round(20 * 0.032 + 0.06, 3), 20)]


def test_token_loops(spark, tmp_path, no_idle_batches):
    rows = [(1, i, "ab"[i % 2]) for i in range(60)] + [(2, i, str(i)) for i in range(60)] + [(3, 1, None)]
    got = run(spark, tmp_path, [{"t": [r for r in rows if r[1] < 20]}, {"t": [r for r in rows if r[1] >= 20]}, {"t": [(1, 99, "a")]}], {"t": "media_id long, token_ix long, token string"}, stateful.token_loops)
    assert [tuple(r) for r in got] == [(1, 31)]


def test_state_expires(spark, tmp_path, no_idle_batches):
    steps = [{"t": [(1, i, "a") for i in range(10)]}, {"t": [(1, i, "a") for i in range(10, 20)]}]
    got = run(spark, tmp_path, steps, {"t": "media_id long, token_ix long, token string"}, lambda t: stateful.token_loops(t, ttl_ms=1))
    assert got == []  # sixteen in a row, but the first ten were forgotten


def test_progress(spark, tmp_path, no_idle_batches):
    steps = [{"e": [("j", 0.2), ("k", 0.9)]}, {"e": [("j", 0.1), ("j", None)]}, {"e": [("j", 0.5), ("j", 0.3)]}]
    got = run(spark, tmp_path, steps, {"e": "job_id string, progress double"}, stateful.progress, "update")
    assert sorted(map(tuple, got)) == [("j", 0.2), ("j", 0.5), ("k", 0.9)]


REPLIES, EDITS = "media_id long, ix long, sent_at timestamp, ts timestamp, sent_src string, text string", "media_id long, ix long, ts timestamp, src string"


@pytest.mark.parametrize("edits_first", [True, False])
def test_replies_to_edited_texts_are_skipped(spark, tmp_path, edits_first):
    replies = [(1, 0, at(0), at(100), "one", "eins"), (1, 1, at(0), at(100), "two", "zwei"), (1, 2, at(0), at(100), "three", "drei"), (1, 3, at(0), at(100), "four", "vier"), (1, 4, at(-200_000), at(100), "five", "old")]
    edits = [(1, 0, at(50), "one!"), (1, 1, at(-5), "two"), (1, 2, at(101), "three!"), (1, 3, at(60), "four"), (None, None, at(60), "x")]
    clock = [{"r": [(9, 9, at(k), at(k), "", "")], "e": [(8, 8, at(k), "")]} for k in (20_000, 40_000, 200_000, 400_000)]
    first = [{"e": edits}, {"r": replies}] if edits_first else [{"r": replies}, {"e": edits}]
    got = run(spark, tmp_path, [*first, *clock], {"r": REPLIES, "e": EDITS}, stateful.guarded_replies)
    assert sorted((r.ix, r.text, r.skipped) for r in got if r.media_id == 1) == [(0, "eins", True), (1, "zwei", False), (2, "drei", False), (3, "vier", False), (4, "old", True)]
    batch = stateful.guarded_replies(spark.createDataFrame(replies, REPLIES), spark.createDataFrame(edits, EDITS))
    assert sorted((r.ix, r.skipped) for r in batch.filter(F.col("media_id") == 1).collect()) == sorted((r.ix, r.skipped) for r in got if r.media_id == 1)
