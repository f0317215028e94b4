"""The translation job: bad batches, halving, copies, usage, resuming after an abort and after a killed driver."""

import glob
import json
import os
import re
import signal
import subprocess
import sys
import time

import pytest

from cuelake.operators import jobs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cues_of(spark, n, media=("m",)):
    return spark.createDataFrame([(m, i, f"line {i}.", "x") for m in media for i in range(n)], "media_id string, ix long, src string, note string")


def log_calls(folder):
    """A function that translates, and notes what it was asked."""

    def fn(batch):
        with open(f"{folder}/{os.getpid()}-{time.time_ns()}", "w") as f:
            json.dump([b["src"] for b in batch], f)
        return {b["id"]: "T:" + b["src"] for b in batch}

    return fn


def calls(folder):
    return [json.load(open(p)) for p in sorted(glob.glob(f"{folder}/*"))]


def test_one_bad_batch_is_a_failed_batch(spark, tmp_path):
    def fn(batch):
        if any(b["src"] == "line 5." for b in batch):
            raise ValueError("refused")
        return {"t": {f"[{b['id']}]": "T:" + b["src"] for b in batch}, "usage": {"prompt": 100, "completion": 10, "cache_hit": None}}

    job = jobs.translate(cues_of(spark, 100), fn, f"{tmp_path}/ledger", size=20)
    got = {r.ix: r for r in job.cues.collect()}
    failed = {r.ix: r for r in job.failed.collect()}
    assert got[50].tgt == "T:line 50." and got[5].tgt == "" and got[50].note == "x" and got[50].attempts == 1
    assert 5 in failed and len(failed) == 10 and all(i < 20 for i in failed) and failed[5].error == "ValueError: refused" and failed[5].attempts == 3
    usage = job.usage.first()
    assert usage.requests == 5 + 1 + 2 and usage.prompt == 500 and usage.cache_hit == 0  # of the bad batch's four calls, one half succeeds
    assert sum(w["requests"] for w in job.waves) == usage.requests and sum(w["cues"] for w in job.waves) == 100 + 20 + 20


def test_truncated_batches_are_halved(spark, tmp_path):
    def fn(batch):
        if len(batch) > 10:
            raise jobs.Truncated("cut")
        return {b["id"]: "T:" + b["src"] for b in batch}

    job = jobs.translate(cues_of(spark, 40), fn, f"{tmp_path}/ledger", size=40)
    assert job.failed.count() == 0 and {r.attempts for r in job.cues.collect()} == {3}
    assert [w["attempt"] for w in job.waves if w["attempt"] == 1] == [1] and sum(w["requests"] for w in job.waves) == 1 + 2 + 4


def test_copies_fixes_and_noise(spark, tmp_path):
    rows = [("m", 0, "Konnichiwa minasan"), ("m", 1, "OK"), ("m", 2, "Konnichiwa minasan again"), ("m", 3, "..."), ("m", 4, None), ("n", 0, "I sea you there")]
    said = {"Konnichiwa minasan": "Konnichiwa minasan", "OK": ' "okay" ', "Konnichiwa minasan again": "guten Tag", "I sea you there": "ich sehe dich"}

    def fn(batch):
        fix = {b["id"]: "I see you there" for b in batch if b["src"].startswith("I sea")}
        return {"t": {b["id"]: said.get(b["src"], 7) for b in batch} | {"99": "none", "x": "none"}, "fix": fix}

    job = jobs.translate(spark.createDataFrame(rows, "media_id string, ix long, src string"), fn, f"{tmp_path}/ledger", proofread=True)
    got = {(r.media_id, r.ix): r for r in job.cues.collect()}
    assert [got["m", i].tgt for i in range(5)] == ["Konnichiwa minasan", "okay", "guten Tag", "", ""]
    assert got["m", 0].attempts == 3 and got["m", 1].attempts == 1 and job.failed.count() == 0
    assert (got["n", 0].src, got["n", 0].src_orig) == ("I see you there", "I sea you there")


def test_nothing_to_do(spark, tmp_path):
    job = jobs.translate(cues_of(spark, 5).limit(0), lambda b: {}, f"{tmp_path}/ledger")
    assert job.cues.count() == job.failed.count() == job.usage.count() == 0 and job.waves == []


def test_fatal_ends_the_job_and_the_ledger_goes_on(spark, tmp_path):
    for name in ("a", "b", "ledger"):
        os.makedirs(f"{tmp_path}/{name}", exist_ok=True)
    cues = cues_of(spark, 60, ("m", "n", "o"))
    first, again = log_calls(f"{tmp_path}/a"), log_calls(f"{tmp_path}/b")

    def no_money(batch):
        if len(glob.glob(f"{tmp_path}/ledger/attempt1-*/_SUCCESS")) >= 2:
            raise jobs.Fatal("no money")
        return first(batch)

    with pytest.raises(Exception, match="no money"):
        jobs.translate(cues, no_money, f"{tmp_path}/ledger", size=10)
    paid = calls(f"{tmp_path}/a")
    job = jobs.translate(cues, again, f"{tmp_path}/ledger", size=10)
    assert 0 < len(paid) < 18 and len(paid) + len(calls(f"{tmp_path}/b")) == 18
    assert job.failed.count() == 0 and job.usage.agg({"requests": "sum"}).first()[0] == 18


SCRIPT = """
import sys, tempfile
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
from pyspark.sql import SparkSession
from test_jobs import cues_of, log_calls
from cuelake.operators import jobs
import time
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
note = log_calls({calls!r})
def slow(batch):
    time.sleep(0.5)
    return note(batch)
jobs.translate(cues_of(spark, 60, ("m", "n", "o")), slow, {ledger!r}, size=10, waves=6)
"""


def test_killed_driver(spark, tmp_path):
    """The driver is killed once a wave is committed; a new run asks only for what is not in the ledger."""
    for name in ("a", "b"):
        os.makedirs(f"{tmp_path}/{name}")
    script = SCRIPT.format(root=ROOT, calls=f"{tmp_path}/a", ledger=f"{tmp_path}/ledger")
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT}/tests:{os.environ.get('PYTHONPATH', '')}"}
    with open(f"{tmp_path}/log", "w") as log:
        run = subprocess.Popen([sys.executable, "-c", script], env=env, start_new_session=True, stdout=log, stderr=log)
        try:
            end = time.time() + 240
            while len(glob.glob(f"{tmp_path}/ledger/attempt1-*/_SUCCESS")) < 2 and run.poll() is None and time.time() < end:
                time.sleep(0.1)
        finally:
            os.killpg(run.pid, signal.SIGKILL)  # the group that this test started
            run.wait()
    kept = len(glob.glob(f"{tmp_path}/ledger/attempt1-*/_SUCCESS"))
    assert kept >= 2, open(f"{tmp_path}/log").read()[-500:]
    job = jobs.translate(cues_of(spark, 60, ("m", "n", "o")), log_calls(f"{tmp_path}/b"), f"{tmp_path}/ledger", size=10, waves=6)
    assert job.failed.count() == 0 and {r.tgt for r in job.cues.collect()} == {f"T:line {i}." for i in range(60)}
    asked_again = [tuple(c) for c in calls(f"{tmp_path}/b")]
    assert 0 < len(asked_again) < 18 and re.search("line", asked_again[0][0])
    assert job.usage.agg({"requests": "sum"}).first()[0] == 18
