"""Streaming operators whose state is kept in the state store: value, list and map state, timers and expiry.

They need the RocksDB state store: prepare(spark) names it for the session. Frames and replies may come in any order
within the watermark's delay: what can't be decided yet waits in state, and a timer on the watermark decides it. State
with a time to live (token_loops, progress) runs in processing time: Spark then runs batches without data for ever, so a
query that should end with its input needs spark.sql.streaming.noDataMicroBatches.enabled set to false.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.signal import FRAME
from .streams import LOOP_PERIOD, LOOP_REPEATS, loops

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """The session's streaming queries keep their state in RocksDB from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Regions(StatefulProcessor):
    """Two-threshold regions of one key. pending: frames by number until the watermark passes them; open: the region that may still grow."""

    def __init__(self, on: float, off: float, min_silence: float, min_speech: float, pad: float, idle_ms: int):
        self.on, self.off, self.min_silence, self.min_speech, self.pad, self.idle_ms = on, off, min_silence, min_speech, pad, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "frame_ix long", "p double, ms long")
        self.open = handle.getValueState("open", "seen long, held boolean, first long, stop long, n long")
        self.latest = handle.getValueState("latest", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        latest = self.latest.get()[0] if self.latest.exists() else -1
        seen = self.open.get()[0] if self.open.exists() else -1
        for r in rows:
            ms = int(r.ts.timestamp() * 1000)
            latest = max(latest, ms)
            if r.frame_ix > seen and r.p is not None:
                self.pending.updateValue((r.frame_ix,), (float(r.p), ms))
        self.latest.update((latest,))
        self.handle.registerTimer(latest + 1)
        self.handle.registerTimer(latest + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        seen, held, first, stop, n = self.open.get() if self.open.exists() else (-1, False, -1, -1, 0)
        done = []
        ready = sorted((k[0], v[0]) for k, v in self.pending.iterator() if v[1] < now)

        def give() -> None:
            if first >= 0 and (stop - first) * FRAME >= self.min_speech:
                done.append(Row(media_id=key[0], s=max(0.0, first * FRAME - self.pad), e=stop * FRAME + self.pad, n_frames=n))

        for ix, p in ready:
            self.pending.removeKey((ix,))
            seen, held = ix, p >= self.on or held and p >= self.off
            if held:
                if first < 0 or (ix - stop) * FRAME >= self.min_silence:
                    give()
                    first, n = ix, 0
                stop, n = ix + 1, n + 1
        silent = first >= 0 and not held and (seen + 1 - stop) * FRAME >= self.min_silence
        over = self.latest.exists() and now >= self.latest.get()[0] + self.idle_ms
        if silent or over:
            give()
            first, stop, n = -1, -1, 0
        if over:
            self.open.clear()
            self.pending.clear()
            self.latest.clear()
        else:
            self.open.update((seen, bool(held), first, stop, n))
        return iter(done)

    def close(self) -> None:
        pass


def regions(frames: DataFrame, on: float = 0.45, off: float = 0.3, min_silence: float = 0.2, min_speech: float = 0.08, pad: float = 0.06, delay: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """frames: media_id, frame_ix, p, ts. media_id, s, e, n_frames: regions as signal.speech_regions() makes them.

    Frames may come out of order by up to `delay` of ts; later ones, repeated ones and those without p are dropped. ts must
    grow with frame_ix. A region is given out once a silence of min_silence has followed it; a key that has been silent for
    idle_ms of event time gives out its open region and its state. The end of a recording clips nothing.
    """
    media = frames.schema["media_id"].dataType.simpleString()
    rows = frames.select("media_id", "frame_ix", F.col("p").cast("double").alias("p"), "ts").filter("ts is not null and frame_ix is not null").withWatermark("ts", delay)
    return rows.groupBy("media_id").transformWithState(_Regions(on, off, min_silence, min_speech, pad, idle_ms), f"media_id {media}, s double, e double, n_frames long", "append", "EventTime")


class _Loop(StatefulProcessor):
    """tail: the last tokens of a key; stopped: whether its loop was told. Both expire when the key is silent for the time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "token string", self.ttl_ms)
        self.stopped = handle.getValueState("stopped", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.stopped.exists():
            return iter(())
        tail = [t[0] for t in self.tail.get()]
        for ix, token in sorted((r.token_ix, r.token) for r in rows if r.token is not None):
            tail = [*tail, token][-LOOP_PERIOD * LOOP_REPEATS :]
            if loops(tail):
                self.stopped.update((ix,))
                self.tail.clear()
                return iter((Row(media_id=key[0], token_ix=ix),))
        if tail:
            self.tail.put([(t,) for t in tail])
        return iter(())

    def close(self) -> None:
        pass


def token_loops(tokens: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """tokens: media_id, token_ix, token. media_id, token_ix of the first token at which a loop stands, once a key.

    State: the last 128 tokens of a key as a list, for ttl_ms after its latest tokens. Tokens are ordered within a micro-batch.
    """
    media = tokens.schema["media_id"].dataType.simpleString()
    rows = tokens.select("media_id", F.col("token_ix").cast("long").alias("token_ix"), F.col("token").cast("string").alias("token"))
    return rows.groupBy("media_id").transformWithState(_Loop(ttl_ms), f"media_id {media}, token_ix long", "append", "ProcessingTime")


class _Progress(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.most = handle.getValueState("most", "progress double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        before = self.most.get()[0] if self.most.exists() else None
        now = max((r.progress for r in rows if r.progress is not None), default=None)
        if now is None or (before is not None and now <= before):
            return iter(())
        self.most.update((now,))
        return iter((Row(job_id=key[0], progress=now),))

    def close(self) -> None:
        pass


def progress(events: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """events: job_id, progress. job_id, progress whenever a job's greatest value grows, for update mode; it never goes back. A job's state expires ttl_ms after it grew."""
    job = events.schema["job_id"].dataType.simpleString()
    rows = events.select("job_id", F.col("progress").cast("double").alias("progress"))
    return rows.groupBy("job_id").transformWithState(_Progress(ttl_ms), f"job_id {job}, progress double", "update", "ProcessingTime")


def guarded_replies(replies: DataFrame, edits: DataFrame, delay: str = "1 hour", longest: str = "1 day") -> DataFrame:
    """replies: media_id, ix, sent_at, ts, sent_src, text. edits, a stream too: media_id, ix, ts, src. media_id, ix, ts, text, skipped.

    A reply is skipped if its cue was given another text after it was sent and up to when it came: a stream-stream join
    under watermarks, so it does not matter which of the two arrives first. What no edit meets is given out when the
    watermark has passed it, and may be applied. Edits that leave the text as it was sent don't count; a reply that took
    longer than `longest` can't be judged, since edits are forgotten by then, and is skipped. A skipped reply comes once for
    each edit that it met. A null id meets nothing. `delay` is how late rows of either stream may be.
    """
    asked = replies.select("media_id", "ix", "sent_at", "ts", "sent_src", "text").withWatermark("ts", delay)
    changed = edits.select(F.col("media_id").alias("e_media"), F.col("ix").alias("e_ix"), F.col("ts").alias("e_ts"), F.col("src").alias("e_src")).withWatermark("e_ts", delay)
    met = F.expr(f"media_id = e_media AND ix = e_ix AND e_ts <= ts AND e_ts >= ts - INTERVAL {longest} AND e_ts > sent_at AND NOT e_src <=> sent_src")
    joined = asked.join(changed, met, "leftOuter")
    late = F.expr(f"sent_at IS NULL OR sent_at < ts - INTERVAL {longest}")
    return joined.select("media_id", "ix", "ts", "text", (F.col("e_ts").isNotNull() | late).alias("skipped"))
