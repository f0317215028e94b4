"""Structured Streaming forms: sessions, regions, loops, ledgers, progress. Each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.signal import FRAME

LOOP_PERIOD, LOOP_REPEATS = 8, 16


def sessions_stream(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """events: media_id, ts (timestamp). Sessions parted by gaps; a session is emitted once the watermark has passed its end; later rows are dropped."""
    return events.withWatermark("ts", delay).groupBy("media_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("media_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bins_stream(events: DataFrame, size: str, delay: str, value: str = "value") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("media_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.max(value).alias("peak")).select("media_id", F.col("w.start").alias("start"), "n", "peak")


def usage_stream(runs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sums per month, for update mode; runs without requests don't count. State: a row a day, until the watermark has passed the day; then it is final.

    month, day, and the day's sums: a month is the sum of its days, which edits.merge_usage() adds up.
    """
    day = F.window("ts", "1 day").alias("w")
    sums = runs.filter("requests > 0").withWatermark("ts", delay).groupBy(day).agg(*[F.sum(c).alias(c) for c in ("requests", "prompt", "completion", "cache_hit")])
    return sums.select(F.date_format("w.start", "yyyy-MM").alias("month"), F.to_date("w.start").alias("day"), "requests", "prompt", "completion", "cache_hit")


def progress_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """events: job_id, ts, progress. Progress per job never goes back: the greatest value seen, for update mode.

    A job that is silent for `delay` behind the watermark gives its state up.
    """
    job = events.schema["job_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else float("-inf")
        pdf = pd.concat(list(batches))
        now = max(before, float(pdf["progress"].max()))
        state.update((now,))
        _until(state, pdf["ts"].max(), delay)
        if now > before:
            yield pd.DataFrame({"job_id": [key[0]], "progress": [now]})

    rows = events.withWatermark("ts", delay).select("job_id", "ts", F.col("progress").cast("double").alias("progress"))
    return rows.groupBy("job_id").applyInPandasWithState(step, f"job_id {job}, progress double", "progress double", "update", GroupStateTimeout.EventTimeTimeout)


def _until(state: GroupState, latest: pd.Timestamp, delay: str) -> None:
    """State lasts until the watermark is `delay` behind the latest event of its key."""
    seconds = int(pd.Timedelta(delay).total_seconds())
    state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))


def regions_stream(frames: DataFrame, on: float = 0.45, off: float = 0.3, min_silence: float = 0.2, min_speech: float = 0.08, pad: float = 0.06, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """frames: media_id, frame_ix, p. media_id, s, e, n_frames: two-threshold regions, as signal.speech_regions() makes them.

    A region is given out once a silence of min_silence has followed it, so that short ones close; short regions go and the
    rest is padded (the end of the recording isn't known and clips nothing). Within a micro-batch frames are ordered by index;
    a frame at or before the last one seen is dropped. A key that is silent for the timeout gives out its open region and its
    state; None keeps state for ever.
    """
    media = frames.schema["media_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # held: whether the signal is on; first, stop and n are of the region that may still grow
        seen, held, first, stop, n = state.get if state.exists else (-1, False, -1, -1, 0)
        out = []

        def give() -> None:
            if first >= 0 and (stop - first) * FRAME >= min_speech:
                out.append((max(0.0, first * FRAME - pad), stop * FRAME + pad, n))

        if state.hasTimedOut:
            give()
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values("frame_ix")
            for ix, p in zip(pdf["frame_ix"].astype(int), pdf["p"], strict=True):
                if ix <= seen:
                    continue
                seen, held = ix, p >= on or held and p >= off
                if held:
                    if first < 0 or (ix - stop) * FRAME >= min_silence:
                        give()
                        first, n = ix, 0
                    stop, n = ix + 1, n + 1
            if first >= 0 and not held and (seen + 1 - stop) * FRAME >= min_silence:
                give()
                first, stop, n = -1, -1, 0
            state.update((seen, bool(held), first, stop, n))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"media_id": [key[0]] * len(out), "s": [x[0] for x in out], "e": [x[1] for x in out], "n_frames": [x[2] for x in out]})

    return frames.select("media_id", "frame_ix", "p").groupBy("media_id").applyInPandasWithState(step, f"media_id {media}, s double, e double, n_frames long", "seen long, held boolean, first long, stop long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def loops(tail: list, period: int = LOOP_PERIOD, repeats: int = LOOP_REPEATS) -> bool:
    """Whether a list of tokens ends in some pattern of up to `period` tokens, `repeats` times over."""
    return any(len(tail) >= k * repeats and all(tail[-i] == tail[-i - k] for i in range(1, k * (repeats - 1) + 1)) for k in range(1, period + 1))


def loop_stream(tokens: DataFrame, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """tokens: media_id, token_ix, token. media_id, token_ix of the first token at which a loop stands.

    State: the last 128 tokens, until a key is silent for the timeout; None keeps it for ever.
    """
    media = tokens.schema["media_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail, stopped = state.get if state.exists else ([], False)
        tail, found = list(tail), []
        for ix, token in sorted((int(i), str(t)) for b in batches for i, t in zip(b["token_ix"], b["token"], strict=True)):
            if stopped:
                break
            tail = [*tail, token][-LOOP_PERIOD * LOOP_REPEATS :]
            if stopped := loops(tail):
                found.append(ix)
        state.update((tail, stopped))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"media_id": [key[0]] * len(found), "token_ix": found})

    return tokens.select("media_id", "token_ix", "token").groupBy("media_id").applyInPandasWithState(step, f"media_id {media}, token_ix long", "tail array<string>, stopped boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def latest_by_id(replies: DataFrame, cues: DataFrame, delay: str = "1 hour") -> DataFrame:
    """replies: media_id, ix, ts, sent_src, text. cues, a table: media_id, ix, src. media_id, ix, ts, text, for update mode.

    The last reply to a cue wins, by ts, whatever the order of delivery: a row is given out whenever a later one has come,
    so that who writes them by id ends with the last. A reply to a text that is no longer the cue's is dropped. A cue whose
    replies are all `delay` behind the watermark gives its state up.
    """
    media, ix = (replies.schema[c].dataType.simpleString() for c in ("media_id", "ix"))
    current = cues.select("media_id", "ix", F.col("src").alias("__src"))
    fresh = replies.withWatermark("ts", delay).join(current, ["media_id", "ix"]).filter(F.col("sent_src").eqNullSafe(F.col("__src")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "text"])
        last = pdf.iloc[-1]
        before = state.get[0] if state.exists else -(1 << 62)
        now = int(last["ts"].value // 1000)
        if now >= before:
            state.update((now,))
            yield pd.DataFrame({"media_id": [key[0]], "ix": [key[1]], "ts": [last["ts"]], "text": [last["text"]]})
        _until(state, max(last["ts"], pd.Timestamp(before, unit="us")) if before > 0 else last["ts"], delay)

    return fresh.select("media_id", "ix", "ts", "text").groupBy("media_id", "ix").applyInPandasWithState(step, f"media_id {media}, ix {ix}, ts timestamp, text string", "seen long", "update", GroupStateTimeout.EventTimeTimeout)
