"""A log of mixed edits applied to cues in its order, with what was refused and why.

Most edits of a log lie apart: each of them reads its cue and that cue's neighbours alone, and goes through joins and
windows. Edits that lie close meet in a cluster, whose cues alone are replayed in order; clusters are apart by
construction, so they are tasks of their own even within one long item.
"""

from __future__ import annotations

import math
import re
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from .edits import split_position
from .grouped import by_group

#: Kinds of edits that take a cue away, those that name a cue, and those that name a time or the whole item.
REMOVE, NAMED, UNNAMED = ("merge", "delete"), ("split", "merge", "add", "delete", "unfix", "time"), ("insert", "shift")
#: Seconds: the shortest cue that is split, how far inside a cut lies, the least room for a new cue, its length and distance, the shortest cue by time, what a shift drops.
SPLIT, INSIDE, ROOM, LENGTH, APART, LEAST, DROPPED = 0.4, 0.2, 0.4, 2.5, 0.05, 0.2, 0.05
_CUE = "start double, end double, src string, tgt string, src_orig string, old_ix long, made_by long"
_EDIT = {"edit_ix": "long", "kind": "string", "ix": "long", "made_by": "long", "t": "double", "new_start": "double", "new_end": "double", "offset": "double"}


def _ms(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def _given(cues: DataFrame, edits: DataFrame, durations: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Cues with pos, their neighbours' times and texts, and duration; edits with every column they may have."""
    by = Window.partitionBy("media_id").orderBy("ix")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cues.columns else F.lit("")
    orig = F.col("src_orig") if "src_orig" in cues.columns else F.lit(None).cast("string")
    rows = cues.select("media_id", F.col("ix").cast("long").alias("ix"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), text("src").alias("src"), text("tgt").alias("tgt"), orig.alias("src_orig"))
    known = durations.groupBy("media_id").agg(F.max("duration").cast("double").alias("duration")) if durations is not None else None
    rows = rows.join(known, "media_id", "left") if known is not None else rows.withColumn("duration", F.lit(None).cast("double"))
    rows = rows.withColumns({"pos": (F.row_number().over(by) - 1).cast("long"), "before": F.lag("end").over(by), "reached": F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), "after": F.lead(F.struct("start", "end", "src", "tgt")).over(by)})
    log = edits.select("media_id", *[(F.col(c).cast(kind) if c in edits.columns else F.lit(None).cast(kind)).alias(c) for c, kind in _EDIT.items()])
    return rows, log


def _placed(rows: DataFrame, log: DataFrame) -> DataFrame:
    """The log with pos: of the named cue, or of the last one that starts at or before t; early: why an edit can't be at all."""
    named = log.filter(~F.coalesce(F.col("kind").isin(*UNNAMED), F.lit(False))).join(rows.select("media_id", "ix", "pos"), ["media_id", "ix"], "left")
    early = F.when(~F.coalesce(F.col("kind").isin(*NAMED), F.lit(False)), "unknown_kind").when(F.col("pos").isNull() & F.col("made_by").isNull(), "no_cue")
    shifts = log.filter("kind = 'shift'").withColumns({"pos": F.lit(0).cast("long"), "early": F.when(F.col("offset").isNull(), "no_offset")})
    inserts = log.filter("kind = 'insert'")
    marks = rows.select("media_id", F.col("start").alias("t"), F.lit(0).alias("side"), "pos", F.lit(None).cast("long").alias("edit_ix"))
    both = marks.unionByName(inserts.select("media_id", "t", F.lit(1).alias("side"), F.lit(None).cast("long").alias("pos"), "edit_ix"))
    held = F.last("pos", ignorenulls=True).over(Window.partitionBy("media_id").orderBy("t", "side", "pos").rowsBetween(Window.unboundedPreceding, 0))
    at = both.withColumn("held", F.coalesce(held, F.lit(-1))).filter("side = 1").select("media_id", "edit_ix", F.col("held").alias("pos"))
    inserts = inserts.join(at, ["media_id", "edit_ix"]).withColumn("early", F.when(F.col("t").isNull(), "no_time"))
    return named.withColumn("early", early).unionByName(shifts).unionByName(inserts)


def _clustered(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Possible edits with cluster, n (edits in it), lo and hi (the positions that it may read or change).

    A cluster reads one cue beyond its edits, and as many more as the item's log takes away. An item is one cluster where
    edits name cues that edits made, where a shift is among others, or where a time is looked for among cues out of order.
    """
    item = Window.partitionBy("media_id")
    order = item.orderBy("pos", "edit_ix")
    disorder = rows.filter("start < reached").select("media_id", F.lit(True).alias("disorder")).distinct()
    sizes = rows.groupBy("media_id").agg(F.max("pos").alias("top"))
    out = placed.filter("early is null").join(disorder, "media_id", "left").join(sizes, "media_id", "left")
    out = out.withColumns({
        "far": 1 + F.count_if(F.col("kind").isin(*REMOVE)).over(item),
        "whole": ((F.count_if(F.col("kind") == "shift").over(item) > 0) & (F.count("*").over(item) > 1)) | (F.count("made_by").over(item) > 0) | (F.coalesce(F.col("disorder"), F.lit(False)) & (F.count_if(F.col("kind") == "insert").over(item) > 0)),
    })
    opens = F.coalesce(F.col("pos") - F.lag("pos").over(order) > 2 * F.col("far"), F.lit(True)) & (~F.col("whole") | (F.row_number().over(order) == 1))
    out = out.withColumn("cluster", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy("media_id", "cluster")
    lo, hi = F.min("pos").over(span) - F.col("far"), F.max("pos").over(span) + F.col("far")
    return out.withColumns({"n": F.count("*").over(span), "lo": F.when(F.col("whole"), 0).otherwise(F.greatest(lo, F.lit(0))), "hi": F.when(F.col("whole"), F.col("top")).otherwise(F.least(hi, F.col("top")))})


def _joined_text(a: Column, b: Column) -> Column:
    glue = F.when(F.right(a, F.lit(1)).rlike(T.CJK), "").otherwise(" ")
    return F.trim(F.when((a != "") & (b != ""), F.concat(a, glue, b)).otherwise(F.concat(a, b)))


def _alone(rows: DataFrame, lone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues after edits that no other one is near, as pos, sub and cue columns; and edit_ix, kind, reason of those refused. Joins alone."""
    by_cue = lone.filter(F.col("kind").isin(*NAMED)).select("media_id", "pos", "edit_ix", "kind", "t", "new_start", "new_end")
    shifts = lone.filter("kind = 'shift'").select("media_id", "offset")
    c = F.col
    got = rows.join(by_cue, ["media_id", "pos"], "left").join(shifts, "media_id", "left")
    length = c("end") - c("start")
    at = _ms(F.when((c("t") > c("start") + INSIDE) & (c("t") < c("end") - INSIDE), c("t")).otherwise((c("start") + c("end")) / 2))
    got = got.withColumn("at", at)
    share = (c("at") - c("start")) / length
    got = got.withColumns({"cut_src": F.when(c("kind") == "split", split_position(c("src"), share)), "cut_tgt": F.when(c("kind") == "split", split_position(c("tgt"), share))})
    room = F.coalesce(c("after.start"), c("duration"), c("end") + 3)
    low, high = F.coalesce(c("before"), F.lit(0.0)), F.coalesce(c("after.start"), c("duration"), F.lit(float("inf")))
    begin = F.when(low <= c("end") - LEAST, _ms(F.least(F.greatest("new_start", low), c("end") - LEAST)))
    begins = F.coalesce("begin", "start")
    stop = F.when(c("begins") + LEAST <= high, _ms(F.least(F.greatest(c("new_end"), c("begins") + LEAST), high)))
    got = got.withColumn("begin", begin).withColumn("begins", begins).withColumn("stop", stop)
    reason = (
        F.when((c("kind") == "split") & (length < SPLIT), "too_short").when((c("kind") == "merge") & c("after").isNull(), "no_next").when((c("kind") == "add") & (room - c("end") < ROOM), "no_room")
        .when((c("kind") == "unfix") & (F.coalesce("src_orig", F.lit("")) == ""), "not_fixed").when((c("kind") == "time") & c("begin").isNull() & c("stop").isNull(), "no_room")
    )
    got = got.withColumn("reason", reason).withColumn("does", F.when(c("reason").isNull(), c("kind")))
    got = got.withColumn("absorbed", F.coalesce(F.lag("does").over(Window.partitionBy("media_id").orderBy("pos")) == "merge", F.lit(False)))
    none, double = F.lit(None), "double"

    def cue(sub: int, start: Column, end: Column, src: Column, tgt: Column, orig: Column, old: Column, made: Column) -> Column:
        return F.struct(F.lit(sub).alias("sub"), start.cast(double).alias("start"), end.cast(double).alias("end"), src.alias("src"), tgt.alias("tgt"), orig.cast("string").alias("src_orig"), old.cast("long").alias("old_ix"), made.cast("long").alias("made_by"))

    own = (c("src_orig"), c("ix"), none)
    left = lambda name: F.when(c(name) == "", "").otherwise(F.trim(F.substring(name, F.lit(1), c(f"cut_{name}"))))
    right = lambda name: F.when(c(name) == "", "").otherwise(F.trim(F.substring(name, c(f"cut_{name}") + 1, F.length(name))))
    same = cue(0, c("start"), c("end"), c("src"), c("tgt"), *own)
    moved = lambda x: F.least(F.greatest(x + c("offset"), F.lit(0.0)), F.coalesce("duration", F.lit(float("inf"))))
    shifted = F.when(moved(c("end")) - moved(c("start")) > DROPPED, F.array(cue(0, moved(c("start")), moved(c("end")), c("src"), c("tgt"), *own))).otherwise(F.array().cast(f"array<struct<sub:int,{_CUE.replace(' ', ':').replace(',:', ',')}>>"))
    out = (
        F.when(c("offset").isNotNull(), shifted).when(c("absorbed") | (c("does") == "delete"), F.slice(F.array(same), 1, 0))
        .when(c("does") == "split", F.array(cue(0, c("start"), c("at"), left("src"), left("tgt"), *own), cue(1, c("at"), c("end"), right("src"), right("tgt"), none, none, c("edit_ix"))))
        .when(c("does") == "merge", F.array(cue(0, c("start"), c("after.end"), _joined_text(c("src"), c("after.src")), _joined_text(c("tgt"), c("after.tgt")), *own)))
        .when(c("does") == "add", F.array(same, cue(1, _ms(c("end") + APART), _ms(F.least(room - APART, c("end") + LENGTH)), F.lit(""), F.lit(""), none, none, c("edit_ix"))))
        .when(c("does") == "unfix", F.array(cue(0, c("start"), c("end"), c("src_orig"), c("tgt"), none, c("ix"), none)))
        .when(c("does") == "time", F.array(cue(0, c("begins"), F.coalesce("stop", "end"), c("src"), c("tgt"), *own))).otherwise(F.array(same))
    )
    kept = got.select("media_id", "pos", F.explode(out).alias("x")).select("media_id", "pos", "x.*")
    refused = got.filter("reason is not null").select("media_id", "edit_ix", "kind", "reason")

    # inserts: the cue that holds t, the one after it, and the duration
    asked = lone.filter("kind = 'insert'").select("media_id", "pos", "edit_ix", "t")
    near = asked.join(rows.select("media_id", "pos", F.col("end").alias("held"), F.col("after.start").alias("next"), "duration"), ["media_id", "pos"], "left")
    first = rows.filter("pos = 0").select("media_id", F.col("start").alias("first"), F.col("duration").alias("d"))
    near = near.join(first, "media_id", "left")
    goes_to = F.least(F.coalesce(F.when(c("pos") < 0, c("first")).otherwise(c("next")) - APART, F.coalesce("duration", "d")), c("t") + LENGTH)
    why = F.when(F.coalesce("duration", "d").isNull(), "no_duration").when(F.coalesce(c("t") < c("held"), F.lit(False)), "inside_cue").when(goes_to - c("t") < ROOM, "no_room")
    near = near.withColumns({"reason": why, "stop": goes_to})
    new = near.filter("reason is null").select("media_id", "pos", F.lit(2).alias("sub"), _ms(c("t")).alias("start"), _ms(c("stop")).alias("end"), F.lit("").alias("src"), F.lit("").alias("tgt"), none.cast("string").alias("src_orig"), none.cast("long").alias("old_ix"), c("edit_ix").alias("made_by"))
    return kept.unionByName(new), refused.unionByName(near.filter("reason is not null").select("media_id", "edit_ix", F.lit("insert").alias("kind"), "reason"))


_MARK = re.compile("[\t\n\x0b\f\r ,.!?;:、。，！？]")
_WIDE = [tuple(int(x, 16) for x in pair) for pair in re.findall(r"x\{(\w+)\}-\\x\{(\w+)\}", T.CJK)]


def _cut(text: str, share: float) -> tuple[str, str]:
    """Both sides of a text at split_position."""
    if not text:
        return "", ""
    n = len(text)
    goal = max(min(int(Decimal(repr(n * share)).to_integral_value(ROUND_HALF_UP)), n - 1), 1)
    reach = n // 4
    left = [goal - k for k in range(max(goal - reach, 1) - 1, goal) if _MARK.match(text[k])]
    before = goal - 1 - max((k for k in range(max(goal - reach, 1) - 1, goal) if _MARK.match(text[k])), default=-(10**9))
    after = next((k for k in range(max(0, min(reach, n - 1 - goal))) if _MARK.match(text[goal + k])), None)
    at = goal - before if left and (after is None or before <= after + 1) else goal + after + 1 if after is not None else goal
    return text[:at].strip(" "), text[at:].strip(" ")


def _glued(a: str, b: str) -> str:
    wide = bool(a) and any(lo <= ord(a[-1]) <= hi for lo, hi in _WIDE)
    return (a + ("" if wide else " ") + b if a and b else a + b).strip(" ")


class _Cues:
    """The cues of one cluster, and the edits' effects on them. Each effect returns why it is refused, or nothing."""

    def __init__(self, cues: list[dict], low: float, high: float | None, duration: float | None):
        self.cues, self.low, self.high, self.duration = cues, low, high, duration

    def next_start(self, k: int) -> float | None:
        return self.cues[k + 1]["start"] if k + 1 < len(self.cues) else self.high

    def split(self, k: int, e: dict) -> str | None:
        s = self.cues[k]
        length = s["end"] - s["start"]
        if length < SPLIT:
            return "too_short"
        t = e["t"]
        at = _near(t if t is not None and s["start"] + INSIDE < t < s["end"] - INSIDE else (s["start"] + s["end"]) / 2)
        (s1, s2), (t1, t2) = (_cut(s[c], (at - s["start"]) / length) for c in ("src", "tgt"))
        self.cues.insert(k + 1, _new(at, s["end"], e, s2, t2))
        s.update(end=at, src=s1, tgt=t1)
        return None

    def merge(self, k: int, e: dict) -> str | None:
        if k + 1 >= len(self.cues):
            return "no_next"
        s, n = self.cues[k], self.cues.pop(k + 1)
        s.update(end=n["end"], src=_glued(s["src"], n["src"]), tgt=_glued(s["tgt"], n["tgt"]))
        return None

    def add(self, k: int, e: dict) -> str | None:
        end, room = self.cues[k]["end"], self.next_start(k)
        room = room if room is not None else self.duration if self.duration is not None else end + 3
        if room - end < ROOM:
            return "no_room"
        self.cues.insert(k + 1, _new(_near(end + APART), _near(min(room - APART, end + LENGTH)), e))
        return None

    def delete(self, k: int, e: dict) -> str | None:
        del self.cues[k]
        return None

    def unfix(self, k: int, e: dict) -> str | None:
        s = self.cues[k]
        if not s["src_orig"]:
            return "not_fixed"
        s.update(src=s["src_orig"], src_orig=None)
        return None

    def time(self, k: int, e: dict) -> str | None:
        s, low, high = self.cues[k], self.cues[k - 1]["end"] if k else self.low, self.next_start(k)
        high = high if high is not None else self.duration if self.duration is not None else math.inf
        done = False
        if low <= s["end"] - LEAST:
            s["start"], done = _near(min(max(_or(e["new_start"], low), low), s["end"] - LEAST)), True
        if s["start"] + LEAST <= high:
            s["end"], done = _near(min(max(_or(e["new_end"], s["start"] + LEAST), s["start"] + LEAST), high)), True
        return None if done else "no_room"

    def insert(self, e: dict) -> str | None:
        t = e["t"]
        if self.duration is None:
            return "no_duration"
        if any(s["start"] <= t < s["end"] for s in self.cues):
            return "inside_cue"
        after = next((s["start"] for s in self.cues if s["start"] > t), self.high)
        end = min(after - APART if after is not None else self.duration, t + LENGTH)
        if end - t < ROOM:
            return "no_room"
        self.cues.append(_new(_near(t), _near(end), e))
        self.cues.sort(key=lambda s: s["start"])
        return None

    def shift(self, e: dict) -> str | None:
        most = self.duration if self.duration is not None else math.inf
        for s in self.cues:
            s.update(start=min(max(s["start"] + e["offset"], 0.0), most), end=min(max(s["end"] + e["offset"], 0.0), most))
        self.cues = [s for s in self.cues if s["end"] - s["start"] > DROPPED]
        return None


def _near(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


def _or(x: float | None, other: float) -> float:
    return other if x is None else x


def _new(start: float, end: float, e: dict, src: str = "", tgt: str = "") -> dict:
    return {"start": start, "end": end, "src": src, "tgt": tgt, "src_orig": None, "old_ix": None, "made_by": e["edit_ix"]}


def _replayed(media: object, cues: list[dict], edits: list[dict]) -> list[dict]:
    """One cluster: its cues after its edits in their order, and the refused edits, told apart by reason."""
    log = sorted(edits, key=itemgetter("edit_ix"))
    rows = sorted(cues, key=itemgetter("pos"))
    lo = log[0]["low"]
    held = [{c: r[c] for c in ("start", "end", "src", "tgt", "src_orig")} | {"old_ix": r["ix"], "made_by": None} for r in rows]
    state = _Cues(held, rows[0]["before"] or 0.0, rows[-1]["after_start"], rows[0]["duration"]) if rows else _Cues([], 0.0, None, None)
    out = []
    for e in log:
        if e["kind"] in UNNAMED:
            reason = getattr(state, e["kind"])(e)
        else:
            name, value = ("made_by", e["made_by"]) if e["made_by"] is not None else ("old_ix", e["ix"])
            k = next((k for k, s in enumerate(state.cues) if s[name] == value), None)
            reason = "no_cue" if k is None else getattr(state, e["kind"])(k, e)
        if reason:
            out.append({"media_id": media, "pos": lo, "sub": 0, "edit_ix": e["edit_ix"], "kind": e["kind"], "reason": reason})
    return out + [{"media_id": media, "pos": lo, "sub": k, **s} for k, s in enumerate(state.cues)]


def apply_edits(cues: DataFrame, edits: DataFrame, durations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """cues: media_id, ix, start, end, src, and tgt, src_orig if known. edits: media_id, edit_ix, kind and what the kind needs.

    An edit names a cue by ix, its number before any edit, or by made_by, the edit that made it. Kinds: split (t; a cue of
    0.4 s or more, at t where that lies 0.2 s inside, else in the middle), merge (with the cue that is next by then), add (a
    cue after it), delete, unfix (back to src_orig), time (new_start, new_end, between the neighbours), and without a cue
    insert (t) and shift (offset). durations: media_id, duration; without one, insert is refused and nothing is clamped to it.

    Returns two tables. Cues: media_id, ix (the new number), start, end, src, tgt, src_orig, old_ix (the number before, null
    for new cues: the map of numbers) and made_by. Refused edits: media_id, edit_ix, kind, reason, one of no_cue,
    unknown_kind, too_short, no_next, no_room, not_fixed, inside_cue, no_duration, no_time, no_offset. A null or empty text
    has no other half; edits of items without cues are refused; edit_ix is unique within an item.
    """
    rows, log = _given(cues, edits, durations)
    placed = _placed(rows, log)
    clustered = _clustered(rows, placed)
    lone, close = clustered.filter("n = 1 and not whole"), clustered.filter("n > 1 or whole")
    kept, refused = _alone(rows, lone)
    spans = close.select("media_id", "cluster", "lo", "hi").distinct()
    held = spans.filter("hi >= lo").select("media_id", "cluster", F.explode(F.sequence("lo", "hi")).alias("pos"))
    media = cues.schema["media_id"].dataType.simpleString()
    cue = F.struct("pos", "ix", "start", "end", "src", "tgt", "src_orig", "before", F.col("after.start").alias("after_start"), "duration")
    inside = rows.join(held, ["media_id", "pos"]).select("media_id", "cluster", cue.alias("cue"))
    of_log = close.select("media_id", "cluster", F.struct(F.col("lo").alias("low"), *_EDIT).alias("edit"))
    kind = StructType.fromDDL(f"media_id {media}, pos long, sub int, {_CUE}, edit_ix long, kind string, reason string")
    arrow = to_arrow_schema(kind)

    def replay(table: pa.Table) -> pa.Table:
        out = []
        for (item, _), members in groupby(table.to_pylist(), key=itemgetter("media_id", "cluster")):
            both = list(members)
            out += _replayed(item, [r["cue"] for r in both if r["cue"]], [r["edit"] for r in both if r["edit"]])
        return pa.Table.from_pylist(out, schema=arrow)

    replayed = by_group(inside.unionByName(of_log, allowMissingColumns=True), ["media_id", "cluster"], [], replay, kind)
    names = [c.split()[0] for c in _CUE.split(", ")]
    whole = kept.join(held.select("media_id", "pos"), ["media_id", "pos"], "left_anti").unionByName(replayed.filter("reason is null").select("media_id", "pos", "sub", *names))
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("pos", "sub")) - 1
    result = whole.select("media_id", number.cast("long").alias("ix"), *names)
    late = replayed.filter("reason is not null").select("media_id", "edit_ix", "kind", "reason")
    first = placed.filter("early is not null").select("media_id", "edit_ix", "kind", F.col("early").alias("reason"))
    return result, first.unionByName(refused).unionByName(late)
