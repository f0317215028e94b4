"""apply_edits against a plain loop over each item's whole list."""

import math
import random
from collections import defaultdict

from cuelake.operators.replay import apply_edits

WIDE = "今日はいい天気ですね"


def near(x):
    return math.floor(x * 1000 + 0.5) / 1000


def halves(text, share):
    """By definition: the mark nearest to the share within a quarter of the text, the left one of two as near; else right there."""
    if not text:
        return "", ""
    n = len(text)
    goal = max(1, min(n - 1, math.floor(n * share + 0.5)))
    places = [p for p in range(1, n) if text[p - 1] in "\t\n\x0b\f\r ,.!?;:、。，！？" and goal - n // 4 <= p <= goal + n // 4]
    at = min(places, key=lambda p: (abs(p - goal), p), default=goal)
    return text[:at].strip(" "), text[at:].strip(" ")


def glue(a, b):
    return (a + ("" if a and a[-1] in WIDE else " ") + b if a and b else a + b).strip(" ")


def by_loop(cues, edits, duration):
    """One item. cues: (ix, start, end, src, tgt, src_orig) in order; edits: dicts. The list after them, and the refused."""
    items = [dict(zip(("old_ix", "start", "end", "src", "tgt", "src_orig"), c, strict=True), made_by=None) for c in cues]
    refused = []
    for e in sorted(edits, key=lambda e: e["edit_ix"]):
        kind, no = e["kind"], lambda why, e=e: refused.append((e["edit_ix"], e["kind"], why))
        if kind == "insert":
            if duration is None:
                no("no_duration")
            elif any(c["start"] <= e["t"] < c["end"] for c in items):
                no("inside_cue")
            else:
                later = [c["start"] for c in items if c["start"] > e["t"]]
                end = min(later[0] - 0.05 if later else duration, e["t"] + 2.5)
                if end - e["t"] < 0.4:
                    no("no_room")
                else:
                    items.append(dict(start=near(e["t"]), end=near(end), src="", tgt="", src_orig=None, old_ix=None, made_by=e["edit_ix"]))
                    items.sort(key=lambda c: c["start"])
            continue
        if kind == "shift":
            top = math.inf if duration is None else duration
            for c in items:
                c["start"], c["end"] = (min(max(c[k] + e["offset"], 0.0), top) for k in ("start", "end"))
            items = [c for c in items if c["end"] - c["start"] > 0.05]
            continue
        if kind not in ("split", "merge", "add", "delete", "unfix", "time"):
            no("unknown_kind")
            continue
        which = [k for k, c in enumerate(items) if (c["made_by"] == e["made_by"] if e.get("made_by") is not None else c["old_ix"] == e["ix"])]
        if not which:
            no("no_cue")
            continue
        k = which[0]
        c, after = items[k], items[k + 1] if k + 1 < len(items) else None
        if kind == "delete":
            items.pop(k)
        elif kind == "unfix":
            if c["src_orig"]:
                c["src"], c["src_orig"] = c["src_orig"], None
            else:
                no("not_fixed")
        elif kind == "merge":
            if after:
                c.update(end=after["end"], src=glue(c["src"], after["src"]), tgt=glue(c["tgt"], after["tgt"]))
                items.pop(k + 1)
            else:
                no("no_next")
        elif kind == "split":
            length = c["end"] - c["start"]
            if length < 0.4:
                no("too_short")
                continue
            at = near(e["t"] if c["start"] + 0.2 < e["t"] < c["end"] - 0.2 else (c["start"] + c["end"]) / 2)
            (a, b), (x, y) = (halves(c[n], (at - c["start"]) / length) for n in ("src", "tgt"))
            items.insert(k + 1, dict(start=at, end=c["end"], src=b, tgt=y, src_orig=None, old_ix=None, made_by=e["edit_ix"]))
            c.update(end=at, src=a, tgt=x)
        elif kind == "add":
            room = after["start"] if after else duration if duration is not None else c["end"] + 3
            if room - c["end"] < 0.4:
                no("no_room")
            else:
                items.insert(k + 1, dict(start=near(c["end"] + 0.05), end=near(min(room - 0.05, c["end"] + 2.5)), src="", tgt="", src_orig=None, old_ix=None, made_by=e["edit_ix"]))
        elif kind == "time":
            low = items[k - 1]["end"] if k else 0.0
            high = after["start"] if after else duration if duration is not None else math.inf
            changed = False
            if low <= c["end"] - 0.2:
                c["start"], changed = near(min(max(e["new_start"], low), c["end"] - 0.2)), True
            if c["start"] + 0.2 <= high:
                c["end"], changed = near(min(max(e["new_end"], c["start"] + 0.2), high)), True
            if not changed:
                no("no_room")
    return [(i, *(c[n] for n in ("start", "end", "src", "tgt", "src_orig", "old_ix", "made_by"))) for i, c in enumerate(items)], sorted(refused)


def some_item(rnd, media):
    """Cues in order, some touching, some overlapping, and a log of edits, dense or sparse."""
    t, cues = 0.0, []
    for ix in range(rnd.randint(0, 40)):
        t += rnd.choice([0, 0, 0.1, 0.7, 3.0])
        length = rnd.choice([0.15, 0.3, 1.0, 2.7])
        src = rnd.choice(["", "one two, three four", "a", WIDE, "well. yes", "abcdefghijkl"])
        cues.append((ix * 2, round(t, 3), round(t + length, 3), src, rnd.choice(["", "x y z", WIDE]), rnd.choice([None, "", "before"])))
        t += length - (0.5 if media % 7 == 3 and rnd.random() < 0.2 else 0)
    edits, kinds = [], ["split", "merge", "add", "delete", "unfix", "time", "insert"] + ["time", "unfix", "split", "add"] * (media % 3)
    for k in range(rnd.choice([0, 1, 1, 2, 4, 12])):
        kind = rnd.choice(kinds + (["shift", "odd"] if media % 5 == 0 else []))
        e = dict(media_id=media, edit_ix=k * 3 + 1, kind=kind, ix=rnd.randint(0, 42) * 2, made_by=None, t=round(rnd.uniform(0, 60), 2), new_start=round(rnd.uniform(0, 60), 3), new_end=round(rnd.uniform(0, 60), 3), offset=rnd.choice([-3.0, 2.0, 40.0]))
        if media % 4 == 1 and k and rnd.random() < 0.3:
            e["made_by"] = rnd.choice(edits)["edit_ix"]
        edits.append(e)
    return cues, edits, rnd.choice([None, 50.0, 200.0])


def check(spark, seed, n):
    rnd = random.Random(seed)
    given = {m: some_item(rnd, m) for m in range(n)}
    cues = spark.createDataFrame([(m, *c) for m, (cs, *_) in given.items() for c in cs], "media_id long, ix long, start double, end double, src string, tgt string, src_orig string")
    names = "media_id edit_ix kind ix made_by t new_start new_end offset".split()
    edits = spark.createDataFrame([tuple(e[k] for k in names) for _, es, _ in given.values() for e in es], "media_id long, edit_ix long, kind string, ix long, made_by long, t double, new_start double, new_end double, offset double")
    durations = spark.createDataFrame([(m, d) for m, (*_, d) in given.items()], "media_id long, duration double")
    result, rejected = apply_edits(cues, edits, durations)
    got, refused = defaultdict(list), defaultdict(list)
    for r in result.collect():
        got[r.media_id].append(tuple(r)[1:])
    for r in rejected.collect():
        refused[r.media_id].append(tuple(r)[1:])
    for m, (cs, es, d) in given.items():
        wanted, why = by_loop(cs, es, d if cs else None)
        if not cs:
            why = sorted((e["edit_ix"], e["kind"], w) for e, w in ((e, next((x[2] for x in why if x[0] == e["edit_ix"]), None)) for e in es) if w)
        assert sorted(refused[m]) == why, (m, es)
        assert sorted(got[m], key=lambda r: r[0]) == wanted, (m, cs, es, d)


def test_like_a_loop(spark):
    check(spark, 1, 60)


def test_edits_that_lie_apart_need_no_python(spark):
    """One long item of a thousand cues and many edits far from each other: no row reaches the replay."""
    cues = spark.createDataFrame([(1, i, i * 2.0, i * 2.0 + 1.5, "one two", "") for i in range(1000)], "media_id long, ix long, start double, end double, src string, tgt string")
    edits = spark.createDataFrame([(1, i, "split" if i % 2 else "add", i * 20) for i in range(40)], "media_id long, edit_ix long, kind string, ix long")
    from cuelake.operators import replay

    rows, log = replay._given(cues, edits, None)
    assert replay._clustered(rows, replay._placed(rows, log)).filter("n > 1 or whole").count() == 0
    result, rejected = apply_edits(cues, edits)
    assert result.count() == 1040 and rejected.count() == 0


def test_no_edits(spark):
    cues = spark.createDataFrame([(1, 5, 0.0, 1.0, None)], "media_id long, ix long, start double, end double, src string")
    result, rejected = apply_edits(cues, spark.createDataFrame([], "media_id long, edit_ix long, kind string, ix long"))
    assert [tuple(r) for r in result.collect()] == [(1, 0, 0.0, 1.0, "", "", None, 5, None)] and rejected.count() == 0
