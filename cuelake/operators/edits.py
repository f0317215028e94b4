"""Edits as joins and windows: split, merge, insert, delete, shift, retime, revert, revisions, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranges import union_intervals


def _item():
    return Window.partitionBy("media_id").orderBy("ix")


def renumber(cues: DataFrame, *order: str) -> DataFrame:
    by = Window.partitionBy("media_id").orderBy(*(order or ("start", "end", "ix")))
    return cues.withColumn("ix", (F.row_number().over(by) - 1).cast("long"))


def split_position(text: Column, share: Column) -> Column:
    """Where a text is cut near a share of its length: at the nearest blank or mark within a quarter of it, else right there.

    Only the quarter on either side is looked at: its reverse and itself, by the length of what comes before their first mark.
    """
    n = F.length(text)
    goal = F.greatest(F.least(F.round(n * share).cast("int"), n - 1), F.lit(1))
    reach = F.floor(n / 4).cast("int")
    marks = r"^[^\s,.!?;:、。，！？]*"
    left = F.substring(text, F.greatest(goal - reach, F.lit(1)), goal - F.greatest(goal - reach, F.lit(1)) + 1)
    right = F.substring(text, goal + 1, F.least(reach, n - 1 - goal))
    before, after = (F.length(F.regexp_extract(x, marks, 0)) for x in (F.reverse(left), right))
    has_left, has_right = before < F.length(left), after < F.length(right)
    return F.when(has_left & (~has_right | (before <= after + 1)), goal - before).when(has_right, goal + after + 1).otherwise(goal)


def split_cues(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: media_id, ix, t. Each named cue of 0.4 s or more becomes two, at t if that lies 0.2 s inside, else in the middle."""
    rows = cues.join(edits.select("media_id", "ix", "t", F.lit(True).alias("__edit")), ["media_id", "ix"], "left")
    length = F.col("end") - F.col("start")
    inside = (F.col("t") >= F.col("start") + 0.2) & (F.col("t") <= F.col("end") - 0.2)
    at = F.when(inside, F.col("t")).otherwise((F.col("start") + F.col("end")) / 2)
    cut = split_position(F.col("src"), (at - F.col("start")) / length)
    part = lambda i, s, e, x: F.struct(F.lit(i).alias("part"), s.alias("start"), e.alias("end"), F.trim(x).alias("src"))
    both = F.array(part(0, F.col("start"), at, F.substring("src", F.lit(1), cut)), part(1, at, F.col("end"), F.substring("src", cut + 1, F.length("src"))))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("start"), F.col("end"), F.col("src")))
    out = rows.withColumn("x", F.explode(F.when(F.col("__edit") & (length >= 0.4), both).otherwise(whole)))
    kept = [c for c in cues.columns if c not in ("start", "end", "src")]
    return renumber(out.select(*kept, "x.start", "x.end", "x.src", "x.part"), "ix", "part").drop("part")


def merge_next(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: media_id, ix. Each named cue is merged with the one after it, chains included. media_id, ix, start, end, src, n."""
    by = _item()
    rows = cues.join(edits.select("media_id", "ix", F.lit(True).alias("__edit")), ["media_id", "ix"], "left")
    rows = rows.withColumn("opens", F.when(F.coalesce(F.lag("__edit").over(by), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("media_id", "island").agg(F.min("ix").alias("ix"), F.min("start").alias("start"), F.max_by("end", "ix").alias("end"), F.array_sort(F.collect_list(F.struct("ix", "src"))).alias("lines"), F.count("*").alias("n"))
    return merged.select("media_id", "ix", "start", "end", T.join_lines(F.transform("lines", lambda x: x["src"])).alias("src"), "n")


def insert_after(cues: DataFrame, edits: DataFrame, length: float = 2.45) -> DataFrame:
    """edits: media_id, ix, src. A cue 0.05 s after each named one, where the gap to the next is 0.4 s or more."""
    room = cues.withColumn("next", F.coalesce(F.lead("start").over(_item()), F.col("end") + length + 0.1))
    named = room.join(edits.withColumnRenamed("src", "__src"), ["media_id", "ix"]).filter(F.col("next") - F.col("end") >= 0.4)
    new = named.select("media_id", "ix", (F.col("end") + 0.05).alias("start"), F.least(F.col("end") + 0.05 + length, F.col("next") - 0.05).alias("end"), F.col("__src").alias("src"))
    return renumber(cues.select("media_id", "ix", "start", "end", "src").unionByName(new))


def insert_at(cues: DataFrame, edits: DataFrame, length: float = 2.5, shortest: float = 0.2) -> DataFrame:
    """edits: media_id, t, src. A cue from t on, up to `length` or 0.05 s before the next; none inside a cue or where there is no room.

    As-of on both sides: the last cue that starts at or before t, and the first one after it, by one union and one window.
    """
    order = Window.partitionBy("media_id").orderBy("t", "kind")
    marks = cues.select("media_id", F.col("start").alias("t"), F.lit(0).alias("kind"), "end", F.lit(None).cast("string").alias("src"))
    asked = edits.select("media_id", "t", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("end"), "src")
    rows = marks.unionByName(asked).withColumns({
        "held": F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), "next": F.min(F.when(F.col("kind") == 0, F.col("t"))).over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    end = F.least(F.col("t") + length, F.col("next") - 0.05)
    free = (F.col("kind") == 1) & ~F.coalesce(F.col("t") < F.col("held"), F.lit(False)) & (end - F.col("t") >= shortest)
    new = rows.filter(free).select("media_id", F.lit(None).cast(cues.schema["ix"].dataType).alias("ix"), F.col("t").alias("start"), end.alias("end"), "src")
    return renumber(cues.select("media_id", "ix", "start", "end", "src").unionByName(new))


def delete(cues: DataFrame, edits: DataFrame) -> DataFrame:
    return renumber(cues.join(edits.select("media_id", "ix"), ["media_id", "ix"], "left_anti"), "ix")


def revert(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """The named cues take back the text they had before proofreading."""
    rows = cues.join(edits.select("media_id", "ix", F.lit(True).alias("__edit")), ["media_id", "ix"], "left")
    return rows.withColumns({"src": F.when(F.col("__edit"), F.coalesce("src_orig", "src")).otherwise(F.col("src")), "src_orig": F.when(F.col("__edit").isNull(), F.col("src_orig"))}).drop("__edit")


def _shifted(cues: DataFrame, offset: float, duration: DataFrame) -> DataFrame:
    rows = cues.join(duration, "media_id")
    clamp = lambda x: F.least(F.greatest(x + offset, F.lit(0.0)), F.col("duration"))
    return rows.withColumns({"start": clamp(F.col("start")), "end": clamp(F.col("end"))}).withColumn("dropped", F.col("end") - F.col("start") <= 0.05).drop("duration")


def shift(cues: DataFrame, offset: float, duration: DataFrame) -> DataFrame:
    """All cues moved, clamped to [0, duration]; those of 0.05 s or less go."""
    return _shifted(cues, offset, duration).filter("NOT dropped").drop("dropped")


def shift_counts(cues: DataFrame, offset: float, duration: DataFrame) -> DataFrame:
    """media_id, kept, dropped: what shift() does to each item's cues."""
    return _shifted(cues, offset, duration).groupBy("media_id").agg(F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("dropped"))


def retime(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: media_id, ix, new_start, new_end. Times clamped between the neighbours, 0.2 s at least; without room unchanged."""
    by = _item()
    rows = cues.withColumns({"low": F.coalesce(F.lag("end").over(by), F.lit(0.0)), "high": F.coalesce(F.lead("start").over(by), F.lit(float("inf")))}).join(edits, ["media_id", "ix"], "left")
    start = F.least(F.greatest("new_start", "low"), F.col("high") - 0.2)
    end = F.greatest(F.least("new_end", "high"), start + 0.2)
    fits = F.col("new_start").isNotNull() & (F.col("high") - F.col("low") >= 0.2)
    return rows.withColumns({"start": F.when(fits, start).otherwise(F.col("start")), "end": F.when(fits, end).otherwise(F.col("end"))}).drop("low", "high", "new_start", "new_end")


def commit_revision(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """current: id, rev. incoming: id, base_rev, force. Adds accepted and rev, one higher where accepted."""
    rows = incoming.join(current.groupBy("id").agg(F.max("rev").alias("current_rev")), "id", "left")
    ok = F.coalesce(F.col("force"), F.lit(False)) | (F.col("base_rev") == F.coalesce("current_rev", F.lit(0)))
    return rows.withColumns({"accepted": F.coalesce(ok, F.lit(False)), "rev": F.coalesce("current_rev", F.lit(0)) + F.coalesce(ok, F.lit(False)).cast("int")})


def unacknowledged(results: DataFrame, acks: DataFrame, key: str = "job_id") -> DataFrame:
    return results.join(acks.select(key).distinct(), key, "left_anti")


def edit_sessions(edits: DataFrame, gap: float = 2.0, keep: int = 150) -> DataFrame:
    """edits: media_id, event_id, ts (seconds), key. media_id, session_ix, key, first, last, n: one undo step per run of a key; the last `keep`."""
    by = Window.partitionBy("media_id").orderBy("ts", "event_id")
    opens = (F.lag("key").over(by) != F.col("key")) | (F.col("ts") - F.lag("ts").over(by) > gap)
    rows = edits.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("session_ix", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    steps = rows.groupBy("media_id", "session_ix").agg(F.first("key").alias("key"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return steps.withColumn("back", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("session_ix")))).filter(F.col("back") <= keep).drop("back")


def orphans(files: DataFrame, refs: DataFrame, key: str = "file") -> DataFrame:
    return files.join(refs.select(key).distinct(), key, "left_anti")


def usage_by_month(runs: DataFrame) -> DataFrame:
    """runs: ts, requests, prompt, completion, cache_hit. Sums per month; runs without requests don't count."""
    month = F.date_format("ts", "yyyy-MM")
    return runs.filter("requests > 0").groupBy(month.alias("month")).agg(*[F.sum(c).alias(c) for c in ("requests", "prompt", "completion", "cache_hit")])


def merge_usage(ledger: DataFrame, months: DataFrame) -> DataFrame:
    """ledger and months: month, requests, prompt, completion, cache_hit. The ledger with the months added to it, one row a month."""
    return ledger.unionByName(months).groupBy("month").agg(*[F.sum(c).alias(c) for c in ("requests", "prompt", "completion", "cache_hit")])


def catalog(cues: DataFrame) -> DataFrame:
    """media_id, n_cues, duration, n_chars: counts, length of the timeline, and visible characters per item."""
    return cues.groupBy("media_id").agg(F.count("*").alias("n_cues"), F.max("end").alias("duration"), F.sum(T.visible_length(F.col("src"))).alias("n_chars"))


def catalog_list(projects: DataFrame, cues: DataFrame, files: DataFrame) -> DataFrame:
    """projects: media_id, name, updated, mode, recovered, broken. cues: media_id and more. files: media_id, length.

    media_id, name, updated, mode, n_cues, bytes, recovered, broken, newest first, ties by media_id. Counts are aggregated
    before the joins; a project without cues or files has none.
    """
    n = cues.groupBy("media_id").agg(F.count("*").alias("n_cues"))
    rows = projects.join(n, "media_id", "left").join(folder_bytes(files), "media_id", "left")
    rows = rows.select("media_id", "name", "updated", "mode", F.coalesce("n_cues", F.lit(0)).alias("n_cues"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "recovered", "broken")
    return rows.orderBy(F.desc_nulls_last("updated"), "media_id")


def folder_bytes(files: DataFrame, key: str = "media_id") -> DataFrame:
    """key, bytes: the sum of length of the files of each key. Of binaryFile tables only the length is read."""
    return files.groupBy(key).agg(F.sum("length").cast("long").alias("bytes"))


def timeline_length(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """media_id, length: the known duration of an item, else a second beyond its last cue; items of either table."""
    ends = cues.groupBy("media_id").agg(F.max("end").alias("last"))
    known = durations.groupBy("media_id").agg(F.max("duration").alias("duration"))
    return known.join(ends, "media_id", "full").select("media_id", F.coalesce(F.nullif("duration", F.lit(0.0)), F.col("last") + 1).alias("length"))


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value, first, nth: different values of each key in the order in which they first come."""
    found = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("first"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("first", value)))


def join_ranges(faces: DataFrame, ranges: DataFrame, slack: float = 0.0) -> DataFrame:
    """faces: family and more. ranges: family, s, e. faces with ranges, the union of their family's, in order; null where it has none."""
    joined = union_intervals(ranges, slack, key="family").groupBy("family").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ranges"))
    return faces.join(joined, "family", "left")


def zip_positions(left: DataFrame, right: DataFrame, value: str = "text") -> DataFrame:
    """left: media_id, ix and more. right: media_id, ix, value. left with value where both lists of an item are of one length, null elsewhere; zipped tells which."""
    counts = lambda of, name: of.groupBy("media_id").agg(F.count("*").alias(name))
    same = counts(left, "n").join(counts(right, "m"), "media_id").filter("n = m").select("media_id", F.lit(True).alias("zipped"))
    nth = lambda of: of.withColumn("__nth", F.row_number().over(_item()))
    other = nth(right.select("media_id", "ix", value)).join(same, "media_id").drop("ix")
    return nth(left.drop(value)).join(other, ["media_id", "__nth"], "left").drop("__nth").withColumn("zipped", F.coalesce("zipped", F.lit(False)))


def with_names(rows: DataFrame, names: DataFrame, column: str = "lang") -> DataFrame:
    """names: code, name, note: a caller's list of languages or tones. rows with name and note of their code, compared in lower case; a code not listed is its own name."""
    listed = names.select(F.lower("code").alias("__code"), F.col("name"), F.col("note")).dropDuplicates(["__code"])
    found = rows.join(listed, F.lower(column) == F.col("__code"), "left").drop("__code")
    return found.withColumn("name", F.coalesce("name", column))


def chinese_script(rows: DataFrame, traditional: str, simplified: str, column: str = "text", sample: int = 4000) -> DataFrame:
    """rows with script: Traditional where, of the first `sample` characters, a map of equal length changes three, and a hundredth, else Simplified; null without CJK.

    The map is the caller's: the n-th character of `traditional` becomes that of `simplified`.
    """
    head = F.substring(F.coalesce(column, F.lit("")), 1, sample)
    changed = "".join(a for a, b in zip(traditional, simplified, strict=True) if a != b)
    escaped = "".join("\\" + c if c in "[]\\^-&" else c for c in changed)
    n = F.regexp_count(head, F.lit(f"[{escaped}]")) if changed else F.lit(0)
    script = F.when(n >= F.greatest(F.lit(3.0), F.length(head) * 0.01), "Traditional").otherwise("Simplified")
    return rows.withColumn("script", F.when(head.rlike(T.CJK), script))


def dominant_language(rows: DataFrame, key: str, lang: str = "lang", text: str = "text", order: str | None = None) -> DataFrame:
    """key, lang, share: the language with most kept characters. On a tie the one seen first by `order`, or without it the first by name.

    Rows without a language don't count.
    """
    sums = rows.filter(F.col(lang).isNotNull()).groupBy(key, lang).agg(F.sum(T.kept_length(F.col(text))).alias("n"), (F.min(order) if order else F.lit(0)).alias("seen"))
    best = sums.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "seen", F.col(lang).alias("lang"))).alias("best"), F.sum("n").alias("total"))
    return best.select(key, F.col("best.lang").alias("lang"), (-F.col("best.less") / F.nullif("total", F.lit(0))).alias("share"))


def search(cues: DataFrame, query: str) -> DataFrame:
    """Cues whose source or translation holds the query, letter case aside; an empty query keeps all."""
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return cues if not query else cues.filter(holds("src") | holds("tgt") if "tgt" in cues.columns else holds("src"))


def preview(cues: DataFrame, n: int = 8) -> DataFrame:
    """The first n cues of each item."""
    return cues.withColumn("__nth", F.row_number().over(_item())).filter(F.col("__nth") <= n).drop("__nth")


def fast_cues(cues: DataFrame, lang: Column, text: str = "tgt") -> DataFrame:
    """Cues that are read faster than their language allows, with cps and limit."""
    rows = cues.withColumns({"cps": T.reading_speed(F.coalesce(text, F.lit("")), F.col("start"), F.col("end")), "limit": T.reading_limit(lang)})
    return rows.filter(F.col("cps") > F.col("limit"))


def qa_report(cues: DataFrame, durations: DataFrame | None = None, limit: float = 21.0) -> DataFrame:
    """media_id, ix, issue: empty text, overlap, wrong order, too fast, a start at or beyond the end of the media. One window pass."""
    by = _item()
    rows = cues.withColumns({"reached": F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), "before": F.lag("start").over(by)})
    tests = {"empty": F.trim("src") == "", "not_positive": F.col("end") <= F.col("start"), "unordered": F.col("start") < F.col("before"), "overlap": F.col("start") < F.col("reached"), "fast": T.reading_speed(F.col("src"), F.col("start"), F.col("end")) > limit}
    if durations is not None:
        rows = rows.join(durations, "media_id", "left")
        tests["beyond_end"] = F.col("start") >= F.col("duration")
    issues = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return rows.select("media_id", "ix", F.explode(issues).alias("issue"))
