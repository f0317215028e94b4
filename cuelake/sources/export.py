"""Sinks: SRT, WebVTT, plain text and ASS documents, one per media item, and safe names for their files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.align import wrap_lines


#: The characters that count as blank at the edges of a cue's text and after its line breaks.
BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRACKS = {"src": ["src"], "tgt": ["tgt"], "tgt-top": ["tgt", "src"], "src-top": ["src", "tgt"]}


def _tracks(content: str, order: str) -> list[str]:
    return TRACKS[order if content == "dual" else content]


def raw_text(content: str, order: str = "tgt-top") -> Column:
    """The track or tracks to show, one after another, empty ones left out; their texts as they are."""
    return F.concat_ws("\n", *[F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in _tracks(content, order)])


def _clean(text: Column) -> Column:
    """No carriage returns, blank lines, blanks around line breaks or at the edges, and no arrow that could open a cue."""
    out = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), rf"[ \t]*\n{BLANK}*", "\n")
    return F.regexp_replace(F.replace(out, F.lit("-->"), F.lit("→")), rf"^{BLANK}+|{BLANK}+$", "")


def shown_text(content: str, order: str = "tgt-top") -> Column:
    """raw_text() so that it can't break a format."""
    return _clean(raw_text(content, order))


def _vtt_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _short(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    whole = F.floor(F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0)))).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(whole >= 3600, F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"))).otherwise(""), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60))


def _ass_time(seconds: Column) -> Column:
    cs = F.greatest(F.lit(0), F.round(seconds * 100)).cast("long")
    pad = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), pad(F.floor(cs / 6000) % 60), F.lit(":"), pad(F.floor(cs / 100) % 60), F.lit("."), pad(cs % 100))


def _ass_escaped(text: Column) -> Column:
    return F.replace(F.translate(text, "{}\\", "｛｝＼"), F.lit("\n"), F.lit("\\N"))


def _ass_text(content: str, order: str) -> Column:
    """Each track's lines after the override that names its style, so that a reader can tell the tracks apart."""
    named = lambda c: F.concat(F.lit("{\\r" + c.capitalize() + "}"), _ass_escaped(_clean(F.coalesce(F.col(c), F.lit("")))))
    there = lambda c: F.length(_clean(F.coalesce(F.col(c), F.lit("")))) > 0
    return F.concat_ws("\\N", *[F.when(there(c), named(c)) for c in _tracks(content, order)])


def ass_colour(colour: str, transparency: float = 0.0) -> str:
    """#rrggbb as &HAABBGGRR."""
    r, g, b = (colour.lstrip("#").ljust(6, "0")[k : k + 2] for k in (0, 2, 4))
    return f"&H{int(transparency * 255 + 0.5):02x}{b}{g}{r}".upper()


def ass_header(title: str = "", width: int = 1920, height: int = 1080, styles: dict[str, dict] | None = None) -> str:
    """Script info and the styles Tgt and Src. styles: by name, font, size, colour, outline, bold and border of each, all with defaults."""
    scale = 1080 / min(width, height)
    info = ["[Script Info]", "Title: " + re.sub(r"[\r\n]+", " ", title), "ScriptType: v4.00+", f"PlayResX: {round(width * scale)}", f"PlayResY: {round(height * scale)}", "WrapStyle: 2", "ScaledBorderAndShadow: yes"]
    fields = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
    lines = []
    for name, size in (("Tgt", 60), ("Src", 42)):
        s = {"font": "Arial", "size": size, "colour": "#ffffff", "outline": "#000000", "bold": False, "border": 2} | (styles or {}).get(name, {})
        lines.append(f"Style: {name},{s['font']},{s['size']},{ass_colour(s['colour'])},&H000000FF,{ass_colour(s['outline'])},&H00000000,{-1 if s['bold'] else 0},0,0,0,100,100,0,0,1,{s['border']},0,2,20,20,20,1")
    return "\n".join([*info, "", "[V4+ Styles]", f"Format: {fields}", *lines]) + "\n"


def export_subtitles(cues: DataFrame, fmt: str, content: str = "dual", order: str = "tgt-top", header: str = "", width: float | None = None) -> DataFrame:
    """cues: media_id, ix, start, end, src, tgt. media_id, document, n: empty cues are left out, and numbers follow the rest.

    fmt: srt, vtt, txt or ass. header: for ASS, script info and styles, ass_header() by default. width: texts are wrapped at
    so many width units. TXT shows texts as they are. One aggregate by media item; a document is one row.
    """
    if width is not None:
        for column in _tracks(content, order):
            cues = wrap_lines(cues, width, column=column)
    ass = _ass_text(content, order) if fmt == "ass" else F.lit(None).cast("string")
    rows = cues.select("media_id", "ix", "start", "end", shown_text(content, order).alias("text"), raw_text(content, order).alias("raw"), ass.alias("ass")).filter(F.length("text") > 0)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("ix")))
    span = lambda mark: F.concat(T.format_time(F.col("start"), mark), F.lit(" --> "), T.format_time(F.col("end"), mark))
    number = F.concat(F.col("n").cast("string"), F.lit("\n"))
    indented = F.replace(F.col("raw"), F.lit("\n"), F.lit("\n" + " " * 8))
    block = {
        "srt": lambda: F.concat(number, span(","), F.lit("\n"), F.col("text"), F.lit("\n")),
        "vtt": lambda: F.concat(number, span("."), F.lit("\n"), _vtt_escaped(F.col("text")), F.lit("\n")),
        "txt": lambda: F.concat(F.lit("["), _short(F.col("start")), F.lit("] "), indented),
        "ass": lambda: F.concat(F.lit("Dialogue: 0,"), _ass_time(F.col("start")), F.lit(","), _ass_time(F.col("end")), F.lit(",Tgt,,0,0,0,,"), F.col("ass")),
    }[fmt]()
    events = "\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    first = {"srt": "", "vtt": "WEBVTT\n\n", "txt": "", "ass": (header or ass_header()) + events}[fmt]
    gathered = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))).alias("blocks"), F.count("*").alias("n"))
    return gathered.select("media_id", F.concat(F.lit(first), F.array_join(F.transform("blocks", lambda x: x["block"]), "\n"), F.lit("\n" if fmt == "ass" else "")).alias("document"), "n")


def safe_names(rows: DataFrame, name: str = "name", key: str = "media_id") -> DataFrame:
    """Adds file_name: forbidden characters replaced, 80 at most, a default for none, and ` (n)` where names clash.

    A number that a given name has already is left out. Equal names are numbered in the order of key, in one window a name.
    """
    clean = F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', "_")), 1, 80)
    rows = rows.withColumn("__name", F.when(F.length(clean) == 0, "untitled").otherwise(clean))
    numbered = r"^(.*) \(([0-9]{1,9})\)$"
    taken = rows.select(F.regexp_extract("__name", numbered, 1).alias("__name"), F.regexp_extract("__name", numbered, 2).try_cast("int").alias("k")).filter("k > 1")
    taken = taken.groupBy("__name").agg(F.sort_array(F.collect_set("k")).alias("__taken"))
    nth = F.row_number().over(Window.partitionBy("__name").orderBy(key))
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__nth"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    rows = rows.withColumn("__nth", nth).join(taken, "__name", "left")
    return rows.withColumn("file_name", F.when(F.col("__nth") > 1, F.concat("__name", F.lit(" ("), free.cast("string"), F.lit(")"))).otherwise(F.col("__name"))).drop("__name", "__nth", "__taken")
