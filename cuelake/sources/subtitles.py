"""Subtitle files as tables: encodings, formats, cues, normalisation, languages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as St

from ..functions import text as T

MAX_BYTES = 20_000_000
#: The legacy encodings tried. Of equally plausible ones the first is taken: those of two bytes a character before those of
#: one, and of them the one with the fewest common characters, which a text in another encoding hits least by chance.
ENCODINGS = ("euc_kr", "shift_jis", "gb18030", "big5", "cp1251", "cp1252")
# The marks typical of Chinese and Japanese text.
MARKS = "，。！？、：；「」『』（）…—ー"
#: First and last lead byte of the part of a double-byte encoding that its standard gives to the characters in common use.
COMMON_ROWS = {"big5": (0xA4, 0xC6), "gb18030": (0xB0, 0xD7), "shift_jis": (0x88, 0x97)}
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}]"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content, too_large. Files of more than MAX_BYTES have a row without content, which isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= MAX_BYTES).select("path", "length", "content", F.lit(False).alias("too_large"))
    large = files.filter(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("too_large"))
    return small.unionByName(large)


@cache
def _common(encoding: str) -> frozenset[str]:
    """The characters in common use, by the standard's own order, and the marks."""
    first, last = COMMON_ROWS[encoding]
    codes = (bytes((lead, trail)).decode(encoding, "ignore") for lead in range(first, last + 1) for trail in range(0x40 if encoding != "gb18030" else 0xA1, 0xFF))
    return frozenset(c for c in codes if len(c) == 1) | set(MARKS)


def plausibility(text: str, encoding: str) -> float:
    """The share of the characters beyond ASCII that text of the encoding's languages is made of.

    A text in another double-byte encoding reads as characters of all rows, one in its own as common ones. Western text
    that is read as Cyrillic mixes alphabets in its words, so their share counts against it.
    """
    foreign = [c for c in text if c > "\x7f"]
    if not foreign:
        return 0.0
    if encoding in COMMON_ROWS:
        common = _common(encoding)
        kana = encoding == "shift_jis"
        good = sum(c in common or kana and "\u3040" <= c <= "\u30ff" for c in foreign)
    else:
        low, high, marks = {"euc_kr": ("가", "힯", ""), "cp1251": ("\u0400", "\u04ff", ""), "cp1252": ("À", "ÿ", "‘’“”–—…€")}[encoding]
        good = sum(low <= c <= high or c in marks for c in foreign)
    share = good / len(foreign)
    if encoding == "cp1251" and (words := regex.findall(r"[A-Za-z\u0400-\u04ff]+", text)):
        share *= 1 - sum(bool(regex.search("[A-Za-z]", w) and regex.search("[\u0400-\u04ff]", w)) for w in words) / len(words)
    return share


def utf16_without_mark(content: bytes) -> str | None:
    """UTF-16 told by the zero bytes of its first 4000: three in ten and more on one side, hardly any on the other."""
    head = content[:4000]
    even, odd = head[::2].count(0), head[1::2].count(0)
    some, few = 0.3 * len(head), 0.02 * len(head)
    return "utf-16-le" if odd > some and even < few else "utf-16-be" if even > some and odd < few else None


def decoded(content: bytes, forced: str | None = None) -> tuple[str, str]:
    """Text and encoding: as forced, by mark, by zero bytes, as UTF-8, else as the legacy encoding that reads most plausibly, earlier ones first."""
    if forced:
        return content.decode(forced, "replace"), forced
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), name
    if sure := utf16_without_mark(content):
        return content.decode(sure, "replace"), sure
    best: tuple[float, str, str] | None = None
    for nth, name in enumerate(("utf-8", *ENCODINGS)):
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        if not nth:
            return text, name
        score = plausibility(text, name) - 0.001 * nth
        if best is None or score > best[0]:
            best = score, text, name
    return best[1:] if best else (content.decode("cp1252", "replace"), "cp1252")


def decode(files: DataFrame, forced: str | None = None) -> DataFrame:
    """files: path, content. path, text, encoding: a file is decoded and judged in its row, and content goes no further. Files without content have no row."""

    @F.pandas_udf("struct<text:string,encoding:string>")
    def read(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(bytes(x), forced) for x in contents], columns=["text", "encoding"])

    found = files.filter(F.col("content").isNotNull()).select("path", read("content").alias("c"))
    return found.select("path", F.regexp_replace(F.regexp_replace("c.text", "^\\x{FEFF}", ""), "\r\n?", "\n").alias("text"), "c.encoding")


def read_pcm(spark: SparkSession, path: str, block: int = 16_000, pattern: str = "*.f32") -> DataFrame:
    """path, block_ix, x (array of floats, one block): raw 32-bit little-endian samples. A recording whose peak is over 1 is divided by it.

    Files are cut where they are read; a peak is an aggregate over blocks. Bytes after the last whole sample are left out, and an empty file has no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_buffer()
                samples = np.frombuffer(data, dtype="<f4", count=len(data) // 4)
                for k in range(0, len(samples), block):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([k // block], pa.int64()), pa.array([samples[k : k + block]], pa.list_(pa.float32()))], ["path", "block_ix", "x"])

    blocks = files.mapInArrow(cut, "path string, block_ix long, x array<float>")
    return scaled_by_peak(blocks)


def scaled_by_peak(blocks: DataFrame, key: str = "path") -> DataFrame:
    """key, block_ix, x: the samples of each key over its peak, where that is over 1."""
    peak = blocks.groupBy(key).agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("peak"))
    over = F.greatest(F.col("peak"), F.lit(1.0).cast("float"))
    return blocks.join(peak, key).select(key, "block_ix", F.transform("x", lambda v: (v / over).cast("float")).alias("x"))


def with_format(texts: DataFrame) -> DataFrame:
    """Adds fmt: ass, vtt or srt, by extension or by the first lines."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    ass = extension.isin("ass", "ssa") | F.col("text").rlike(r"(?i)^\s*\[Script Info\]")
    return texts.withColumn("fmt", F.when(ass, "ass").when((extension == "vtt") | F.col("text").rlike(r"^\s*WEBVTT"), "vtt").otherwise("srt"))


_CUE = "path string, start double, end double, lines array<string>, tagged map<string,string>, ord int"


def parse_blocks(texts: DataFrame) -> DataFrame:
    """path, start, end, lines, tagged, ord of SRT and WebVTT texts. Windows over lines: headers open cues, blank lines part blocks."""
    lines = texts.filter("fmt <> 'ass'").select("path", "fmt", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    by = Window.partitionBy("path").orderBy("n")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    is_time = F.col("line").rlike(r"\d\s*-->\s*\d")
    rows = lines.withColumns({"head": is_time.cast("int"), "blank": (F.trim("line") == "").cast("int")})
    rows = rows.withColumns({"cue": F.sum("head").over(upto), "block": F.sum("blank").over(upto), "next_head": F.coalesce(F.lead("head").over(by), F.lit(0))})
    in_block = Window.partitionBy("path", "block")
    first_line = F.first(F.when(F.col("blank") == 0, F.col("line")), ignorenulls=True).over(in_block.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"headed": F.max("head").over(in_block), "first": first_line, "size": F.sum(1 - F.col("blank")).over(in_block)})
    index = (F.col("line").rlike(r"^\s*\d+\s*$")) & (F.col("next_head") == 1)
    lone_number = (F.col("headed") == 0) & (F.col("size") == 1) & (F.trim("line") == (F.col("cue") + 1).cast("string"))
    skipped = (F.col("fmt") == "vtt") & (F.col("headed") == 0) & F.coalesce(F.col("first").rlike(r"^(NOTE|STYLE|REGION)\b"), F.lit(False))
    words = rows.filter("cue > 0").filter(~index & ~lone_number & ~skipped & (F.col("blank") == 0))
    text = F.when(F.col("head") == 0, T.clean_markup(F.col("line")))
    cues = words.groupBy("path", "cue").agg(F.max(F.when(F.col("head") == 1, F.col("line"))).alias("time"), F.array_sort(F.collect_list(F.when(text.isNotNull() & (text != ""), F.struct("n", text.alias("t"))))).alias("ls"))
    ends = F.split("time", "-->")
    out = cues.select("path", T.parse_time(F.trim(ends[0])).alias("start"), T.parse_time(F.trim(ends[1])).alias("end"), F.transform("ls", lambda x: x["t"]).alias("lines"), F.lit(None).cast("map<string,string>").alias("tagged"), F.col("cue").cast("int").alias("ord"))
    return out.filter("end > start")


def parse_ass(texts: DataFrame) -> DataFrame:
    """The same of ASS texts: Dialogue lines of [Events], split by the Format line; styles switched to rSrc or rTgt make tagged texts."""
    lines = texts.filter("fmt = 'ass'").select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    upto = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("line").rlike(r"^\s*\["), F.lower(F.trim("line"))), ignorenulls=True).over(upto)
    columns = F.last(F.when(F.col("line").rlike(r"(?i)^Format:"), F.transform(F.split(F.regexp_replace("line", r"(?i)^Format:", ""), ","), lambda x: F.lower(F.trim(x)))), ignorenulls=True).over(upto)
    usual = F.array(*map(F.lit, ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")))
    rows = lines.withColumns({"section": section, "columns": columns}).filter("section = '[events]'").filter(F.col("line").rlike(r"(?i)^Dialogue:"))
    rows = rows.withColumn("columns", F.coalesce("columns", usual))
    values = F.expr(r"split(regexp_replace(line, '(?i)^Dialogue:\\s*', ''), ',', size(columns))")
    fields = rows.select("path", "n", F.map_from_entries(F.arrays_zip(F.array_distinct("columns"), values)).alias("f"))
    raw = F.regexp_replace(F.col("f")["text"], r"\{[^}]*\\p[1-9][^}]*\}.*?(\{[^}]*\\p0[^}]*\}|$)", "")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\{[^}]*\}", ""), r"\\[Nn]", "\n"), r"\\h", " "))
    named = r"\{{[^}}]*?\\r{0}\b[^}}]*\}}"
    segment = lambda tag: plain(F.regexp_extract(raw, f"(?s){named.format(tag)}(.*?)({named.format('(?:Src|Tgt)')}|$)", 1))
    part = lambda tag: F.nullif(T.join_lines(F.filter(F.transform(F.split(segment(tag), "\n"), lambda x: F.trim(x)), lambda x: x != "")), F.lit(""))
    tagged = F.when(raw.rlike(named.format("(?:Src|Tgt)")), F.map_filter(F.create_map(F.lit("src"), part("Src"), F.lit("tgt"), part("Tgt")), lambda k, v: v.isNotNull()))
    out = fields.select("path", T.parse_time(F.col("f")["start"]).alias("start"), T.parse_time(F.col("f")["end"]).alias("end"), F.filter(F.split(plain(raw), "\n"), lambda x: F.trim(x) != "").alias("lines"), tagged.alias("tagged"), F.col("n").alias("ord"))
    return out.filter("end > start")


def normalise(cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cues as parsed. Returns (path, ix, start, end, lines, tagged), sorted and disjoint, and (path, merged, trimmed, dropped).

    Cues that begin within 0.02 s of a group's first one join it: a fold over one file's cues.
    """
    schema = St.StructType([*cues.drop("ord").schema.fields, St.StructField("merged", St.LongType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in pdf.sort_values(["start", "end", "ord"]).drop(columns="ord").to_dict("records"):
            lines, tags = list(row["lines"]), dict(row["tagged"]) if row["tagged"] is not None else None
            if out and row["start"] - out[-1]["start"] < 0.02:
                last = out[-1]
                last["merged"] += int(abs(row["end"] - last["end"]) >= 0.02)
                last["lines"], last["end"] = last["lines"] + lines, max(last["end"], row["end"])
                last["tagged"] = {**(last["tagged"] or {}), **(tags or {})} or None
            else:
                out.append(row | {"lines": lines, "tagged": tags, "merged": 0})
        return pd.DataFrame(out, columns=schema.names)

    joined = cues.groupBy("path").applyInPandas(fold, schema)
    following = F.lead("start").over(Window.partitionBy("path").orderBy("start"))
    rows = joined.withColumn("trimmed", F.coalesce(F.col("end") > following + 0.001, F.lit(False)))
    rows = rows.withColumn("end", F.when(F.col("trimmed"), following).otherwise(F.col("end")))
    rows = rows.withColumn("dropped", (F.col("end") - F.col("start") < 0.05) | ((F.size("lines") == 0) & F.col("tagged").isNull()))
    stats = rows.groupBy("path").agg(F.sum("merged").alias("merged"), F.count_if("trimmed").alias("trimmed"), F.count_if("dropped").alias("dropped"))
    ix = (F.row_number().over(Window.partitionBy("path").orderBy("start")) - 1).cast("long")
    return rows.filter("NOT dropped").select("path", ix.alias("ix"), "start", "end", "lines", "tagged"), stats


def _split_dual(lines: Column) -> tuple[Column, Column]:
    """Two lines are top and bottom; more are cut where the script changes if it changes once, else in the middle."""
    wide = F.transform(lines, lambda x: x.rlike(CJK))
    changes = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1))), lambda i: F.coalesce(F.get(wide, i) != F.get(wide, i - 1), F.lit(False)))
    at = F.when(F.size(changes) == 1, changes[0]).otherwise(F.ceil(F.size(lines) / 2).cast("int"))
    return T.join_lines(F.slice(lines, F.lit(1), at)), T.join_lines(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))))


def guess_modes(cues: DataFrame, target_is_cjk: bool) -> DataFrame:
    """path, mode: tgt-top for files with tagged pairs, or by where the CJK line sits where half the cues have two scripts; else src."""
    top, bottom = F.get("lines", F.lit(0)).rlike(CJK), F.element_at("lines", -1).rlike(CJK)
    two = (F.size("lines") >= 2) & (top != bottom)
    stats = cues.groupBy("path").agg(F.bool_or(F.coalesce(F.map_contains_key("tagged", "src") & F.map_contains_key("tagged", "tgt"), F.lit(False))).alias("pairs"), F.avg(F.coalesce(two, F.lit(False)).cast("int")).alias("share"), F.count_if(two & top).alias("top"), F.count_if(two & bottom).alias("bottom"))
    dual = F.when((F.col("top") >= F.col("bottom")) == F.lit(target_is_cjk), "tgt-top").otherwise("src-top")
    return stats.select("path", F.when(F.col("pairs"), "tgt-top").when(F.col("share") >= 0.5, dual).otherwise("src").alias("mode"))


def assign_languages(cues: DataFrame, modes: DataFrame | str) -> DataFrame:
    """Adds src and tgt by the file's mode, or by one mode for all: src, tgt, tgt-top or src-top. Tagged cues keep their tags."""
    rows = cues.withColumn("mode", F.lit(modes)) if isinstance(modes, str) else cues.join(modes, "path")
    top, bottom = _split_dual(F.col("lines"))
    whole = T.join_lines(F.col("lines"))
    tag = lambda k: F.coalesce(F.element_at("tagged", F.lit(k)), F.lit(""))
    mode = F.col("mode")
    src = F.when(F.col("tagged").isNotNull(), tag("src")).when(mode == "src", whole).when(mode == "tgt", "").when(mode == "src-top", top).otherwise(F.when(F.size("lines") < 2, whole).otherwise(bottom))
    tgt = F.when(F.col("tagged").isNotNull(), tag("tgt")).when(mode == "tgt", whole).when(mode == "src", "").when(mode == "src-top", bottom).otherwise(F.when(F.size("lines") < 2, "").otherwise(top))
    return rows.select("path", "ix", "start", "end", src.alias("src"), tgt.alias("tgt"))


def ingest_subtitles(files: DataFrame, target_is_cjk: bool = True, mode: str | None = None, encoding: str | None = None, checkpoint_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """files: path, content. Returns cues (path, ix, start, end, src, tgt) and statistics per file.

    With checkpoint_dir, a folder that all executors share, decoded texts and scanned cues are written there once and read by
    all that follows; without it each of these decodes again.
    """

    def once(df: DataFrame) -> DataFrame:
        if checkpoint_dir is None:
            return df
        path = f"{checkpoint_dir}/ingest-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    texts = once(with_format(decode(files, encoding)))
    cues, stats = normalise(once(parse_blocks(texts).unionByName(parse_ass(texts))))
    return assign_languages(cues, mode or guess_modes(cues, target_is_cjk)), stats


def parse_glossary(lines: DataFrame, column: str = "value") -> DataFrame:
    """src, tgt of lines `a = b`; lines without a left side go."""
    parts = F.split(F.col(column), "=", 2)
    return lines.filter(F.contains(F.col(column), F.lit("="))).select(F.trim(parts[0]).alias("src"), F.trim(parts[1]).alias("tgt")).filter("src <> ''")


def read_projects(documents: DataFrame, schema: str) -> DataFrame:
    """documents: path, doc, bak (JSON texts). Adds data by the schema, recovered (from the backup) and broken (neither reads)."""
    reads = lambda c: F.when(F.expr(f"try_parse_json({c})").isNotNull(), F.from_json(c, schema))
    rows = documents.withColumns({"__doc": reads("doc"), "__bak": reads("bak")})
    return rows.select(*documents.columns, F.coalesce("__doc", "__bak").alias("data"), (F.col("__doc").isNull() & F.col("__bak").isNotNull()).alias("recovered"), (F.col("__doc").isNull() & F.col("__bak").isNull()).alias("broken"))


PROBE = "format struct<format_name:string,duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,color_transfer:string,disposition:map<string,int>,tags:map<string,string>,side_data_list:array<struct<rotation:int>>>>"
UNSAFE = ("hls", "concat", "dash", "applehttp")


def media_info(probes: DataFrame) -> DataFrame:
    """probes: media_id, probe (JSON). The first real video stream, the first audio one, subtitle codecs, frame rate, turned sizes, HDR, safe."""
    rows = probes.withColumn("p", F.from_json("probe", PROBE))
    video = F.filter("p.streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(F.element_at(s["disposition"], F.lit("attached_pic")), F.lit(0)) == 0))
    audio = F.filter("p.streams", lambda s: s["codec_type"] == "audio")
    subs = F.transform(F.filter("p.streams", lambda s: s["codec_type"] == "subtitle"), lambda s: s["codec_name"])
    v = F.get(video, F.lit(0))
    rate = F.split(v["avg_frame_rate"], "/")
    turned = F.abs(F.coalesce(F.get(v["side_data_list"], F.lit(0))["rotation"], F.lit(0))) % 180 == 90
    return rows.select(
        "media_id", F.col("p.format.duration").try_cast("double").alias("duration"), F.col("p.format.format_name").alias("format"), v["codec_name"].alias("vcodec"),
        F.when(turned, v["height"]).otherwise(v["width"]).alias("width"), F.when(turned, v["width"]).otherwise(v["height"]).alias("height"),
        (rate[0].try_cast("double") / F.nullif(rate[1].try_cast("double"), F.lit(0.0))).alias("fps"), F.size(audio).alias("audio_tracks"), subs.alias("subs"),
        F.coalesce(v["color_transfer"].isin("smpte2084", "arib-std-b67"), F.lit(False)).alias("hdr"), (~F.arrays_overlap(F.split("p.format.format_name", ","), F.array(*map(F.lit, UNSAFE)))).alias("safe"),
    )
